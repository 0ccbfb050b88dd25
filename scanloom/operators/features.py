"""A table in few clustering features, in one read: count, sum and squared norm of rows that lie close together.

Features of two sets of rows add up to those of both, so they merge in any order. A task takes its rows in as features of
one row each; whenever it holds `ROOM` times as many as wanted it condenses them. What the tasks have is merged on Spark in
a tree of `FAN` to one, so no task sees more than that many times the wanted number. To condense is to cut: the cell with
the largest spread along one axis is cut at its mean there, until there are as many cells as wanted (BIRCH's features,
Zhang et al. 1996, with a divisive cut in place of its insertions).

`small_clusters` makes m centers of the features of the whole table, by weighted K-Means on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features for each center wanted; how many times as many a task holds before it condenses; tasks that merge into one.
DETAIL, ROOM, FAN = 8, 4, 8
FEATURE = "n long, sums array<double>, squares double"


def condensed(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `most` features of what the given ones hold."""
    if len(n) <= most:
        return n, sums, squares
    means = sums / n[:, None]

    def cell(rows: np.ndarray) -> tuple[float, int, int, float, np.ndarray] | None:
        weight = n[rows].sum()
        mean = sums[rows].sum(axis=0) / weight
        spread = (n[rows, None] * (means[rows] - mean) ** 2).sum(axis=0)
        axis = int(spread.argmax())
        below = means[rows, axis] <= mean[axis]
        if below.all() or not below.any():
            return None
        return -float(spread[axis]), int(rows[0]), axis, float(mean[axis]), rows

    open_cells, closed = [], []

    def keep(rows: np.ndarray) -> None:
        found = cell(rows) if len(rows) > 1 else None
        if found is None:
            closed.append(rows)
        else:
            heapq.heappush(open_cells, found)

    keep(np.arange(len(n)))
    while open_cells and len(open_cells) + len(closed) < most:
        _, _, axis, cut, rows = heapq.heappop(open_cells)
        below = means[rows, axis] <= cut
        keep(rows[below])
        keep(rows[~below])
    cells = closed + [c[4] for c in open_cells]
    of = np.empty(len(n), np.int64)
    for nth, rows in enumerate(cells):
        of[rows] = nth
    totals = np.stack([np.bincount(of, sums[:, j], len(cells)) for j in range(sums.shape[1])], axis=1)
    return np.bincount(of, n, len(cells)).astype(np.int64), totals, np.bincount(of, squares, len(cells))


def _merging(most: int, of_rows: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return condensed(*(np.concatenate(c) for c in zip(*held, strict=True)), most)

        for batch in batches:
            for at in range(0, batch.num_rows, most * ROOM):
                part = batch.slice(at, most * ROOM)
                if of_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                    x = x[np.isfinite(x).all(axis=1)]
                    held.append((np.ones(len(x), np.int64), x, (x**2).sum(axis=1)))
                else:
                    sums = part.column(1).flatten().to_numpy()
                    held.append((part.column(0).to_numpy(), sums.reshape(part.num_rows, -1), part.column(2).to_numpy()))
                if sum(len(h[0]) for h in held) > most * ROOM:
                    held = [together()]
        if held:
            n, sums, squares = together()
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(squares, pa.float64())], ["n", "sums", "squares"])

    return merge


def clustering_features(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most `most` features of the whole table, which is read once; rows with a null or non-finite value don't count."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    found, parts = rows.mapInArrow(_merging(most, True), FEATURE), rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.repartition(parts).mapInArrow(_merging(most, False), FEATURE)
    return found


def _weighted_centers(x: np.ndarray, n: np.ndarray, k: int, seed: int, rounds: int) -> np.ndarray:
    random, chosen, d2 = np.random.default_rng(seed), [], np.full(len(x), np.inf)
    for _ in range(min(k, len(x))):
        pull = n * (np.ones(len(x)) if not chosen else d2)
        if pull.sum() <= 0:
            break
        chosen.append(int(random.choice(len(x), p=pull / pull.sum())))
        d2 = np.minimum(d2, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centers = x[chosen]
    for _ in range(rounds):
        near = np.concatenate([((centers**2).sum(axis=1)[None] - 2 * x[i : i + 1024] @ centers.T).argmin(axis=1) for i in range(0, len(x), 1024)])
        weight = np.bincount(near, n, len(centers))
        means = np.stack([np.bincount(near, n * x[:, j], len(centers)) for j in range(x.shape[1])], axis=1)
        moved = np.where(weight[:, None] > 0, means / np.maximum(weight, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def small_clusters(df: DataFrame, columns: list[str], m: int, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """At most m centers of a table that is read once. DETAIL m features come to the driver."""
    found = clustering_features(df, columns, DETAIL * m).toPandas()
    if found.empty:
        return np.zeros((0, len(columns)))
    n = found["n"].to_numpy(float)
    return _weighted_centers(np.stack(found["sums"].to_numpy()) / n[:, None], n, m, seed, rounds)
