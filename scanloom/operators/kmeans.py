"""K-Means by Lloyd's rounds, many runs in one pass.

A run is a set of centers: one start of one k. Rows are never moved. The centers of all runs together are one tensor of
runs x k x d numbers, which lives on the driver between rounds. Each round it is broadcast, and each task adds up the sums
of its Arrow batches per run and cluster, so what is shuffled is a row for each task, run and cluster. No code is generated
anew for other centers, and none grows with the number of runs.

`lloyd_bounded` is the form for many centers: it keeps Hamerly's bounds beside the rows and skips the distances that
can't change a row's cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.sources.tables import LoopTables

#: So many numbers of the centers are written into an expression when rows get their cluster. Distances that are held in
#: memory at once.
IN_EXPRESSION, AT_ONCE = 512, 1 << 20


@dataclass
class Run:
    """centers: k x d. history: the inertia of each round, with the old labels and the new centers."""

    key: tuple
    centers: np.ndarray
    history: list[float] = field(default_factory=list)
    inertia: float = float("nan")
    done: bool = False


def _point(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def squared_distances(columns: list[str], centers: np.ndarray) -> Column:
    """An array with the squared distance to each center."""
    return F.array(*[sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, center, strict=True)), F.lit(0.0)) for center in centers])


def nearest(distances: Column) -> Column:
    """The index, from 0, of the least distance; the lowest of equal ones."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def _distances(x: np.ndarray, centers: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of the rows of x from all centers, a part of the rows at a time; summed by column, as in SQL."""
    step = max(1, AT_ONCE // max(1, len(centers)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        yield slice(at, at + len(part)), sum(((part[:, j, None] - centers[None, :, j]) ** 2 for j in range(centers.shape[1])), np.zeros((len(part), len(centers))))


def _values(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """The columns of a batch from `first` on, side by side; a null counts as not a number."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[first:]])


def _located(df: DataFrame, columns: list[str], shared: Broadcast) -> DataFrame:
    def near(*values: pd.Series) -> pd.DataFrame:
        x = np.column_stack([v.to_numpy(float) for v in values])
        clusters, least = np.empty(len(x), np.int32), np.empty(len(x))
        for rows, d2 in _distances(x, shared.value):
            clusters[rows], least[rows] = d2.argmin(axis=1), d2.min(axis=1)
        return pd.DataFrame({"cluster": clusters, "d2": least})

    found = F.pandas_udf(near, "cluster int, d2 double")
    return df.withColumn("_near", found(*[F.col(c).cast("double") for c in columns])).withColumns({"cluster": F.col("_near.cluster"), "d2": F.col("_near.d2")}).drop("_near")


def located(df: DataFrame, columns: list[str], centers: np.ndarray) -> DataFrame:
    """df with cluster and d2, for any number of centers: their matrix is broadcast, k x d numbers."""
    return _located(df, columns, df.sparkSession.sparkContext.broadcast(np.asarray(centers, float)))


def _of_tensor(df: DataFrame, columns: list[str], tensor: list[np.ndarray], of_part: Callable, schema: str, names: list[str]) -> DataFrame:
    """of_part(x, more, tensor, state) for each batch of a task, which adds up in state; a task's rows come at its end."""
    shared = df.sparkSession.sparkContext.broadcast(tensor)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            if batch.num_rows:
                of_part(_values(batch, len(names)), batch.columns[: len(names)], shared.value, state)
        yield from state.get("rows", list)()

    found = df.select(*names, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(each, schema)
    found._shared = shared  # for whoever collects it
    return found


def _sums_of_part(x: np.ndarray, more: list, tensor: list[np.ndarray], state: dict) -> None:
    ends = np.cumsum([0, *(len(c) for c in tensor)])
    if not state:
        state["sums"], state["n"], state["d2"] = np.zeros((ends[-1], x.shape[1])), np.zeros(ends[-1], np.int64), np.zeros(ends[-1])

        def rows() -> list[pa.RecordBatch]:
            at = np.flatnonzero(state["n"])
            run = np.searchsorted(ends, at, side="right") - 1
            values = [run.astype(np.int32), (at - ends[run]).astype(np.int32), state["n"][at], state["d2"][at], *state["sums"][at].T]
            return [pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["run", "cluster", "n", "d2", *(f"s{i}" for i in range(x.shape[1]))])]

        state["rows"] = rows
    for rows_of, d2 in _distances(x, np.concatenate(tensor)):
        part = x[rows_of]
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            own = d2[:, low:high]
            near = own.argmin(axis=1)
            state["n"][low:high] += np.bincount(near, minlength=high - low)
            state["d2"][low:high] += np.bincount(near, own[np.arange(len(near)), near], high - low)
            for j in range(x.shape[1]):
                state["sums"][low:high, j] += np.bincount(near, part[:, j], high - low)


def _sums(df: DataFrame, columns: list[str], runs: list[Run]) -> list:
    """n, d2 and the sums s0, s1, ... of the columns by run and cluster."""
    names = [f"s{i}" for i in range(len(columns))]
    totals = [F.sum("n").alias("n"), F.sum("d2").alias("d2"), *[F.sum(s).alias(s) for s in names]]
    schema = "run int, cluster int, n long, d2 double, " + ", ".join(f"{s} double" for s in names)
    found = _of_tensor(df, columns, [r.centers for r in runs], _sums_of_part, schema, [])
    rows = found.groupBy("run", "cluster").agg(*totals).collect()
    found._shared.destroy()
    return rows


def lloyd(df: DataFrame, columns: list[str], runs: list[Run], max_iter: int = 150, tol: float = 1e-5) -> list[Run]:
    """All runs until their centers move less than tol (Frobenius norm) or max_iter rounds. An empty cluster keeps its center.

    The round's inertia uses the new centers with the old labels. It follows from sums alone: of one cluster,
    sum |x - new|^2 = sum |x|^2 - 2 new * sum x + n |new|^2."""
    for _ in range(max_iter):
        active = [r for r in runs if not r.done]
        if not active:
            break
        moved, inertia = [r.centers.copy() for r in active], [0.0] * len(active)
        for s in _sums(df, columns, active):
            total = np.array([s[f"s{i}"] for i in range(len(columns))])
            old, new = active[s["run"]].centers[s["cluster"]], total / s["n"]
            moved[s["run"]][s["cluster"]] = new
            # around the old center: sum |x - new|^2 = sum |x - old|^2 - n |new - old|^2, as new is the mean
            inertia[s["run"]] += s["d2"] - s["n"] * float(((new - old) ** 2).sum())
        for r, m, i in zip(active, moved, inertia, strict=True):
            r.history.append(i)
            r.done = float(np.linalg.norm(m - r.centers)) < tol
            r.centers = m
    return runs


def lloyd_bounded(df: DataFrame, columns: list[str], run: Run, max_iter: int = 150, tol: float = 1e-5) -> tuple[Run, float]:
    """One run as by `lloyd`, and the share of distances that it skipped (Hamerly 2010).

    Beside each row lie its cluster, an upper bound of its distance from the cluster's center and a lower bound of that
    from any other. A round moves the bounds by what the centers have moved; a row is looked at again only if its upper
    bound reaches the lower one, or half the way from its center to the next. Rows with their bounds are written anew each
    round, to the shared folder, and sums of the rows whose cluster stays are of no need of Python."""
    names, spark = [f"x{i}" for i in range(len(columns))], df.sparkSession
    values = [F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)]
    schema = ", ".join(f"{n} double" for n in names) + ", cluster int, upper double, lower double, looked long"
    before, computed, all_distances = run.centers.copy(), 0, 0
    with LoopTables(spark) as kept:
        state = df.select(*values, F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("looked"))
        for _ in range(max_iter):
            if run.done:
                break
            between = np.concatenate([d2 for _, d2 in _distances(run.centers, run.centers)])
            np.fill_diagonal(between, np.inf)
            shared = spark.sparkContext.broadcast((run.centers, np.sqrt(((run.centers - before) ** 2).sum(axis=1)), np.sqrt(between.min(axis=1)) / 2))
            state = kept.put("rows", state.mapInArrow(_bounded(shared, len(columns)), schema))
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("looked").alias("looked"), F.sum(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))).alias("squares"), *[F.sum(n).alias(n) for n in names]).collect()
            shared.destroy()
            moved, inertia = run.centers.copy(), 0.0
            for s in sums:
                total = np.array([s[n] for n in names])
                new = moved[s["cluster"]] = total / s["n"]
                inertia += s["squares"] - 2 * float(new @ total) + s["n"] * float(new @ new)
                computed, all_distances = computed + s["looked"], all_distances + s["n"] * len(run.centers)
            run.history.append(inertia)
            run.done = float(np.linalg.norm(moved - run.centers)) < tol
            before, run.centers = run.centers, moved
    return run, 1 - computed / max(1, all_distances)


def _bounded(shared: Broadcast, width: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, moved, half = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]])
            cluster, upper, lower = (batch.column(width + i).to_numpy(zero_copy_only=False).copy() for i in range(3))
            known, looked = cluster >= 0, np.zeros(len(x), np.int64)
            upper[known] += moved[cluster[known]]
            lower[known] -= moved.max()
            bound = np.where(known, np.maximum(lower, half[cluster]), -np.inf)
            # a little room for what rounding has added to the bounds
            open_rows = np.flatnonzero(~(upper < bound * (1 - 1e-12) - 1e-12))
            again = open_rows[known[open_rows]]
            upper[again] = np.sqrt(((x[again] - centers[cluster[again]]) ** 2).sum(axis=1))
            looked[again] += 1
            open_rows = open_rows[~(upper[open_rows] < bound[open_rows] * (1 - 1e-12) - 1e-12)]
            for rows, d2 in _distances(x[open_rows], centers):
                at, own = open_rows[rows], d2.argmin(axis=1)
                cluster[at], upper[at] = own, np.sqrt(d2[np.arange(len(own)), own])
                d2[np.arange(len(own)), own] = np.inf
                lower[at] = np.sqrt(d2.min(axis=1))
                looked[at] += len(centers)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(np.minimum(looked, len(centers)))], [*(f"x{i}" for i in range(width)), "cluster", "upper", "lower", "looked"])

    return each


def final_inertia(df: DataFrame, columns: list[str], runs: list[Run]) -> list[Run]:
    """Sets each run's inertia with the final labels."""
    for r in runs:
        r.inertia = 0.0
    for s in _sums(df, columns, runs):
        runs[s["run"]].inertia += s["d2"]
    return runs


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits from 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coins(hashes: np.ndarray, seed: int, nth: int) -> np.ndarray:
    """A number between 0 and 1 for each hash, seed and round."""
    start = np.uint64(((seed & 0xFFFFFFFF) << 32 | nth) ^ 0x9E3779B97F4A7C15)
    return ((_mixed(_mixed(hashes) ^ _mixed(np.array([start]))) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _pulls(nth: int, seeds: list[int]) -> Callable:
    """The row with the largest pull of each run, in a batch: log(u) / d2, for the first center log(u); of equal ones the
    smaller hash of the id. A run whose rows all lie on its centers has none."""

    def of_part(x: np.ndarray, more: list, tensor: list[np.ndarray], state: dict) -> None:
        hashes = more[0].to_numpy(zero_copy_only=False)
        if not state:
            state["best"] = {}

            def rows() -> list[pa.RecordBatch]:
                best = state["best"]
                columns = [[run for run in best], [b[0] for b in best.values()], [-b[1] for b in best.values()], [b[2] for b in best.values()]]
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
                return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["run", "pull", "hash", "x"])]

            state["rows"] = rows
        step = max(1, AT_ONCE // max(1, sum(len(c) for c in tensor), x.shape[1]))
        for at in range(0, len(x), step):
            part, own = x[at : at + step], hashes[at : at + step]
            for run, (seed, centers) in enumerate(zip(seeds, tensor, strict=True)):
                pull = np.log(_coins(own.view(np.uint64), seed, nth))
                if len(centers):
                    d2 = next(d for _, d in _distances(part, centers)).min(axis=1)
                    with np.errstate(divide="ignore"):
                        pull = np.where(d2 > 0, pull / d2, -np.inf)
                top = pull.max()
                if top == -np.inf:
                    continue
                i = min(np.flatnonzero(pull == top), key=lambda i: own[i])
                if run not in state["best"] or (top, -int(own[i])) > state["best"][run][:2]:
                    state["best"][run] = (float(top), -int(own[i]), part[i].tolist())

    return of_part


def plus_plus(df: DataFrame, id_column: str, columns: list[str], starts: dict[tuple, tuple[int, int]]) -> list[Run]:
    """starts: run key to (k, seed). The first center is any row, each next one a row with chance in proportion to its
    squared distance from the nearest center so far: the row with the largest log(u) / d2, u from a hash of seed, round
    and id. All runs pick their next center in one pass, with one row for each task and run and no cumulative sum. A run
    has fewer than k centers if there are fewer different rows."""
    keys, width = list(starts), len(columns)
    chosen: dict[tuple, list[np.ndarray]] = {k: [] for k in keys}
    rows = df.select(F.xxhash64(F.col(id_column)).alias("_hash"), *columns)
    for nth in range(max(k for k, _ in starts.values())):
        open_runs = [key for key in keys if nth < starts[key][0] and len(chosen[key]) == nth]
        if not open_runs:
            break
        tensor = [np.array(chosen[key], float).reshape(-1, width) for key in open_runs]
        found = _of_tensor(rows, columns, tensor, _pulls(nth, [starts[key][1] for key in open_runs]), "run int, pull double, hash long, x array<double>", ["_hash"])
        best = found.groupBy("run").agg(F.max_by("x", F.struct("pull", -F.col("hash"))).alias("x")).collect()
        found._shared.destroy()
        for r in best:
            chosen[open_runs[r["run"]]].append(np.array(r["x"], float))
    return [Run(key, np.array(chosen[key], float).reshape(-1, width)) for key in keys]


def oversampled(df: DataFrame, id_column: str, columns: list[str], k: int, seed: int = 42, rounds: int = 5) -> Run:
    """k starting centers in few passes (k-means||, Bahmani et al. 2012): each round takes rows with a chance of 2 k times
    their share of all squared distances, about 2 k of them; each candidate counts for the rows nearest to it, and the
    driver picks k of these few thousand as in `plus_plus`."""
    coin = lambda nth: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{nth}:"), F.col(id_column).cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    first = df.agg(F.max_by(_point(columns), F.struct(coin(0), -F.xxhash64(F.col(id_column)))).alias("x")).first()["x"]
    candidates = np.array([first], float)
    for nth in range(1, rounds + 1):
        shared = df.sparkSession.sparkContext.broadcast(candidates)
        rows = _located(df, columns, shared)
        cost = rows.agg(F.sum("d2")).first()[0] or 0.0
        taken = rows.filter(coin(nth) < F.col("d2") * (2 * k / cost)).select(_point(columns).alias("x")).collect() if cost > 0 else []  # about 2 k
        shared.destroy()
        if cost <= 0:
            break
        candidates = np.unique(np.vstack([candidates, *([r["x"]] for r in taken)]), axis=0)
    weights = np.zeros(len(candidates))
    for s in _sums(df, columns, [Run((), candidates)]):
        weights[s["cluster"]] = s["n"]
    random, chosen = np.random.default_rng(seed), []
    d2 = np.ones(len(candidates))
    for _ in range(min(k, len(candidates))):
        pull = weights * d2
        if pull.sum() <= 0:
            break
        chosen.append(int(random.choice(len(candidates), p=pull / pull.sum())))
        own = ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1)
        d2 = own if len(chosen) == 1 else np.minimum(d2, own)
    return Run((k, seed), candidates[chosen])


#: So many centers are started by k-means|| and moved with bounds.
MANY = 50


def kmeans(df: DataFrame, id_column: str, columns: list[str], k: int, seed: int = 42, max_iter: int = 150, tol: float = 1e-5) -> Run:
    """One start; the inertia is the last of the history."""
    if k > MANY:
        run = lloyd_bounded(df, columns, oversampled(df, id_column, columns, k, seed), max_iter, tol)[0]
    else:
        run = lloyd(df, columns, plus_plus(df, id_column, columns, {(k, seed): (k, seed)}), max_iter, tol)[0]
    run.inertia = run.history[-1] if run.history else 0.0
    return run


def kmeans_from(df: DataFrame, columns: list[str], centers: np.ndarray, max_iter: int = 150, tol: float = 1e-5) -> Run:
    return lloyd(df, columns, [Run(("given",), np.array(centers, float))], max_iter, tol)[0]


def kmeans_multi(df: DataFrame, id_column: str, columns: list[str], k: int, n_init: int = 10, seed: int = 42, max_iter: int = 150, tol: float = 1e-5) -> Run:
    """The start of the least inertia, counted with final labels; the first of equal ones."""
    runs = plus_plus(df, id_column, columns, {(k, seed + i): (k, seed + i) for i in range(n_init)})
    return min(final_inertia(df, columns, lloyd(df, columns, runs, max_iter, tol)), key=lambda r: r.inertia)


def elbow(df: DataFrame, id_column: str, columns: list[str], ks: range = range(2, 9), n_init: int = 1, seed: int = 42, max_iter: int = 40) -> DataFrame:
    """(k, inertia) of the best of n_init starts for each k; all starts of all k run together."""
    runs = plus_plus(df, id_column, columns, {(k, seed + i): (k, seed + i) for k in ks for i in range(n_init)})
    final_inertia(df, columns, lloyd(df, columns, runs, max_iter))
    best = {k: min(float(r.inertia) for r in runs if r.key[0] == k) for k in ks}
    return df.sparkSession.createDataFrame(sorted(best.items()), "k int, inertia double")


def predict(df: DataFrame, columns: list[str], centers: np.ndarray) -> DataFrame:
    """df with cluster (the nearest center, the lowest of equal ones) and d2."""
    if np.size(centers) > IN_EXPRESSION:
        return located(df, columns, centers)
    rows = df.withColumn("_d", squared_distances(columns, centers))
    return rows.withColumn("cluster", nearest(F.col("_d"))).withColumn("d2", F.array_min("_d")).drop("_d")


def history_table(df: DataFrame, run: Run) -> DataFrame:
    return df.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(run.history)], "iter int, inertia double")


def center_table(df: DataFrame, run: Run) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(run.centers)], "cluster int, center array<double>")
