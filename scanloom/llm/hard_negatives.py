"""Hard negatives for contrastive training: norm-bucketed search in two passes.

Candidates are sorted by norm and cut into buckets, each of which lies in one place. No score in a bucket exceeds the
product of the anchor's norm and the bucket's largest, so an anchor visits only the buckets that can still give it
something. The first pass finds each anchor's positives, its `positives` best other rows of the same label. Each positive
opens a window of scores, from `low` to `high` percent of its own, for rows of other labels. The second pass finds the
best of each window: a bucket is passed by if its bound lies below the least lower limit of the anchor's windows and
below what they have so far. Before each pass the `LEAD` candidates of the largest norms, a bounded number that is
broadcast, are held against all anchors, so that a visit starts with a bar for each window.

In a bucket candidates lie by norm in slabs, and anchors stream by in tiles. A slab is multiplied with the anchors that it
can still serve; each window's k-th best score so far rises from slab to slab. Buckets give each window its k best, and the
best of all buckets are taken by a ranked window of Spark's, whose limit Spark pushes before the shuffle.

Components are integers: sums stay exact in double precision while they can't reach 2^53, else 64-bit integers are used.

Defined results: a row with a null label, vector or id, or with a null or non-finite component takes no part; missing
components of a shorter vector count as zero; an anchor's own id is neither positive nor negative for it; rows that
repeat an id are separate candidates, but one anchor, that of the least label and vector; equal scores go to the smaller
id; labels are whole numbers; positives of one id and score are told apart by their place among the anchor's; a window of a negative positive score
is empty, as its lower limit lies above the upper; fewer candidates give fewer rows; an empty table gives none; other
columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import checkpointed, require, shuffle_partitions
from scanloom.llm.topk import scaled

POSITIVES, NEGATIVES, SCALE, LOW, HIGH = 5, 5, 256, 80, 100
#: Candidates of a bucket, of a slab in it, and anchors that are held against a slab at once.
BUCKET, SLAB, TILE = 4096, 1024, 256
#: Candidates of the largest norms that all anchors are held against first.
LEAD = 2048
#: Parts that equal norms are dealt out by.
PARTS = 4096
EXACT = 1 << 53


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = values
    return out


class Slabs:
    """Candidates by falling norm, in slabs; in a slab by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        order, self.parts = np.argsort(-norms, kind="stable"), []
        for at in range(0, len(ids), SLAB):
            own = order[at : at + SLAB]
            own = own[np.argsort(ids[own], kind="stable")]
            self.parts.append((ids[own], labels[own], x[own], norms[own].max(initial=0.0)))
        self.largest = float(np.abs(x).max(initial=0)) if x.size else 0.0


def best_in_slabs(slabs: Slabs, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lows: np.ndarray, highs: np.ndarray, bars: np.ndarray, k: int, same: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, scores, ids) of each anchor's k best candidates of its own label, or with same=False of any other,
    in each of its windows: lows and highs, anchors x windows, are the least and largest score. What is below bars isn't
    wanted either; a window that isn't one has a low of infinity."""
    norms, width = np.sqrt((x.astype(float) ** 2).sum(axis=1)), max(1, x.shape[1])
    kind = np.float64 if float(np.abs(x).max(initial=0)) * slabs.largest * width < EXACT else np.int64
    # the bound is compared with room for the rounding of norms
    slack = 1 + 1e-9 * float(norms.max(initial=0)) * max((part[3] for part in slabs.parts), default=0.0)
    for start in range(0, len(ids), TILE):
        rows = np.arange(start, min(start + TILE, len(ids)))
        wanted = np.maximum(lows[rows], bars[rows])
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for own_ids, own_labels, y, norm in slabs.parts:
            active = np.flatnonzero(((norms[rows] * norm + slack)[:, None] >= wanted).any(axis=1))
            if not active.size:
                break  # norms only fall
            at = rows[active]
            scores = (x[at].astype(kind) @ y.T.astype(kind)).astype(float if kind is np.float64 else np.int64)
            allowed = ((labels[at][:, None] == own_labels[None]) == same) & (ids[at][:, None] != own_ids[None])
            for w in range(lows.shape[1]):
                inside = allowed & (scores >= wanted[active, w][:, None]) & (scores <= highs[at, w][:, None])
                for i in np.flatnonzero(inside.any(axis=1)).tolist():
                    found = np.flatnonzero(inside[i])
                    values, names = scores[i, found], own_ids[found]
                    key = (int(active[i]), w)
                    if key in kept:
                        values, names = np.concatenate([kept[key][0], values]), np.concatenate([kept[key][1], names])
                    if values.size > k:
                        enough = values >= np.partition(values, -k)[-k]
                        values, names = values[enough], names[enough]
                    top = np.lexsort((names, -values))[:k]
                    kept[key] = values[top], names[top]
                    if top.size == k:
                        wanted[active[i], w] = max(wanted[active[i], w], float(values[top[-1]]))
        for (i, w), (values, names) in kept.items():
            yield int(rows[i]), w, values, names


def _bars(lead: Slabs, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The k-th best score of each window among the lead's candidates, or minus infinity."""
    bars = np.full(lows.shape, -np.inf)
    for anchor, w, values, _ in best_in_slabs(lead, ids, labels, x, lows, highs, bars, k, same):
        if len(values) == k:
            bars[anchor, w] = values[-1]
    return bars


def _stacked(column: pa.Array, windows: int) -> np.ndarray:
    """Windows' numbers, a row for each anchor; windows that aren't there have infinity."""
    out = np.full((len(column), windows), np.inf)
    for i, values in enumerate(column.to_pylist()):
        out[i, : len(values)] = values
    return out


class _Buckets:
    """Candidates in buckets by norm, and the search of anchors in them."""

    def __init__(self, rows: DataFrame, k: int):
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        self.session, self.k = rows.sparkSession, k
        equal = rows.groupBy("id", "label", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"), F.max("asks").alias("asks"))
        self.candidates = checkpointed(equal.withColumn("square", square))
        sizes = self.candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        self.width, self.buckets = max(1, sizes["width"] or 1), -(-max(1, sizes["n"]) // BUCKET)
        # a place in the order of norms, in which equal norms have parts
        place = F.col("square") + F.pmod(F.xxhash64("id", "v"), F.lit(PARTS)) / F.lit(2.0 * PARTS)
        shares = F.array(*[F.lit(i / self.buckets) for i in range(1, self.buckets)]) if self.buckets > 1 else None
        self.borders = np.array(self.candidates.agg(F.percentile_approx(place, shares, 100 * self.buckets)).first()[0] if self.buckets > 1 else [], float)
        shared = self.session.sparkContext.broadcast(self.borders)

        @F.pandas_udf("int")
        def bucket_of(at: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(shared.value, at.to_numpy(), side="right").astype(np.int32))

        self.bucket_of = bucket_of
        self.there = self.candidates.select(bucket_of(place).alias("bucket"), F.lit(False).alias("asks"), "id", "label", "v", "n", F.lit(None).cast("array<double>").alias("lows"), F.lit(None).cast("array<double>").alias("highs"), F.lit(None).cast("array<double>").alias("bars"))
        lead = self.candidates.orderBy(F.desc("square"), "id", "label", "v").limit(LEAD).select("id", "label", "v", "n").toArrow()
        n = lead.column("n").to_numpy()
        x = _matrix(lead.column("v").combine_chunks(), self.width)
        self.lead = self.session.sparkContext.broadcast(Slabs(*(np.repeat(c, n, axis=0) for c in (lead.column("id").to_numpy(), lead.column("label").to_numpy(), x))))

    def anchors(self) -> DataFrame:
        """id, label, v, square of the rows that ask; of those with one id that of the least label and vector."""
        return self.candidates.filter("asks").groupBy("id").agg(F.min(F.struct("label", "v", "square")).alias("x")).select("id", "x.*")

    def search(self, anchors: DataFrame, windows: int, same: bool) -> DataFrame:
        """anchors: id, label, v, square, lows and highs. anchor_id, window, score and id: the k best of each window in each
        bucket that is visited."""
        k, width, lead, kinds = self.k, self.width, self.lead, dict(anchors.dtypes)

        def bar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                bars = _bars(lead.value, ids, labels, _matrix(batch.column(2), width), _stacked(batch.column(4), windows), _stacked(batch.column(5), windows), k, same)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b[: len(own)] for b, own in zip(bars.tolist(), batch.column(4).to_pylist(), strict=True)], pa.list_(pa.float64()))], ["id", "label", "v", "square", "lows", "highs", "bars"])

        barred = anchors.select("id", "label", "v", "square", "lows", "highs").mapInArrow(bar, f"id long, label {kinds['label']}, v array<long>, square double, lows array<double>, highs array<double>, bars array<double>")
        # the least score that some window of the anchor still wants
        least = F.array_min(F.zip_with("lows", "bars", lambda low, b: F.greatest(low, F.coalesce(b, low))))
        # |anchor| |candidate| >= least; a little less, for the norms are rounded
        first = F.when((least > 0) & (F.col("square") > 0), least * least / F.col("square") * (1 - 1e-9) - 1).otherwise(F.lit(-1.0))
        visits = barred.withColumn("first", self.bucket_of(first)).select(F.explode(F.sequence("first", F.lit(self.buckets - 1))).alias("bucket"), F.lit(True).alias("asks"), "id", "label", "v", F.lit(1).alias("n"), "lows", "highs", "bars")
        met = self.there.unionAll(visits).repartition(max(self.buckets, shuffle_partitions(self.session)), "bucket").sortWithinPartitions("bucket", "asks")
        return met.mapInArrow(_search(width, windows, k, same), "anchor_id long, window int, score long, id long")


def _search(width: int, windows: int, k: int, same: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, slabs = None, [], None
        for batch in batches:
            asks, numbers = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                if numbers[low] != bucket:
                    bucket, waiting, slabs = numbers[low], [], None
                ids, labels, x = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), width)
                if not asks[low]:
                    n = part.column(5).to_numpy()
                    waiting.append(tuple(np.repeat(c, n, axis=0) for c in (ids, labels, x)))
                    continue
                if slabs is None and waiting:
                    slabs, waiting = Slabs(*(np.concatenate(c) for c in zip(*waiting, strict=True))), []
                if slabs is None:
                    continue
                bars = np.where(np.isfinite(b := _stacked(part.column(8), windows)), b, -np.inf)
                found = list(best_in_slabs(slabs, ids, labels, x, _stacked(part.column(6), windows), _stacked(part.column(7), windows), bars, k, same))
                if found:
                    sizes = [len(f[2]) for f in found]
                    anchor = np.repeat(ids[[f[0] for f in found]], sizes)
                    window = np.repeat(np.array([f[1] for f in found], np.int32), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[3] for f in found]))], ["anchor_id", "window", "score", "id"])

    return search


def mine(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score: for each row with is_anchor
    and each of its `positives` best rows of the same label, the `negatives` best rows of other labels whose score is
    `low` to `high` percent of the positive's."""
    require(vectors, id_column, vector_column, label_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), scaled(vector_column, scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    buckets = _Buckets(rows.filter("id is not null and label is not null and v is not null"), max(positives, negatives))
    anchors = checkpointed(buckets.anchors())
    whole = anchors.withColumn("lows", F.array(F.lit(float("-inf")))).withColumn("highs", F.array(F.lit(float("inf"))))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = buckets.search(whole, 1, same=True).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
    found = checkpointed(found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("nth") - 1).alias("window")))
    opened = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("w"))  # `positives` of them
    scores = F.transform("w", lambda w: w["positive_score"])
    # the least and the largest whole score of a window; one that no score can lie in is none
    hundredth = lambda x: (x - F.pmod(x, F.lit(100))) / 100  # noqa: E731, rounded down
    lows = F.transform(scores, lambda s: F.when(s * low <= s * high, -hundredth(-s * low)).otherwise(F.lit(float("inf"))))
    highs = F.transform(scores, lambda s: hundredth(s * high))
    asked = anchors.join(opened, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "square", lows.alias("lows"), highs.alias("highs"))
    best = buckets.search(asked, positives, same=False)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return best.join(found, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
