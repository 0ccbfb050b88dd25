"""Exact top-k search by inner product: columnar branch and bound over blocks of dimensions.

Candidates lie in blocks by their norm, each in one place. The `lead` of the largest norms, a bounded number, is held
against all queries first, so that each query has a bar: its k-th best score so far. A block's scores can't exceed the
product of norms, so a query visits only the blocks from that on which can still reach its bar. So what is moved is each
candidate once a step, and the queries once for each block that they visit.

In a block the candidates lie vertically, one row per dimension, dimensions of the largest products first, and queries
stream by in tiles. Scores of a tile grow by a block of dimensions at a time. What the remaining dimensions can still add
is bounded by the norms of the remainders; candidates that no query of the tile can still want are dropped and the
survivors compacted. A block gives each query its k best, and the best of all blocks are taken by a ranked window, whose
limit Spark pushes before the shuffle.

Equal rows become one candidate with a number of copies first, k of them at most, for no query can use more.

Components are integers: sums stay exact in double precision while they can't reach 2^53, else 64-bit integers are
used, which wrap beyond 2^63.

Defined results: a vector that is null or holds a null or non-finite component takes no part; missing components of
a shorter vector count as zero; a query's own id is no candidate for it; rows that repeat an id are separate
candidates but one query, that of the least vector; equal scores go to the smaller id; a null id takes no part; fewer
candidates than k give fewer rows; an empty table gives none; other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import checkpointed, require, shuffle_partitions

K, SCALE = 20, 64
CANDIDATE_BLOCK, TILE, DIMENSIONS = 32768, 16, 16
#: Candidates of the largest norms that all queries are held against first, and queries that are at once.
LEAD, TOGETHER = 2048, 1024
#: Parts that equal norms are dealt out by.
PARTS = 4096
EXACT = 1 << 53


def scaled(vector: str, scale: int = SCALE) -> Column:
    """Each component as floor(scale * x), or null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, width), np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _remainders(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of what follows each cut of the dimensions; x has one row per dimension."""
    squares = np.cumsum((x.astype(float) ** 2)[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([squares, np.zeros((1, x.shape[1]))])[cuts])


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vertical: np.ndarray, k: int = K, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """queries: one row each; vertical: candidates, one row per dimension; bars: scores below a query's don't count.
    Gives (query, candidate's place, score) of each query's k best."""
    width = vertical.shape[0]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vertical).max(initial=0)) * max(1, width)
    kind = np.float64 if largest < EXACT else np.int64
    order = np.argsort(-((queries.astype(float) ** 2).mean(axis=0) * (vertical.astype(float) ** 2).mean(axis=1)), kind="stable")
    queries, vertical = queries[:, order].astype(kind), np.ascontiguousarray(vertical[order]).astype(kind)
    cuts = list(range(0, width, DIMENSIONS)) + [width]
    query_rest, rest = _remainders(queries.T, cuts), _remainders(vertical, cuts)
    slack = 1 + 1e-9 * largest

    few = np.argpartition(-rest[0], min(len(ids), 4 * k) - 1)[: 4 * k]
    first = np.where(ids[few] == query_ids[:, None], -np.inf, (queries @ vertical[:, few]).astype(float))
    least = np.partition(first, -k, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(queries), -np.inf)
    if bars is not None:
        least = np.maximum(least, bars)

    out = []
    for low in range(0, len(queries), TILE):
        tile, bar = queries[low : low + TILE], least[low : low + TILE, None] - slack
        alive, columns = np.arange(len(ids)), vertical
        scores = np.zeros((len(tile), len(ids)), kind)
        for nth, (start, stop) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            scores += tile[:, start:stop] @ columns[start:stop]
            reach = np.multiply.outer(query_rest[nth + 1][low : low + TILE], rest[nth + 1][alive]) + scores
            wanted = (reach >= bar).any(axis=0)
            if wanted.sum() < 0.8 * alive.size:
                alive, scores, columns = alive[wanted], scores[:, wanted], columns[:, wanted]
        for i, row in enumerate(scores):
            other = np.flatnonzero(ids[alive] != query_ids[low + i])
            values = row[other]
            if values.size > k:
                enough = values >= np.partition(values, -k)[-k]
                other, values = other[enough], values[enough]
            top = np.lexsort((ids[alive[other]], -values))[:k]
            out.append((np.full(top.size, low + i), alive[other[top]], values[top]))
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _square(v: str) -> Column:
    """A vector's squared norm."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _with_bars(queries: DataFrame, lead: DataFrame, width: int, k: int) -> DataFrame:
    """queries with bar, the k-th best score among the lead's rows, LEAD of them at most; null if there are fewer."""
    rows = lead.toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((np.repeat(rows["id"].to_numpy(), rows["n"]), np.repeat(_stacked(rows["v"], width), rows["n"], axis=0).T.astype(float)))

    def bars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vertical = shared.value
        for frame in batches:
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                scores = np.where(part["id"].to_numpy()[:, None] == ids, -np.inf, _stacked(part["v"], width).astype(float) @ vertical)
                bar = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(part), -np.inf)
                yield part.assign(bar=np.where(np.isfinite(bar), bar, np.nan))

    return queries.mapInPandas(bars, "id long, v array<long>, square double, bar double")


def meetings(rows: DataFrame, k: int = K) -> tuple[DataFrame, int]:
    """rows: id, v, asks. block, asks, id, v, n and bar: candidates, by block, and queries by each block they visit; and
    the width of the vectors."""
    candidates = checkpointed(rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"), F.max("asks").alias("asks")).withColumn("square", _square("v")))
    # a place in the order of norms, in which equal norms have parts
    place = F.col("square") + F.pmod(F.xxhash64("id", "v"), F.lit(PARTS)) / F.lit(2.0 * PARTS)
    sizes = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max("square").alias("square")).first()
    blocks, width = -(-max(1, sizes["n"]) // CANDIDATE_BLOCK), max(1, sizes["width"] or 1)
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else None
    borders = candidates.agg(F.percentile_approx(place, shares, 100 * blocks)).first()[0] if blocks > 1 else []
    edges = candidates.sparkSession.sparkContext.broadcast(np.array(borders, float))

    @F.pandas_udf("int")
    def block_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, at.to_numpy(), side="right").astype(np.int32))

    lead = candidates.orderBy(F.desc("square"), "id", "v").limit(LEAD).select("id", "v", "n")
    queries = _with_bars(candidates.filter("asks").groupBy("id").agg(F.min(F.struct("v", "square")).alias("x")).select("id", "x.v", "x.square"), lead, width, k)
    # |query| |candidate| >= bar; a little less, for the norms are rounded
    least = F.when((F.col("bar") > 0) & (F.col("square") > 0), F.col("bar") * F.col("bar") / F.col("square") * (1 - 1e-9) - 1).otherwise(F.lit(-1.0))
    visits = queries.withColumn("first", block_of(least)).select(F.explode(F.sequence("first", F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v", F.lit(1).alias("n"), "bar")
    there = candidates.select(block_of(place).alias("block"), F.lit(False).alias("asks"), "id", "v", "n", F.lit(None).cast("double").alias("bar"))
    return there.unionAll(visits).repartition(max(blocks, shuffle_partitions(rows.sparkSession)), "block"), width


def top_k(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each row with is_query its k best rows: query_id, rank (from 1), the candidate's id, score."""
    require(vectors, id_column, vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), scaled(vector_column, scale).alias("v"), is_query.alias("asks")).filter("id is not null and v is not null")
    met, width = meetings(rows, k)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, waiting, ids, vertical = None, [], None, None
        for frame in batches:
            for (own, asks), part in frame.groupby(["block", "asks"], sort=False):
                if own != block:
                    block, waiting, vertical = own, [], None
                if not asks:
                    waiting.append((np.repeat(part["id"].to_numpy(), part["n"]), np.repeat(_stacked(part["v"], width), part["n"], axis=0)))
                    continue
                if vertical is None and waiting:
                    ids, vertical = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]).T
                    waiting = []
                for at in range(0, len(part) if vertical is not None else 0, TOGETHER):
                    some = part.iloc[at : at + TOGETHER]
                    asked = some["id"].to_numpy()
                    query, found, score = best_of_block(asked, _stacked(some["v"], width), ids, vertical, k, some["bar"].fillna(-np.inf).to_numpy(float))
                    yield pd.DataFrame({"query_id": asked[query], "vec_id": ids[found], "score": score.astype("int64")})

    # in a block candidates come first, and then the queries stream by
    best = met.sortWithinPartitions("block", "asks").mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_column if id_column != "id" else "vec_id"), "score")
