"""Mixing of sources to target weights, with whole documents.

Weights share 100 % of all words among the sources; no source gives more than `cap` times its size, and what a capped
source can't take goes to the others by weight. Each source's documents are put in one permuted order, by a hash of
seed and id, and cut into blocks of about `block_words` words. A source is taken whole as often as its target holds it
and then up to the target along that order. The gap that a document leaves which doesn't fit is filled with those that
do, further along the order, or with the largest if that is a quarter of the gap, until none fits; so each round leaves
three quarters of the gap at most. A source that then lacks more than a part in NEAR of its target goes on with
documents that it has taken before, each at most `cap` times. Then the nearest is taken if that makes the gap smaller.
A source with at most SMALL_SOURCE documents takes those, each at most `cap` times, whose sizes come nearest to its target,
by the sums that can be reached, with few repeats.

So each source has an exact number of block draws. A splitting tree deals them to output shards: the root holds the
draws of all sources, each node draws its left half's share of them from a multivariate hypergeometric distribution,
and the leaves are the shards' quotas. Sources may be as many as hosts: the driver's tree splits the sums of `GROUPS`
groups of sources, and each group's own tree, in a task, splits its sources' draws to the group's quotas. Counts of any
size are drawn exactly. A shard takes the next draws of each source's permuted order, so shards are disjoint, and is
shuffled by a hash of its own.

A source's order is never sorted in one task: a hash prefix splits it into buckets of a few thousand documents, sums
of the buckets give their offsets, and only a bucket is sorted. The order's hash takes id, size, a hash of the text and
a number among equal rows, so rows that share an id are dealt out as others are. Sources are numbered by ranges of their
names, and the level to which they are filled is found by sums over all of them.

Defined results: a null or blank text has size 0, is taken for nothing and drawn only as part of a whole pass; null is
a source of its own, last in order; repeated rows count each; null ids are ordered first; an empty table gives an
empty mix; all sizes zero give targets of zero; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import WORD, checkpointed, require, shuffle_partitions, text_or_empty
from scanloom.sources.tables import LoopTables

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 42
BLOCK_WORDS, SHARDS, BUCKET_ROWS = 4096, 16, 4096
#: Bits of the order key, the first 15 hexadecimal digits of an md5.
KEY_BITS = 60
#: Groups of sources whose draws the driver splits.
GROUPS = 1024
#: numpy draws hypergeometrically from fewer than this.
NUMPY_BOUND = 1_000_000_000
#: Equal rows that one row stands for before they are dealt out, and standard deviations that a draw is looked for in.
EQUAL_ROWS, DEVIATIONS = 100_000, 12
#: Sources of so few documents have the best choice of all; others are near when they lack less than a part in NEAR.
SMALL_SOURCE, NEAR = 64, 1000
#: Sums of sizes that the best choice tells apart.
STEPS = 1 << 20


def _key(seed: int, *columns: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def _numbered(per_source: DataFrame) -> DataFrame:
    """per_source with place, from 0 in the order of sources, null last: ranges of sources, their sizes, a place in each."""
    order = F.col("source").asc_nulls_last()
    parts = checkpointed(per_source.repartitionByRange(shuffle_partitions(per_source.sparkSession), order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.join(before, F.col("part") == F.col("p")).withColumn("place", place).drop("part", "p", "before")


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """per_source: (source, source_size). Adds target, passes (whole ones) and rest (words after them).

    Each source takes weight times a level, or its cap. The level is what the capped ones leave, shared by weight; it only
    rises as more are capped, so it is found once no other source is.
    """
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = _numbered(per_source).withColumn("weight", share).withColumn("most", F.col("source_size") * cap)
    rows = checkpointed(rows.withColumn("ratio", F.col("most") / F.col("weight")).drop("place"))
    every = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight, capped_weight = every["words"] or 0, every["weight"] or 0, -1
    level = words / max(1, weight)
    while True:
        capped = rows.filter(F.col("ratio") < level).agg(F.sum("most").alias("words"), F.sum("weight").alias("weight")).first()
        if capped_weight == (capped_weight := capped["weight"] or 0) or capped_weight == weight:
            break
        level = (words - (capped["words"] or 0)) / (weight - capped_weight)
    target = F.when(F.col("ratio") < level, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap)))
    return rows.withColumn("target", target).withColumn("passes", passes.cast("int")).withColumn("rest", F.greatest(F.floor("target") - F.col("passes") * F.col("source_size"), F.lit(0)).cast("long")).select("source", "source_size", "target", "passes", "rest")


def hypergeometric(random: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws from good and bad ones, without putting back, are good. Beyond numpy's bound the chances around
    the mean are added up and one is looked up; what lies further out has a chance below 1e-30."""
    if good + bad < NUMPY_BOUND:
        return int(random.hypergeometric(good, bad, n))
    share = good / (good + bad)
    mean, spread = n * share, DEVIATIONS * (n * share * (1 - share) * (1 - n / (good + bad))) ** 0.5 + 2
    x = np.arange(max(0, n - bad, int(mean - spread)), min(good, n, int(mean + spread)) + 1, dtype=np.float64)
    steps = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - n + x[:-1] + 1)
    log_chance = np.concatenate(([0.0], np.cumsum(steps)))
    below = np.cumsum(np.exp(log_chance - log_chance.max()))
    return int(x[min(np.searchsorted(below, random.random() * below[-1], side="right"), x.size - 1)])


def left_share(random: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without putting back come from each of the counts."""
    left = int(counts.sum())
    if left < NUMPY_BOUND:
        return random.multivariate_hypergeometric(counts, n, method="marginals") if counts.size else counts
    out = np.zeros_like(counts)
    for i, own in enumerate(counts.tolist()):
        left -= own
        out[i] = hypergeometric(random, own, left, n) if n else 0
        n -= int(out[i])
    return out


def split_quotas(draws: list[int], totals: list[int], seed: list[int]) -> np.ndarray:
    """Exact quotas: row s, column j holds how many draws of s go to j. Rows sum to draws, columns to totals."""
    quotas = np.zeros((len(draws), len(totals)), np.int64)
    nodes = [(0, len(totals), np.array(draws, np.int64))]
    while nodes:
        low, high, counts = nodes.pop()
        if high - low == 1:
            quotas[:, low] = counts
            continue
        middle = (low + high) // 2
        left = left_share(np.random.default_rng([*seed, low, high]), counts, sum(totals[low:middle]))
        nodes += [(low, middle, left), (middle, high, counts - left)]
    return quotas


def shard_quotas(draws: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Exact block quotas of sources, or groups of sources, in shards whose totals differ by one at most."""
    ends = [sum(draws) * j // shards for j in range(shards + 1)]
    return split_quotas(draws, [b - a for a, b in zip(ends[:-1], ends[1:], strict=True)], [seed])


def _dealt(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """plan: s and draws, a row for each source. n (the source) and ends, the sums of its quotas up to each shard."""
    kind = dict(plan.dtypes)["s"]
    grouped = plan.select("s", "draws", F.pmod(F.xxhash64("s"), F.lit(GROUPS)).cast("int").alias("g"))
    sums = {r["g"]: int(r["draws"]) for r in grouped.groupBy("g").agg(F.sum("draws").alias("draws")).collect()}  # GROUPS rows at most
    names = sorted(sums)
    quotas = dict(zip(names, shard_quotas([sums[g] for g in names], shards, seed).tolist(), strict=True))

    def split(rows: pa.Table) -> pa.Table:
        rows, g = rows.sort_by("s"), rows.column("g")[0].as_py()  # nulls last
        ends = np.cumsum(split_quotas(rows.column("draws").to_pylist(), quotas[g], [seed, g]), axis=1)
        return pa.table([rows.column("s"), pa.array(list(ends), pa.list_(pa.int64()))], ["n", "ends"])

    return checkpointed(grouped.groupBy("g").applyInArrow(split, f"n {kind}, ends array<long>"))


def _size(text_column: str) -> Column:
    return F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("long")


def _equal_rows(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """id, source, size and h, a hash of the text, of each row, and nth, its number among rows that are equal in these.
    Equal rows are counted, and numbered by what their count unfolds to, not by sorting them."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), _size(text_column).alias("size"), F.xxhash64(text_column).alias("h"))
    counts = checkpointed(rows.groupBy("id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")))
    # those of a very frequent row in several tasks
    some = counts.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(EQUAL_ROWS))))
    if not counts.filter(F.col("n") > EQUAL_ROWS).isEmpty():
        some = some.repartition("id", "h", "from")
    return some.withColumn("nth", F.explode(F.sequence(F.col("from") + 1, F.least("n", F.col("from") + EQUAL_ROWS)))).drop("n", "from")


def _filled(kept: LoopTables, placed: DataFrame, plan: DataFrame, spread: Callable, same: Column, cap: int) -> tuple[DataFrame, DataFrame]:
    """What sources still lack after the part along their order: further along it those documents that fit, again and again
    until none does. First documents that this pass hasn't taken; then, while a source lacks more than a part in NEAR of
    its target, any that have been drawn less than cap times. Gives the plan, with what is left of the gaps, and where
    documents are drawn: n, at_bucket, at_place and more_start, a row for each draw. Small sources aren't filled here."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    columns, kinds = ("source", "bucket", "place", "size"), dict(placed.dtypes)
    schema = f"n {kinds['source']}, at_bucket {kinds['bucket']}, at_place {kinds['place']}, more_start bigint"
    free, again = placed.filter(~F.col("first") & ~F.col("small") & (F.col("size") > 0)).select(*columns), 0
    while True:
        free = kept.put("free", free.join(spread(plan.select("s", "gap", "more_words")), same).filter("size <= gap").drop("s", "b"))
        largest = kept.put("largest", free.groupBy(F.col("source").alias("s")).agg(F.min(F.struct((-F.col("size")).alias("less"), "bucket", "place")).alias("largest")))
        if largest.isEmpty():
            again += 1
            lacking = plan.filter((F.col("gap") * NEAR > F.col("target")) & ~F.col("small") & (F.col("passes") + 1 < cap)).select("s", F.col("gap").alias("lacks"))
            if again >= cap or lacking.isEmpty():
                return plan, kept.all("further", schema)
            times = kept.all("further", schema).groupBy("n", "at_bucket", "at_place").agg(F.count(F.lit(1)).alias("times"))
            there = F.col("source").eqNullSafe(F.col("n")) & (F.col("bucket") == F.col("at_bucket")) & (F.col("place") == F.col("at_place"))
            open_rows = placed.filter(F.col("size") > 0).join(spread(lacking), same).filter("size <= lacks").drop("s", "b").join(times, there, "left")
            free = open_rows.filter(F.col("passes") + F.col("first").cast("int") + F.coalesce("times", F.lit(0)) < cap).select(*columns)
            continue
        free = free.join(spread(largest), same).withColumn("alone", F.col("gap") <= -4 * F.col("largest.less")).drop("s", "b")
        free = kept.put("marked", free.withColumn("is_largest", (F.col("bucket") == F.col("largest.bucket")) & (F.col("place") == F.col("largest.place"))).drop("largest"))
        ahead = free.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        ahead = ahead.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead")
        free = free.join(ahead, same).drop("s", "b")
        along = Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        is_near = F.col("is_largest") | (~F.col("alone") & (F.col("ahead") < F.col("gap")))
        near = free.filter(is_near).withColumn("ahead", F.when(F.col("alone"), 0).otherwise(F.col("ahead") + F.sum("size").over(along) - F.col("size")))
        near = kept.put("near", near.withColumn("fits", F.col("alone") | (F.col("ahead") + F.col("size") <= F.col("gap"))))
        found = near.filter("fits")
        kept.add("further", found.select(F.col("source").alias("n"), F.col("bucket").alias("at_bucket"), F.col("place").alias("at_place"), (F.col("more_words") + F.col("ahead")).alias("more_start")))
        words = found.groupBy(F.col("source").alias("n")).agg(F.sum("size").alias("x"))
        plan = plan.join(words, F.col("s").eqNullSafe(F.col("n")), "left").withColumn("gap", F.col("gap") - F.coalesce("x", F.lit(0))).withColumn("more_words", F.col("more_words") + F.coalesce("x", F.lit(0))).drop("n", "x")
        plan = kept.put("plan", plan)
        free = free.filter(~is_near).select(*columns).unionAll(near.filter("not fits").select(*columns))


def best_draws(sizes: list[int], rest: int, most: int) -> list[int]:
    """How often each document, at most `most` times, is drawn so that their sizes come nearest to rest: of equally near
    sums the smaller, with few repeats and along the order. Sums beyond STEPS are counted in larger units, so they are off
    by a part in STEPS for each document at most."""
    unit = -(-max(rest, 1) // STEPS)
    goal, whole = round(rest / unit), [round(x / unit) for x in sizes]
    room = (1 << (2 * goal + 1)) - 1  # what is farther off than nothing at all needs no look
    turns = [i for _ in range(most) for i, x in enumerate(whole) if 0 < x <= 2 * goal]
    reached = [1]
    for i in turns:
        reached.append((reached[-1] | reached[-1] << whole[i]) & room)
    last = reached[-1]
    below = (last & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = last >> (goal + 1)
    total = goal + 1 + ((above & -above).bit_length() - 1) if above and (above & -above).bit_length() < goal - below else below
    draws = [0] * len(sizes)
    for nth in range(len(turns), 0, -1):
        if not reached[nth - 1] >> total & 1:
            total -= whole[turns[nth - 1]]
            draws[turns[nth - 1]] += 1
    return draws


def _best_of_small(rows: DataFrame, cap: int) -> DataFrame:
    """rows: those of sources of SMALL_SOURCE documents at most. n (the source) and picks, the places of the documents that
    are drawn, as often as they are."""

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("bucket", "ascending"), ("place", "ascending")])
        rest = rows.column("rest")[0].as_py()
        draws = best_draws(rows.column("size").to_pylist(), rest, cap) if rest else [0] * rows.num_rows
        places = zip(rows.column("bucket").to_pylist(), rows.column("place").to_pylist(), draws, strict=True)
        picks = [{"bucket": b, "place": p} for b, p, n in places for _ in range(n)]
        return pa.table([rows.column("source").slice(0, 1), pa.array([picks], pa.list_(pa.struct([("bucket", pa.int64()), ("place", pa.int32())])))], ["n", "picks"])

    kinds = dict(rows.dtypes)
    return rows.select("source", "bucket", "place", "size", "rest").groupBy("source").applyInArrow(pick, f"n {kinds['source']}, picks array<struct<bucket: bigint, place: int>>")


def _mix(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: tuple[int, ...], cap: int, seed: int, shards: int, block_words: int) -> DataFrame:
    """id, source, size, h, nth, source_size, target and shards of each row of docs."""
    rows = _equal_rows(docs, id_column, text_column, source_column)
    rows = checkpointed(rows.withColumn("key", _key(seed, "id", "size", "h", "nth")))
    bits = max(0, (max(1, rows.count()) // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "words")
    offsets = checkpointed(offsets.withColumnsRenamed({"source": "s", "bucket": "b"}))

    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "h", "nth")
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    placed = placed.withColumn("place", F.row_number().over(within)).withColumn("start", F.col("offset") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("block", F.floor(F.col("start") / block_words)).withColumn("first", F.col("start") + F.col("size") <= F.col("rest")).drop("offset")
    placed = checkpointed(placed)

    # a source's row is joined by source and bucket, so a source with most documents isn't one join key
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    buckets = offsets.select(F.col("s").alias("of"), "b")
    spread = lambda of_source: buckets.join(of_source, F.col("of").eqNullSafe(F.col("s"))).drop("of")
    counts = placed.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    small = checkpointed(counts.filter(F.col("n") <= SMALL_SOURCE).select("s"))
    is_small = spread(small.withColumn("small", F.lit(True)))
    placed = checkpointed(placed.join(is_small, same, "left").drop("s", "b").withColumn("small", F.coalesce("small", F.lit(False))).withColumn("first", F.col("first") & ~F.col("small")))
    placed = placed.withColumns({"passes": F.when(F.col("small"), 0).otherwise(F.col("passes")), "rest": F.when(F.col("small"), F.floor("target")).otherwise(F.col("rest"))})
    sums = placed.groupBy("source").agg(F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("target").alias("target"), F.first("small").alias("small"), F.max("block").alias("last_block"), F.sum(F.when(F.col("first"), F.col("size"))).alias("had"), F.max(F.when(F.col("first"), F.col("block"))).alias("last_first"))
    plan = sums.withColumn("gap", F.col("rest") - F.coalesce("had", F.lit(0))).withColumn("more_words", F.lit(0).cast("long")).withColumnRenamed("source", "s")
    with LoopTables(docs.sparkSession) as kept:
        plan, further = _filled(kept, placed, checkpointed(plan), spread, same, cap)
        there = F.col("source").eqNullSafe(F.col("n")) & (F.col("bucket") == F.col("at_bucket")) & (F.col("place") == F.col("at_place"))
        further = further.groupBy("n", "at_bucket", "at_place").agg(F.collect_list(F.floor(F.col("more_start") / block_words)).alias("more_blocks"))  # cap of them at most
        placed = placed.join(further, there, "left").withColumn("more_blocks", F.coalesce("more_blocks", F.array().cast("array<bigint>"))).drop("n", "at_bucket", "at_place")
        placed, plan = checkpointed(placed), checkpointed(plan)

    # then the nearest, if that makes the gap smaller; small sources have their best choice instead
    at, away = F.struct("bucket", "place"), F.abs(F.col("gap") - F.col("size"))
    drawn = F.col("passes") + F.col("first").cast("int") + F.size("more_blocks")
    free = placed.filter(~F.col("small") & (drawn < cap) & (F.col("size") > 0)).join(spread(plan.select("s", "gap")), same).filter(away.between(0, F.col("gap") - 1))
    found = free.groupBy(F.col("source").alias("n")).agg(F.array(F.min(F.struct(away.alias("away"), "size", "bucket", "place"))).alias("x"))
    found = found.select("n", F.transform("x", lambda x: F.struct(x["bucket"].alias("bucket"), x["place"].alias("place"))).alias("picks"))
    plan = plan.join(found.unionByName(_best_of_small(placed.filter("small"), cap)), F.col("s").eqNullSafe(F.col("n")), "left").drop("n")
    plan = plan.withColumn("picks", F.coalesce("picks", F.array().cast("array<struct<bucket: bigint, place: int>>")))
    # draws: the whole passes, the part along the order, what was taken further along it, the nearest
    in_pass = F.col("last_block") + 1
    plan = plan.withColumn("more_from", F.col("passes") * in_pass + F.coalesce(F.col("last_first") + 1, F.lit(0)))
    more_blocks = F.floor((F.col("more_words") + block_words - 1) / block_words)
    plan = plan.withColumn("draws", F.col("more_from") + more_blocks + F.size("picks"))

    # the draws of the sources are dealt to the shards
    plan = checkpointed(plan.select("s", "draws", "last_block", "more_from", "picks"))
    plan = plan.join(_dealt(plan, shards, seed), F.col("s").eqNullSafe(F.col("n")), "left").drop("n")

    placed = placed.join(spread(plan), same)
    whole = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda p: p * in_pass + F.col("block"))
    whole = F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    more = F.concat(
        F.when(F.col("first") & (F.col("rest") > 0), F.array(F.col("passes") * in_pass + F.col("block"))).otherwise(none),
        F.transform("more_blocks", lambda b: F.col("more_from") + b),
        F.filter(F.transform("picks", lambda p, i: F.when(p == at, F.col("draws") - 1 - i)), lambda d: d.isNotNull()),
    )
    shards_of = F.transform(F.concat(whole, more), lambda d: F.size(F.filter("ends", lambda e: e <= d)))
    return placed.select("id", "source", "size", "h", "nth", "source_size", "target", shards_of.alias("shards"))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, shards: int = SHARDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target and shards, an array with the output shard of each
    of the document's draws; its length tells how often the mix takes the document."""
    require(docs, id_column, text_column, source_column)
    found = _mix(docs, id_column, text_column, source_column, weights, cap, seed, shards, block_words)
    return found.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "shards")


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, shards: int = SHARDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The mix itself: each document as often as it is drawn, with its columns; partitioned by shard and shuffled within
    it. The plan is made of ids, sizes and hashes only; whole documents are dealt out twice, to meet their draws and to
    their shards. Rows that share id, source and text are told apart by number."""
    require(docs, id_column, text_column, source_column)
    names, partitions, same = docs.columns, shuffle_partitions(docs.sparkSession), ("k", "id", "source", "h")
    plan = _mix(docs, id_column, text_column, source_column, weights, cap, seed, shards, block_words)
    plan = checkpointed(plan.withColumn("k", F.xxhash64("id", "source", "h")).select(*same, "nth", "shards"))
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text_column).alias("h"))
    rows = rows.withColumn("k", F.xxhash64("id", "source", "h"))

    # a row with very many equals would overfill a task: these are numbered where they lie, and meet their draws by number
    limit = max(EQUAL_ROWS, plan.count() // (4 * partitions))
    many = checkpointed(plan.filter(F.col("nth") == limit + 1).select(F.col("k").alias("many_k")).distinct())  # at most 4 for each shuffle partition
    drawn = []
    if not many.isEmpty():
        hot, is_hot = F.broadcast(many), F.col("k") == F.col("many_k")
        apart = checkpointed(rows.join(hot, is_hot, "left_semi").repartition(partitions).withColumn("part", F.spark_partition_id()))
        before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = apart.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        numbered = apart.join(sizes, ["k", "part"]).withColumn("nth", F.col("before") + F.row_number().over(Window.partitionBy("k", "part").orderBy(F.lit(1))))
        drawn.append(numbered.join(plan.select("k", "nth", "shards"), ["k", "nth"]).select("row", "k", "nth", F.posexplode("shards").alias("time", "shard")))
        rows, plan = rows.join(hot, is_hot, "left_anti"), plan.join(hot, is_hot, "left_anti")
    rows = rows.repartition("k").withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))))
    plan = plan.select(*[F.col(c).alias(f"plan_{c}") for c in (*same, "nth")], "shards")
    # only k is a join key: it is how rows lie already
    rest = F.col("id").eqNullSafe(F.col("plan_id")) & F.col("source").eqNullSafe(F.col("plan_source")) & (F.abs(F.col("nth") - F.col("plan_nth")) == 0)
    drawn.append(rows.join(plan, (F.col("k") == F.col("plan_k")) & F.when(rest, True).otherwise(False)).select("row", "k", "nth", F.posexplode("shards").alias("time", "shard")))

    # a shard is shuffled in parts, so that tasks don't grow with it
    parts = F.lit(max(8, 4 * partitions // shards))
    order = F.xxhash64(F.lit(seed), "shard", "k", "nth", "time")
    every = drawn[0] if len(drawn) == 1 else drawn[0].unionAll(drawn[1])
    return every.withColumn("order", order).repartition("shard", F.pmod("order", parts)).sortWithinPartitions("shard", "order").select(*[F.col("row")[c].alias(c) for c in names])
