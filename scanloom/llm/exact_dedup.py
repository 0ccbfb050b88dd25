"""Exact dedup by content sort, with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has become one blank. Sampled splitters
(Spark's range partitioner) deal the documents out by the first bytes of the normalised text and a hash of all of it,
so that equal texts meet in one partition and a common opening doesn't fill one. The external sort of each partition
places equal texts next to each other, and the window compares neighbours in full before it gives them one keeper.

A text whose copies would overfill a partition is dealt out over several by a salt from its id; only its group's
least id and size, one row per salt, are then put together. There are at most 4 such texts per shuffle partition, a
bound that follows from the threshold, so they may be broadcast.

Defined results: a null text counts as empty; white space at the ends counts, as one blank; of repeated rows with
one id a single row is kept; a null id sorts last, so it is kept only in a group without any id; an empty table gives
an empty result. Other columns of the input play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import SPACES, checkpointed, require, shuffle_partitions, text_or_empty

#: Characters of the normalised text that the splitters see; the hash beside them tells longer texts apart.
SPLITTER_CHARS = 32
#: A text is hot when it has more copies than this share of an average partition's rows.
HOT_SHARE = 4
#: No text with fewer copies is hot.
LEAST_HOT = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def _hot_texts(rows: DataFrame, partitions: int) -> tuple[DataFrame | None, int]:
    """Hashes of texts with more copies than `limit`, with their counts: at most HOT_SHARE * partitions rows."""
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    limit = max(LEAST_HOT, rows.count() // (HOT_SHARE * partitions))
    hot = checkpointed(counts.filter(F.col("copies") > limit))
    return (hot if hot.limit(1).count() else None), limit


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and a struct `carried` of the columns in carry."""
    require(docs, id_column, text_column, *carry)
    partitions = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    keyed = rows.withColumn("norm", normalised(F.col("text"))).select("*", F.substring("norm", 1, SPLITTER_CHARS).alias("opening"), F.xxhash64("norm").alias("h")).drop("norm")
    hot, limit = _hot_texts(keyed, partitions)
    salted, keys = keyed, ["opening", "h"]  # the window asks for these too, so it needs no exchange of its own
    if hot is not None:
        keys.append("salt")
        salted = keyed.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("copies").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / limit))).cast("int")).drop("copies")
    dealt = salted.repartitionByRange(*keys).withColumn("norm", normalised(F.col("text"))).drop("text")
    equal = Window.partitionBy(*keys, "norm")
    ordered = equal.orderBy(F.col("id").asc_nulls_last())
    found = dealt.select(
        "id",
        *(["carried"] if carry else []),
        F.first("id").over(ordered).alias("keep_id"),
        F.row_number().over(ordered).alias("place"),
        F.count(F.lit(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    if hot is not None:
        whole = (
            salted.filter("salt > 0")
            .select(normalised(F.col("text")).alias("norm"), "id")
            .groupBy("norm")
            .agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("size"))
            .select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "least_id", "size")
        )
        found = (
            found.join(F.broadcast(checkpointed(whole)), "text_sha256", "left")
            .withColumn("place", F.when(F.col("least_id").isNull() | F.col("keep_id").eqNullSafe(F.col("least_id")), F.col("place")).otherwise(F.lit(0)))
            .withColumn("keep_id", F.coalesce("least_id", "keep_id"))
            .withColumn("group_size", F.coalesce("size", "group_size"))
        )
    return found.select(F.col("id").alias(id_column), "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256", *(["carried"] if carry else []))


def keep_first_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one with the smallest id; all columns stay."""
    names = tuple(docs.columns)
    return exact_duplicates(docs, id_column, text_column, carry=names).filter("kept").select(*[F.col("carried")[c].alias(c) for c in names])
