"""Near duplicates by SimHash and multi-index hashing.

A text's fingerprint has 64 bits; each is the majority of that bit over the hashes of the text's 3-word shingles. Two
fingerprints within 3 bits agree in one of their 32-bit halves but for one bit at most. So each distinct fingerprint
goes into a table by either half, and probes it with the halves in the Hamming ball of radius 1 around its own. Of
such a ball only the half itself and those with one set bit cleared need be asked for: of two halves that differ in
one bit, the one with that bit set finds the other. Complete distances are checked in the join itself, and a pair
that the upper halves find is not found again by the lower ones.

Equal fingerprints become one row first, by a grouped minimum that is combined before the shuffle, so a text with
very many copies costs no more than another. Links between distinct fingerprints are then joined to components.

Defined results: a null, empty or blank text has fingerprint zero, which links like any other; a text of one or two
words is one shingle; null ids belong to their text's group but are never its least id; rows with one id and one text
stay or go together; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scanloom.llm.common import checkpointed, require
from scanloom.llm.components import components

SHINGLE_WORDS, SEED, BITS, MAX_DISTANCE = 3, 42, 64, 3
#: Shingles whose bits are counted at once.
COUNTED_AT_ONCE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    counts = np.zeros(BITS, np.int64)
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, COUNTED_AT_ONCE):
        hashes = np.array([hash_of(join(words[i : i + SHINGLE_WORDS]), SEED) for i in range(at, min(n, at + COUNTED_AT_ONCE))], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


@F.arrow_udf(LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def similar_pairs(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """distinct: one column fp of distinct fingerprints. Gives each pair (a, b) within max_distance bits once."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two halves find pairs within 3 bits at most")
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    half = F.explode(F.array(upper, lower.bitwiseOR(F.lit(1 << 32))))  # bit 32 tells the halves apart
    table = distinct.select(F.col("fp").alias("b"), half.alias("key"))
    one = F.lit(1).cast("long")
    places = F.array(*[F.lit(i) for i in range(32 if max_distance > 1 else 0)]).cast("array<int>")
    set_bits = F.filter(places, lambda i: F.call_function("shiftright", F.col("half"), i).bitwiseAND(one) == 1)
    ball = F.concat(F.array(F.col("half")), F.transform(set_bits, lambda i: F.col("half").bitwiseXOR(F.call_function("shiftleft", one, i))))
    probes = distinct.select(F.col("fp").alias("a"), half.alias("half")).select("a", "half", F.explode(ball).alias("key"))
    found = probes.join(table, "key").filter(_distance("a", "b") <= max_distance)
    found = found.filter((F.col("half") != F.col("key")) | (F.col("a") < F.col("b")))
    upper_finds = F.bit_count(F.shiftrightunsigned("a", 32).bitwiseXOR(F.shiftrightunsigned("b", 32))) <= max_distance // 2
    return found.filter((F.col("key") < (1 << 32)) | ~upper_finds).select("a", "b")


def _with_components(rows: DataFrame, max_distance: int) -> DataFrame:
    """rows (id, fp and more) with component_id and the component's root fingerprint."""
    groups = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = components(similar_pairs(groups.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(checkpointed(rooted.join(least, "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of docs: id, fp (long) and component_id, the least id of all that are linked, over any number of links."""
    require(docs, id_column, text_column)
    rows = checkpointed(docs.select(F.col(id_column).alias("id"), fingerprints(text_column).alias("fp")))
    return _with_components(rows, max_distance).select(F.col("id").alias(id_column), "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the least id; all columns stay.

    Only ids and hashes are grouped; whole documents are read once more and those that go are taken out by a left anti
    join, which Spark makes a broadcast if they turn out to be few."""
    require(docs, id_column, text_column)
    rows = checkpointed(docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("h"), fingerprints(text_column).alias("fp")))
    return keep_least_of_each(docs, _with_components(rows, max_distance), id_column, text_column)


def keep_least_of_each(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs without the rows of found (id, h, the hash of the text, and root) that aren't the least of their root."""
    names, text_hash = docs.columns, F.xxhash64(F.col(text_column))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("kept"))
    goes = found.join(kept, "root").filter(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("h") == F.col("kept.h")))).select("id", "h")
    carried = docs.select(F.struct(*names).alias("row"), F.col(id_column).alias("own_id"), text_hash.alias("own_h"))
    stay = carried.join(checkpointed(goes.distinct()), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h")), "left_anti")
    return stay.select(*[F.col("row")[c].alias(c) for c in names])
