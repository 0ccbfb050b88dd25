"""Audit of how sources differ in their words: each source against each other one of its language, and its telling terms.

A language keeps the terms in at least `LEAST_DOCS` of its documents, V of them. A source's share of a term is, in parts of
`PARTS`, p = 1 + floor(PARTS (count + 1) / (N + V)), N its count of all kept terms; q is another source's, or the whole
language's. Their divergence at the term is floor((p - q)^2 / q), a whole number, as all numbers are here.

Summed over all kept terms for all pairs of sources, most of the work would be for terms that one or none of the two has.
A source has one share p0 of all terms that it doesn't have. So a sum begins with V f(p0_s, p0_r), as if no source had any
term, and terms put it right. Heavy ones, which more than a part in `HEAVY` of the language's sources have, lie in dense
tiles: the shares of some terms in all sources, of which NumPy takes all pairs at once. Light ones are split by who has them:

    for the terms of s: f(p_s, p0_r) - f(p0_s, p0_r)         (by s's counts, of which few differ)
    for the terms of r: f(p0_s, p_r) - f(p0_s, p0_r)         (by r's counts)
    for the terms of both: f(p_s, p_r) - f(p_s, p0_r) - f(p0_s, p_r) + f(p0_s, p0_r)

and only the last line looks at pairs, those within a term's postings. They are added up where the term lies, and only
sums leave the task. All parts are 64-bit integers and exact, in any order.

Tiles hold `TILE_TERMS` terms of one language; sources beyond `CHUNK` are cut into chunks, and a tile is looked at for
each pair of chunks, so no task holds more than two chunks. Words are counted where the documents lie; what a task has
counted goes on when it has `HELD` terms, so counts are combined before the shuffle and memory is bounded.

Defined results: null text, language and source count as the empty string; repeated rows count each; every group has
rows, even if its documents have no terms; a language with one source has no pairs; V = 0 gives pairs of value 0 and no
terms; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import checkpointed, require, small_parts
from scanloom.sources.tables import LoopTables

LEAST_DOCS, PARTS, TOP = 3, 1_000_000_000, 200
#: Terms in more than one of so many sources are heavy; terms of a tile, sources of a chunk, terms held by a task.
HEAVY, TILE_TERMS, CHUNK, HELD = 4, 512, 512, 400_000
#: Runs of letters and of what lies beyond ASCII, in bytes with A-Z in lower case.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Bytes of a text that are split at once.
PIECE_BYTES = 4 << 20


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in parts that end between terms."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(data) and _TERM.match(data, end):
            end = _TERM.match(data, end).end()
        yield data[at:end]
        at = end
    yield data[at:]


def term_counts(docs: DataFrame) -> DataFrame:
    """docs: lang, source, text. lang, source, term, n and docs by task; each group has a row with a null term too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for (lang, source), (n, docs) in held.items():
                for column, values in zip(columns, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [*n, None], [*n.values(), 0], [*map(docs.__getitem__, n), 0]), strict=True):
                    column.extend(values)
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for part in small_parts(iter([batch]), 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    before, data = len(n), text.as_buffer().to_pybytes().lower()
                    own: set[bytes] = set()
                    for piece in _pieces(data):
                        terms = _TERM.findall(piece)
                        n.update(terms)
                        own.update(terms)
                    seen.update(own)
                    size += len(n) - before
                    if size > HELD:
                        yield rows()
                        held.clear()
                        size = 0
        if held:
            yield rows()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS (n + 1) / (total + kept)); in decimals, as the product may exceed 64 bits."""
    product = (n + 1).cast("decimal(19,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", product, (total + kept).cast("decimal(19,0)"))


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


#: Kinds of rows of a tile: a source and its p0, a heavy term's count, a light one's, and a number of light terms with one count.
SOURCE, HEAVY_TERM, LIGHT_TERM, LIGHT_COUNTS = range(4)


def _sums_of_tile(key: tuple, rows: pa.Table) -> pa.Table:
    """rows: kind, term, place, chunk, p, p0, weight. Partial sums of all pairs of a source of chunk a and one of chunk b."""
    lang, a, b = key[0].as_py(), key[2].as_py(), key[3].as_py()
    kind, place, chunk, p, p0, weight = (rows.column(c).to_numpy() for c in ("kind", "place", "chunk", "p", "p0", "weight"))
    term = rows.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    sides = []
    for side in (a, b):
        own = np.flatnonzero((kind == SOURCE) & (chunk == side))
        own = own[np.argsort(place[own])]
        sides.append((place[own], p0[own]))
    (left, left_p0), (right, right_p0) = sides
    sums = np.zeros((left.size, right.size), np.int64)

    heavy = np.flatnonzero(kind == HEAVY_TERM)
    if heavy.size:
        codes = np.unique(term[heavy])
        dense = []
        for side, (places, base) in zip((a, b), sides, strict=True):
            own = heavy[chunk[heavy] == side]
            shares = np.repeat(base[None], codes.size, axis=0)
            shares[np.searchsorted(codes, term[own]), np.searchsorted(places, place[own])] = p[own]
            dense.append(shares)
        for i in range(left.size):
            sums[i] += _divergence(dense[0][:, i : i + 1], dense[1]).sum(axis=0) - codes.size * _divergence(left_p0[i], right_p0)

    light = np.flatnonzero(kind == LIGHT_TERM)
    light = light[np.argsort(term[light], kind="stable")]
    apart = 1
    while (first := np.flatnonzero(term[light[:-apart]] == term[light[apart:]]) if light.size > apart else light[:0]).size:
        for s, r in ((light[first], light[first + apart]), (light[first + apart], light[first])):
            wanted = (chunk[s] == a) & (chunk[r] == b)
            s, r = s[wanted], r[wanted]
            more = _divergence(p[s], p[r]) - _divergence(p[s], p0[r]) - _divergence(p0[s], p[r]) + _divergence(p0[s], p0[r])
            np.add.at(sums, (np.searchsorted(left, place[s]), np.searchsorted(right, place[r])), more)
        apart += 1

    counted = np.flatnonzero(kind == LIGHT_COUNTS)
    for x in counted[chunk[counted] == a].tolist():
        i = int(np.searchsorted(left, place[x]))
        sums[i] += weight[x] * (_divergence(p[x], right_p0) - _divergence(p0[x], right_p0))
    for x in counted[chunk[counted] == b].tolist():
        j = int(np.searchsorted(right, place[x]))
        sums[:, j] += weight[x] * (_divergence(left_p0, p[x]) - _divergence(left_p0, p0[x]))
    if key[1].as_py() < 0:  # the tile of the counts: what all terms would give if no source had any; weight: their number
        sums += int(weight[kind == SOURCE].max(initial=0)) * _divergence(left_p0[:, None], right_p0[None])

    i, j = np.nonzero(left[:, None] != right[None])
    return pa.table([pa.array([lang] * i.size, pa.string()), pa.array(left[i].astype(np.int32)), pa.array(right[j].astype(np.int32)), pa.array(sums[i, j])], ["lang", "s", "r", "value"])


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: in the part `pair` each other source of the language and the divergence of
    source from it over all kept terms; in the part `term` the source's `top` terms of the largest divergence from the
    language among those that are more frequent in the source."""
    require(docs, text_column, lang_column, source_column)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))])
    with LoopTables(docs.sparkSession) as kept:
        # a term's counts of all sources meet in one partition, where they are summed first; so the sums over sources, and
        # what goes for being rare, need no other shuffle
        counts = term_counts(named).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("n_lang"), F.count(F.lit(1)).over(of_term).alias("sources"), (F.min("source").over(of_term) == F.col("source")).alias("first"))
        counts = kept.put("counts", counts.filter(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).drop("in_docs"))

        is_term, of_lang = F.col("term").isNotNull(), Window.partitionBy("lang")
        groups = counts.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(is_term, F.col("n"))), F.lit(0)).alias("total"), F.count(F.when(is_term & F.col("first"), 1)).alias("firsts"))
        places = F.row_number().over(of_lang.orderBy("source")) - 1
        groups = groups.select("lang", "source", "total", F.sum("firsts").over(of_lang).alias("kept"), F.sum("total").over(of_lang).alias("total_lang"), F.count(F.lit(1)).over(of_lang).alias("n_sources"), places.cast("int").alias("place"))
        zero = F.lit(0).cast("long")
        p0 = F.when(F.col("kept") > 0, _share(zero, F.col("total"), F.col("kept"))).otherwise(F.lit(1).cast("long"))
        groups = kept.put("groups", groups.withColumns({"p0": p0, "chunk": F.floor(F.col("place") / CHUNK).cast("int")}))

        rows = counts.filter(is_term).join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
        q = _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
        excess = rows.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).filter("p > q")
        value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        terms = excess.select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)

        rows = kept.put("shares", rows.select("lang", "term", "n", "place", "chunk", "p", "p0", "n_sources", F.greatest(F.ceil(F.col("kept") / TILE_TERMS), F.lit(1)).cast("int").alias("tiles"), (F.col("sources") * HEAVY > F.col("n_sources")).alias("heavy")).filter("n_sources > 1"))
        none = F.lit(None).cast("string")
        parts = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), F.when(F.col("heavy"), HEAVY_TERM).otherwise(LIGHT_TERM).alias("kind"), "term", "place", "chunk", "p", "p0", zero.alias("weight"), "n_sources")
        light = rows.filter("not heavy")
        same = light.groupBy("lang", "place", "chunk", "p", "p0", "n_sources").agg(F.count(F.lit(1)).alias("weight"))
        same = same.select("lang", F.lit(-1).alias("tile"), F.lit(LIGHT_COUNTS).alias("kind"), none.alias("term"), "place", "chunk", "p", "p0", "weight", "n_sources")
        there = groups.filter("n_sources > 1").withColumn("tile", F.explode(F.sequence(F.lit(-1), F.ceil(F.col("kept") / TILE_TERMS).cast("int") - 1)))
        there = there.select("lang", "tile", F.lit(SOURCE).alias("kind"), none.alias("term"), "place", "chunk", F.col("p0").alias("p"), "p0", F.col("kept").alias("weight"), "n_sources")
        chunks = F.sequence(F.lit(0), F.floor((F.col("n_sources") - 1) / CHUNK).cast("int"))
        meets = F.array_distinct(F.concat(F.transform(chunks, lambda c: F.struct(F.col("chunk").alias("a"), c.alias("b"))), F.transform(chunks, lambda c: F.struct(c.alias("a"), F.col("chunk").alias("b")))))
        met = parts.unionByName(same).unionByName(there).withColumn("meet", F.explode(meets)).select("lang", "tile", "meet.a", "meet.b", "kind", "term", "place", "chunk", "p", "p0", "weight")
        sums = met.groupBy("lang", "tile", "a", "b").applyInArrow(_sums_of_tile, "lang string, s int, r int, value long").groupBy("lang", "s", "r").agg(F.sum("value").alias("value"))
        names = groups.select("lang", "place", "source")
        pairs = sums.join(names.withColumnRenamed("place", "s"), ["lang", "s"]).join(names.select("lang", F.col("place").alias("r"), F.col("source").alias("item")), ["lang", "r"])
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
        return checkpointed(pairs.unionByName(terms))
