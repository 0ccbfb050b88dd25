"""Benchmark decontamination: windows of the test items' words are looked for in all documents.

Words are runs of digits, letters a to z after A-Z are made small, and all characters beyond ASCII. A window is `WINDOW`
consecutive words of an item; an item of fewer words, but not none, is one window. The hashes of all windows are a set
that is broadcast; documents are scanned where they lie, so they aren't shuffled. A scan works on the bytes of many texts at
once: word hashes come from running sums of a polynomial over bytes, window hashes from those of the words. A bit table
passes by nearly all windows, the sorted hashes find the rest, and each of these is verified by its words. What is hit
can be reported, cut out of the text, or the document dropped.

What is broadcast is bounded: items are cut into pieces of `PIECE` windows, and pieces are dealt to slices of at most about
`SLICE` windows, some 50 bytes each. One slice is the rule; more are scanned one after another, and their hits, of which
only documents with some have rows, are put together by a document's id and text.

Defined results: a null or blank text has no words, whether of a document or an item; items that repeat an id are one
item; a null item id counts as the empty string; repeated documents get equal results; null ids stay; an empty table of
items hits nothing; an empty table of documents gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scanloom.llm.common import checkpointed, require, small_parts, text_or_empty

WINDOW = 10
#: Windows of a piece of an item, and of all pieces that are broadcast at once.
PIECE, SLICE = 4096, 1_000_000
#: Bytes of text that are looked at at once, and places in the bit table for each window.
CHUNK_BYTES, SPREAD = 1 << 20, 64

#: Each byte as a word has it, or 0 for those between words.
_KINDS = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_FACTOR, _INVERSE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, n of them at least."""
    size = max(CHUNK_BYTES + 1, 1 << n.bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_FACTOR, _INVERSE))
    return _powers[size]


def _hashed(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by a running sum over the bytes."""
    powers, inverse = _power_tables(kinds.size)
    sums = np.zeros(kinds.size + 1, np.uint64)
    np.cumsum(kinds * powers[: kinds.size], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of several texts that lie behind one another: kinds has their bytes as words have them, starts and ends
    are places of words in it, hashes theirs, first the number of each text's first word, with one more at the end."""

    kinds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.kinds[s:e].tobytes() for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all n consecutive words, and whether they lie in one text."""
        count = max(0, self.hashes.size - n + 1)
        h = np.zeros(count, np.uint64)
        for i in range(n):
            h = h * np.uint64(_STEP) + self.hashes[i : i + count]
        inside = np.ones(count, bool)
        for border in self.first[1:-1]:
            inside[max(0, border - n + 1) : border] = False
        return h ^ (h >> np.uint64(31)), inside


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: bytes; offsets: where each text starts, with one more at the end."""
    kinds = _KINDS[data]
    is_word = kinds != 0
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < data.size)]
    starts[borders] = is_word[borders]
    ends[borders - 1] = is_word[borders - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    parts, low = [], 0
    while low < starts.size:  # words of about CHUNK_BYTES, one at least
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + CHUNK_BYTES, side="right")))
        origin, stop = starts[low], ends[high - 1]
        parts.append(_hashed(kinds[origin:stop], starts[low:high] - origin, ends[low:high] - origin))
        low = high
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return Words(kinds, starts, ends, hashes, np.searchsorted(starts, offsets))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts in them; nulls are empty."""
    filled = pa.array(texts).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2], np.uint8) if filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class WindowSet:
    """Windows by hash, in its order: the number of their words, their words, and their items' names, an array for each.
    Windows of equal words are one."""

    hashes: np.ndarray
    lengths: np.ndarray
    texts: list[bytes]
    items: list[tuple[str, ...]]

    @cached_property
    def table(self) -> np.ndarray:
        bits = max(10, (SPREAD * max(1, self.hashes.size)).bit_length())
        table = np.zeros(1 << min(bits, 26), bool)
        table[self._place(self.hashes, table.size)] = True
        return table

    @cached_property
    def sizes(self) -> list[int]:
        return np.unique(self.lengths).tolist()

    @staticmethod
    def _place(hashes: np.ndarray, size: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def found(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(place of the first word, number of words, number of the window) of each occurrence."""
        for n in self.sizes:
            hashes, inside = words.windows(n)
            places = np.flatnonzero(self.table[self._place(hashes, self.table.size)] & inside)
            first = np.searchsorted(self.hashes, hashes[places])
            there = first < self.hashes.size
            there[there] = self.hashes[first[there]] == hashes[places[there]]
            for at, low in zip(places[there].tolist(), first[there].tolist(), strict=True):
                own = words.text(at, n)
                while low < self.hashes.size and self.hashes[low] == hashes[at]:
                    if own == self.texts[low]:
                        yield at, n, low
                        break
                    low += 1


def _pieces(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """item, piece, n (windows) and words: items cut into pieces that overlap by all but one word of a window."""
    step = PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1):
            rows: tuple[list, ...] = ([], [], [], [])
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words_of(*_bytes_of(pa.array([text.as_py()], pa.string())))
                count = own.starts.size
                for piece, at in enumerate(range(0, max(1, count - window + 1) if count else 0, step)):
                    n = min(step + window - 1, count - at)
                    for column, value in zip(rows, (item, piece, max(1, n - window + 1), own.text(at, n)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["item", "piece", "n", "words"])

    texts = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), text_or_empty(text_column).alias("text"))
    return texts.mapInArrow(cut, "item string, piece int, n long, words binary")


def window_set(pieces: list[tuple[str, bytes]], window: int = WINDOW) -> WindowSet:
    """pieces: an item's name and its words, with a blank between."""
    known: dict[bytes, tuple[int, int, set[str]]] = {}
    for item, text in pieces:
        words = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        n = min(window, words.starts.size)
        for at, h in enumerate(words.windows(n)[0].tolist()):
            own = text[words.starts[at] : words.ends[at + n - 1]]
            known.setdefault(own, (h, n, set()))[2].add(item)
    order = sorted(known, key=lambda t: known[t][:2])
    return WindowSet(np.array([known[t][0] for t in order], np.uint64), np.array([known[t][1] for t in order], np.int64), order, [tuple(sorted(known[t][2])) for t in order])


def _slices(benchmark: DataFrame, id_column: str, text_column: str, window: int, most: int) -> tuple[DataFrame, int]:
    """The items' pieces with slice, and how many slices of about `most` windows there are."""
    pieces = checkpointed(_pieces(benchmark, id_column, text_column, window))
    parts = 1 + (pieces.agg(F.sum("n")).first()[0] or 0) // most
    return pieces.withColumn("slice", F.pmod(F.xxhash64("item", "piece"), F.lit(parts))), parts


def _slice(pieces: DataFrame, nth: int, window: int) -> WindowSet:
    own = pieces.filter(F.col("slice") == nth).select("item", "words")
    return window_set([(r["item"], bytes(r["words"])) for r in own.toLocalIterator()], window)  # about `most` windows


def _scan(rows: DataFrame, windows: WindowSet) -> DataFrame:
    """rows: carried and text. carried, n_words, hits (the first and the end of each run of words that are hit, one behind
    the other) and items."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_parts(batches, 1):
            words = words_of(*_bytes_of(batch.column(1)))
            inside, items = np.zeros(words.starts.size + 1, np.int64), {}
            for at, n, nth in known.found(words):
                inside[at] += 1
                inside[at + n] -= 1
                items.setdefault(int(np.searchsorted(words.first, at, side="right")) - 1, set()).add(nth)
            hit = np.cumsum(inside[:-1]) > 0
            runs = []
            for text, (low, high) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if text in items:
                    edges = np.diff(np.concatenate([[0], hit[low:high].astype(np.int8), [0]]))
                    runs.append(np.flatnonzero(edges).tolist())
                else:
                    runs.append([])
            names = [sorted({i for nth in items[t] for i in known.items[nth]}) if t in items else [] for t in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["carried", "n_words", "hits", "items"])

    return rows.select("carried", "text").mapInArrow(scan, f"carried {dict(rows.dtypes)['carried']}, n_words long, hits array<long>, items array<string>")


def _merged(a: str, b: str) -> Column:
    """Two lists of runs as one: runs in the order of their starts, those that meet joined."""
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.get(c, 2 * i).alias("low"), F.get(c, 2 * i + 1).alias("high")))
    every = F.array_sort(F.filter(F.concat(pairs(F.col(a)), pairs(F.col(b))), lambda p: p["low"].isNotNull()))
    none = F.array().cast("array<bigint>")
    last = lambda s: F.element_at(s, -1)
    grown = lambda s, p: F.when((F.size(s) > 0) & (last(s) >= p["low"]), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.greatest(last(s), p["high"])))).otherwise(F.concat(s, F.array(p["low"], p["high"])))
    return F.aggregate(every, none, grown)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, most: int = SLICE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: carried (a struct of the id, or of the columns in carry), n_words, hits (the first word and
    the end of each run of words that are hit, in words from 0, one behind the other), n_hit and items (their ids as text,
    in order)."""
    require(docs, id_column, text_column, *carry)
    require(benchmark, item_column, item_text_column)
    pieces, parts = _slices(benchmark, item_column, item_text_column, window, most)
    rows = docs.select(F.struct(*(carry or (id_column,))).alias("carried"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    if parts == 1:
        return _with_counts(_scan(rows, _slice(pieces, 0, window)))
    # rows are told apart by id and text: equal ones have equal hits
    rows = rows.select(F.struct("carried", "id", F.xxhash64("text").alias("h")).alias("carried"), "text")
    found = checkpointed(_scan(rows, _slice(pieces, 0, window)))
    for nth in range(1, parts):
        some = _scan(rows.select(F.struct("carried.id", "carried.h").alias("carried"), "text"), _slice(pieces, nth, window)).filter(F.size("hits") > 0)
        some = some.select(F.col("carried.id").alias("other_id"), F.col("carried.h").alias("other_h"), F.col("hits").alias("more"), F.col("items").alias("more_items")).dropDuplicates(["other_id", "other_h"])
        both = found.join(some, (F.col("carried.h") == F.col("other_h")) & F.col("carried.id").eqNullSafe(F.col("other_id")), "left")
        items = F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>"))))
        found = checkpointed(both.select("carried", "n_words", F.when(F.col("more").isNull(), F.col("hits")).otherwise(_merged("hits", "more")).alias("hits"), items.alias("items")))
    return _with_counts(found.withColumn("carried", F.col("carried.carried")))


def _with_counts(found: DataFrame) -> DataFrame:
    signs = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return found.select("carried", "n_words", "hits", F.aggregate(signs, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_hit"), "items")


def without_runs(text: str | None, hits: list[int]) -> str | None:
    """The text without what lies from the first to the last word of each run."""
    if not hits:
        return text
    data = text.encode()
    words = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    edges = [0, *(int(words.ends[x - 1] if i % 2 else words.starts[x]) for i, x in enumerate(hits)), len(data)]
    return b"".join(data[low:high] for low, high in zip(edges[::2], edges[1::2], strict=True)).decode()


@F.arrow_udf(StringType())
def _without_runs(texts: pa.Array, hits: pa.Array) -> pa.Array:
    return pa.array([without_runs(t.as_py(), h.as_py()) for t, h in zip(texts, hits, strict=True)], pa.string())


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", spans: bool = False, window: int = WINDOW, most: int = SLICE) -> DataFrame:
    """docs, with all their columns, without the documents that are hit; or, with spans, without the runs of words that
    are, and all documents stay."""
    names = tuple(docs.columns)
    found = find_contamination(docs, benchmark, id_column, text_column, item_column, item_text_column, window, most, carry=names)
    own = lambda c: F.col("carried")[c]
    if not spans:
        return found.filter("n_hit = 0").select(*[own(c).alias(c) for c in names])
    return found.select(*[(_without_runs(own(c), F.col("hits")) if c == text_column else own(c)).alias(c) for c in names])
