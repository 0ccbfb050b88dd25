"""Cross-entropy difference of documents: loss under a model of target text less that under a model of all text.

Both are word bigram models with one vocabulary, that of the corpus, and one smoothing: a bigram's chance is smoothed by
its word's, and that by the chance of a word that the corpus has once. They are matched in size too: the background's
counts are scaled to as many words as the target has, so neither is smoother than the other. The target's text are the
documents with an id of the targets; the background's are all documents. A score below zero says that a document is more
like the target than like the corpus.

Nothing is cut from the models: every word and every pair of words is counted, so they grow with the corpus, and they
are never in one place. Documents are dealt out in blocks of a few megabytes, by their id; the targets' ids go the same
way, so no text is moved for labels. A block asks for each of its words and pairs once, whatever its copies: its keys
(hashes, 48 bits besides those that make the range), sorted, with its own counts, lie in one array per key range. A key range adds up what all blocks have,
and answers each with what the others have, in the order asked. A frequent word is asked once a block, so no key is hot.
Documents are then scored where their block lies; it was shuffled once, for both steps.

Defined results: a null, empty or blank text has no tokens and all its numbers are 0; null ids have no label; if an id
is listed several times, it counts once; without any target all scores are 0; repeated rows count each and get equal
results; an id with very many rows is dealt out over several blocks; an empty table gives an empty result; other columns
play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import WORD, checkpointed, require, text_or_empty

#: How many observations the lower order counts for.
SMOOTHING = 5.0
#: Digits of the results, so that the order of sums doesn't show.
DIGITS = 9
#: Characters of text in a block, and keys asked for in a range at most, on average.
BLOCK_CHARS, RANGE_KEYS = 8 << 20, 1 << 20
#: Bytes of a key that tell it from the others of its range.
KEY_BYTES = 6
#: The word before the first one.
START = np.uint64(0)


@dataclass(frozen=True)
class Totals:
    """Words of the corpus and of the target's documents."""

    words: int
    target_words: int


def words_of(text: str | None) -> np.ndarray:
    """The hashes of a text's words, in order; words stand between ASCII white space."""
    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key for each word w after the word v; the order of the two matters."""
    x = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Block:
    """A block's documents as places in the sorted list of its keys: those of the words before, the words, the pairs."""

    keys: np.ndarray
    own: np.ndarray
    own_target: np.ndarray
    doc: np.ndarray
    before: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    n_tokens: np.ndarray


def block_of(texts: list[str | None], is_target: np.ndarray) -> Block:
    each = [words_of(t) for t in texts]
    n_tokens = np.array([len(x) for x in each], np.int64)
    w = np.concatenate([*each, np.empty(0, np.uint64)])
    doc, v = np.repeat(np.arange(len(each)), n_tokens), np.concatenate(([START], w[:-1])) if w.size else w
    first = (np.cumsum(n_tokens) - n_tokens)[n_tokens > 0]
    v[first] = START
    # a word's count is also that of the pairs it begins, the end of a text being the last of them
    asked = np.concatenate((w, np.full(first.size, START), pair_keys(v, w)))
    keys, places = np.unique(asked, return_inverse=True)
    of_target = np.concatenate((is_target[doc], is_target[n_tokens > 0], is_target[doc]))
    counts = lambda x: np.bincount(x, minlength=keys.size).astype(np.int64)
    word, pair = places[: w.size], places[w.size + first.size :]
    before = np.concatenate(([0], word[:-1])) if w.size else word
    before[first] = np.searchsorted(keys, START)
    return Block(keys, counts(places), counts(places[of_target]), doc, before, word, pair, n_tokens)


def losses(block: Block, background: np.ndarray, target: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sum of losses under the target's and under the background's counts of the block's keys."""
    size, least = totals.target_words or totals.words, 1 / (totals.words + 1)

    def of(counts: np.ndarray, times: float) -> np.ndarray:
        one = (counts[block.word] * times + SMOOTHING * least) / (size + SMOOTHING)
        chance = (counts[block.pair] * times + SMOOTHING * one) / (counts[block.before] * times + SMOOTHING)
        return np.bincount(block.doc, -np.log(chance), len(block.n_tokens))

    in_background = of(background, size / max(1, totals.words))
    return (of(target, 1.0) if totals.target_words else in_background), in_background


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits ranges of all keys begins in sorted keys, and the end."""
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
    return np.concatenate(([0], np.searchsorted(keys, borders), [keys.size])).astype(np.int64)


def _packed_keys(keys: np.ndarray, bits: int) -> bytes:
    """Of keys of one range their next KEY_BYTES bytes, those after the range's own bits."""
    return (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(">u8")[:, 0].astype(np.uint64)


def _packed_counts(counts: np.ndarray) -> tuple[bytes, list[int]]:
    """A byte a count, for most are small, and apart those that don't fit."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].tolist()


def _unpacked_counts(data: bytes, more: list[int]) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8).astype(np.int64)
    counts[counts == 255] = more
    return counts


def _dealt(docs: DataFrame, targets: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """block, id, text and is_doc: documents, and beside them the ids of targets, by block."""
    limit = max(1000, 4 * rows.count() // blocks)
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    hot = checkpointed(counts.select(F.col("id").alias("hot_id"), F.ceil(F.col("n") / limit).cast("int").alias("parts")))  # a quarter of `blocks` at most
    block = lambda part: F.pmod(F.xxhash64("id", part), F.lit(blocks)).cast("int").alias("block")
    ids = targets.select(F.col(targets.columns[0]).alias("id")).filter("id is not null").distinct()
    none, part = F.lit(0), F.lit(0)
    if not hot.isEmpty():
        meets = lambda df: df.join(F.broadcast(hot), F.col("id").eqNullSafe(F.col("hot_id")), "left")
        docs, ids = meets(docs), meets(ids).select("id", F.explode(F.sequence(none, F.coalesce(F.col("parts") - 1, none))).alias("part"))
        part = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")
    texts = docs.select(block(part), "id", "text", F.lit(True).alias("is_doc"))
    marks = ids.select(block(F.col("part") if "part" in ids.columns else none), "id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_doc"))
    return texts.unionAll(marks).repartition(blocks, "block")


def _parts(table: pa.Table) -> tuple[pa.Array, Block]:
    """The ids of a block's documents, and the block."""
    is_doc = table.column("is_doc").combine_chunks()
    docs, marked = table.filter(is_doc), set(table.filter(pc.invert(is_doc)).column("id").to_pylist())
    ids = docs.column("id").combine_chunks()
    return ids, block_of(docs.column("text").to_pylist(), np.array([i in marked for i in ids.to_pylist()], bool))


def _of(n: np.ndarray, t: np.ndarray) -> dict[str, bytes | list[int]]:
    (n, more_n), (t, more_t) = _packed_counts(n), _packed_counts(t)
    return {"n": n, "more_n": more_n, "t": t, "more_t": more_t}


def score_documents(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, target_loss and background_loss (means over tokens), score (their difference)."""
    require(docs, id_column, text_column)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = dict(docs.dtypes)["id"]
    rows = checkpointed(docs.select("id", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("words"), F.length(text_or_empty("text")).cast("long").alias("chars")))
    every = rows.agg(F.sum("words").alias("words"), F.sum("chars").alias("chars")).first()
    of_target = rows.join(targets.select(F.col(targets.columns[0]).alias("id")).distinct(), "id", "left_semi").agg(F.sum("words")).first()[0]
    totals = Totals(every["words"] or 0, of_target or 0)
    blocks, bits = 1 + (every["chars"] or 0) // BLOCK_CHARS, (totals.words // RANGE_KEYS).bit_length()
    dealt = _dealt(docs, targets, rows, blocks)

    packed = {"block": pa.int32(), "range": pa.int32(), "n": pa.binary(), "more_n": pa.list_(pa.int64()), "t": pa.binary(), "more_t": pa.list_(pa.int64())}

    def ask(table: pa.Table) -> pa.Table:
        block, at = _parts(table)[1], table.column("block")[0].as_py()
        cuts = _ranges(block.keys, bits).tolist()
        some = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        rows = [{"block": at, "range": i, "keys": _packed_keys(block.keys[s], bits), **_of(block.own[s], block.own_target[s])} for i, s in some]
        return pa.Table.from_pylist(rows, pa.schema({**packed, "keys": pa.binary()}))

    def answer(asked: pa.Table) -> pa.Table:
        asked = asked.to_pylist()
        ends = np.cumsum([0, *(len(r["n"]) for r in asked)]).tolist()
        places = np.unique(_unpacked_keys(b"".join(r["keys"] for r in asked)), return_inverse=True)[1]
        others = []
        for name in ("n", "t"):
            own = np.concatenate([_unpacked_counts(r[name], r[f"more_{name}"]) for r in asked])
            others.append(np.bincount(places, own).astype(np.int64)[places] - own)
        rows = [{"block": r["block"], "range": r["range"], **_of(*(x[a:b] for x in others))} for r, a, b in zip(asked, ends[:-1], ends[1:], strict=True)]
        return pa.Table.from_pylist(rows, pa.schema(packed))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("id", table.schema.field("id").type), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()))})
        ids, block = _parts(table)
        answers = answers.sort_by("range").to_pylist()
        n, t = (np.concatenate([_unpacked_counts(r[c], r[f"more_{c}"]) for r in answers] or [np.empty(0, np.int64)]) for c in ("n", "t"))
        in_target, in_background = losses(block, block.own + n, block.own_target + t, totals)
        mean = lambda x: pa.array(x / np.maximum(block.n_tokens, 1))
        return pa.table([ids, pa.array(block.n_tokens), mean(in_target), mean(in_background)], ["id", "n_tokens", "target_loss", "background_loss"])

    columns = "block int, range int, n binary, more_n array<long>, t binary, more_t array<long>"
    asked = dealt.groupBy("block").applyInArrow(ask, f"{columns}, keys binary")
    answers = asked.repartition(1 << bits, "range").groupBy("range").applyInArrow(answer, columns)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind}, n_tokens long, target_loss double, background_loss double")
    rounded = [F.round(c, DIGITS).alias(c) for c in ("target_loss", "background_loss")]
    return scored.select(F.col("id").alias(id_column), "n_tokens", *rounded, F.round(F.col("target_loss") - F.col("background_loss"), DIGITS).alias("score"))
