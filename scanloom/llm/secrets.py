"""Secrets in texts, by a trigram index and regular expressions.

From each rule's regular expression a Boolean query over trigrams is derived that every text with a match satisfies:
literals and small alternatives next to each other give trigrams that must all be there (AND), alternatives give a
choice (OR), and what can't be told gives no condition. Each few megabytes of a partition's documents are an index shard: one
pass over its bytes gives, for each trigram that some rule asks for, the sorted list of documents that hold it.
Lists are intersected and united as the query says, and the rule's regular expression checks the documents that are
left. A rule without a mandatory trigram is checked against all documents. Trigrams are of UTF-8 bytes with A-Z in
lower case, so rules that ignore case need no others.

Shards are partitions of documents, so nothing is shuffled and memory is bound by the batch.

Defined results: a null or empty text has no spans; repeated rows get equal results; null ids stay; an empty table
gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import require, small_parts


@dataclass(frozen=True)
class Rule:
    """group: the group whose length must be `least` or more (0: the whole match); shorter ones are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

#: A Boolean query: None asks for nothing, bytes for a trigram, ("and" | "or", queries) for all or one of them.
Query = None | bytes | tuple
#: No more alternatives than this are followed letter by letter.
MOST_STRINGS = 64


def _all_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _one_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _holds(strings: set[bytes]) -> Query:
    """What a text with one of these strings holds."""
    return _one_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(item: tuple) -> set[bytes] | None:
    """All strings that a part of an expression can match, with A-Z in lower case; None if they are many or unknown."""
    kind, value = item
    if kind is C.LITERAL:
        return {chr(value).encode().lower()}
    if kind is C.IN:
        chars = [value[0] for value in [x[1:] for x in value if x[0] is C.LITERAL]]
        return {chr(c).encode().lower() for c in chars} if len(chars) == len(value) <= 8 else None
    if kind is C.SUBPATTERN:
        return _all_strings(value[3])
    if kind is C.BRANCH:
        each = [_all_strings(x) for x in value[1]]
        return None if None in each else set().union(*each)
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[1] != C.MAXREPEAT and value[1] <= 8:
        once = _all_strings(value[2])
        if once is None or len(once) ** value[1] > MOST_STRINGS:
            return None
        found = [{b""}]
        for _ in range(value[1]):
            found.append({a + b for a in found[-1] for b in once})
        return set().union(*found[value[0] :])
    return {b""} if kind in (C.AT, C.ASSERT, C.ASSERT_NOT) else None


def _all_strings(parts) -> set[bytes] | None:
    found = {b""}
    for item in parts:
        if (more := _strings(item)) is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _query(parts) -> Query:
    needs, run = [], {b""}
    for kind, value in parts:
        more = _strings((kind, value))
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        needs.append(_holds(run))
        run = more if more is not None else {b""}
        if more is not None:
            continue
        if kind is C.SUBPATTERN:
            needs.append(_query(value[3]))
        elif kind is C.BRANCH:
            needs.append(_one_of([_query(x) for x in value[1]]))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            needs.append(_query(value[2]))
    return _all_of([*needs, _holds(run)])


def trigram_query(pattern: str) -> Query:
    """The trigrams that each text with a match holds, as a Boolean query; None if none is mandatory."""
    return _query(_parser.parse(pattern))


def trigrams_of(query: Query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@lru_cache(maxsize=1)
def _slots(wanted: tuple[bytes, ...]) -> np.ndarray:
    """For each possible trigram its place among the wanted ones, from 1; made once for a worker."""
    slots = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(wanted):
        slots[int.from_bytes(t, "big")] = i + 1
    return slots


@lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]) -> tuple[list[Query], tuple[bytes, ...], list[re.Pattern]]:
    """The rules' queries, all trigrams that they ask for, and their expressions."""
    queries = [trigram_query(r.pattern) for r in rules]
    return queries, tuple(sorted(set().union(*map(trigrams_of, queries)))), [re.compile(r.pattern) for r in rules]


class TrigramShard:
    """The postings of some trigrams in one shard's texts."""

    def __init__(self, texts: list[bytes], wanted: tuple[bytes, ...]) -> None:
        self.size, slots = len(texts), _slots(wanted)
        self.postings = {t: np.empty(0, np.int64) for t in wanted}
        ends = np.cumsum([len(t) + 3 for t in texts])
        data = FOLD[np.frombuffer(b"\0\0\0".join(texts) + b"\0\0\0", np.uint8)].astype(np.uint32)
        if data.size < 3 or not wanted:
            return
        found = slots[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * self.size + np.searchsorted(ends, at, side="right"))
        which, docs = pairs // self.size, pairs % self.size
        for i, t in enumerate(wanted):
            low, high = np.searchsorted(which, [i + 1, i + 2])
            self.postings[t] = docs[low:high]

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = sorted(map(self.candidates, query[1]), key=len)
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


def scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, (kind, start, end), by start and then by rule."""
    queries, wanted, compiled = _plan(rules)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    shard = TrigramShard([t.encode() for t in texts], wanted)
    for k, rule in enumerate(rules):
        for i in shard.candidates(queries[k]):
            for m in compiled[k].finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    return [[(rules[k].name, a, b) for a, k, b in sorted(x)] for x in found]


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: id and spans, an array of (kind, start, end) in code points, by start, then rule."""
    require(docs, id_column, text_column)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scan(texts, rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], ["id", "spans"])

    id_type = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(found, f"id {id_type}, spans array<struct<kind: string, start: int, end: int>>").withColumnRenamed("id", id_column)


def joined(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
