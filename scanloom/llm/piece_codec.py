"""SentencePiece BPE encoding and decoding by a prefix table.

For each prefix of a run of text the table stores the last token of its encoding, which is unique: of the pieces that
end there (found by walking a trie from every position) it is the one that may follow the last token of the prefix
before it, that is, the one for which the two tokens' joint text encodes to just these two. The ids are then read
backwards from the last prefix. Merges of a pair depend on the two tokens only: either side's own merges come in an
order that is known beforehand, and the pair holds if no merge over the border ever comes first.

Runs: no piece holds a word separator after another character, so a text is cut before each separator that follows
one, and short runs that come again are looked up. New runs of a batch are encoded together, array by array, one
position at a time; long ones one by one, prefix by prefix, so their cost grows with their length only. Texts of any
length are handled in parts, cut where a run begins, and what is remembered has a bound in bytes: when half of it is full,
the other half is forgotten, but for the runs that have come again meanwhile. Texts are decoded from their ids alone.

Normalisation is that of the model: blanks become separators and one is put in front. Characters outside the
vocabulary become their bytes. Models with other normalisation rules, with user-defined pieces, or of another kind
are refused.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows get equal results; null
ids stay; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import require

SEPARATOR = "▁"
#: Longer runs are encoded one by one.
LONG_RUN = 48
#: Bytes of the runs that a worker remembers, about, if nothing else is asked for, and runs it encodes together.
REMEMBERED_BYTES, TOGETHER = 24 << 20, 20_000
#: Bytes that a remembered run takes besides its characters and ids.
OVERHEAD = 200
#: Pairs of tokens of long runs whose test is remembered, and ends of prefixes that are matched together.
FOLLOWERS, MATCHED = 200_000, 1 << 16
#: Pairs of tokens whose test is remembered, as a power of two.
TESTED_BITS = 20
NEVER = -(1 << 30)


class Lookup:
    """A fixed map from non-negative 62-bit keys to 32-bit numbers, -1 if there is none, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._slots(keys), np.arange(len(keys))
        while left.size:
            free = self.keys[at[left]] == -1
            slots, first = np.unique(at[left[free]], return_index=True)
            chosen = left[free][first]
            self.keys[slots], self.values[slots] = keys[chosen], values[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            taken = self.keys[at[left]] != -1
            at[left[taken]] = (at[left[taken]] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while left.size:
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return found


class PieceCodec:
    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not kinds <= {1, 2, 3, 6}:
            raise ValueError("only BPE models without normalisation rules and user-defined pieces are supported")
        self.text = {i: p.piece for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p: i for i, p in self.text.items()}
        if any(SEPARATOR in p.lstrip(SEPARATOR) for p in self.id):
            raise ValueError("a piece holds a word separator after another character")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        #: what each id, as text, decodes to, in UTF-8
        self.decoded = {str(i): p.piece.replace(SEPARATOR, " ").encode() if p.type == 1 else b"" for i, p in enumerate(model.pieces)}
        self.decoded |= {str(i): bytes([b]) for b, i in self.byte.items()} | {str(self.unknown): " \u2047 ".encode()}
        #: scores as ranks: equal scores get equal ranks, higher ones come first
        order = {s: i for i, s in enumerate(sorted(set(self.score.values())))}
        self.rank = {self.id[p]: order[s] for p, s in self.score.items()}
        self.tokens = max(self.id.values()) + 1
        self._timelines()
        self._trie()
        #: ids, joined by commas, of the runs that came last; how many bytes they take; and those of the runs before them, of
        #: which the ones that come again are taken over
        self._memory: dict[str, str] = {}
        self._bytes, self.remembered = 0, REMEMBERED_BYTES
        self._before: dict[str, str] = {}
        self._followers: dict[int, bool] = {}
        self._timeline: dict[int, tuple[list[int], list[int], list[int]]] = {}
        #: the last tested pair of each slot, and its result
        self._tested, self._holds = np.full(1 << TESTED_BITS, -1, np.int64), np.zeros(1 << TESTED_BITS, bool)

    def _merges(self, piece: str) -> list[tuple[int, int, int]] | None:
        """For each merge of the piece's own encoding: its rank, and the leftmost and rightmost tokens after it; the
        first entry is the state before any. None if it doesn't end in the piece."""
        parts = [self.id.get(c, -1) for c in piece]
        if -1 in parts:
            return None
        states = [(NEVER, parts[0], parts[-1])]
        texts = list(piece)
        while len(parts) > 1:
            found = [(self.rank[m], -i, m) for i in range(len(parts) - 1) if (m := self.id.get(texts[i] + texts[i + 1], -1)) >= 0]
            if not found:
                return None
            rank, i, merged = max(found)
            texts[-i : 2 - i] = [texts[-i] + texts[1 - i]]
            parts[-i : 2 - i] = [merged]
            states.append((rank, parts[0], parts[-1]))
        return states if parts[0] == self.id[piece] else None

    def _timelines(self) -> None:
        states = {i: s for i, p in self.text.items() if (s := self._merges(p)) is not None}
        self.steps = max(map(len, states.values()))
        #: by token and step: the rank of the merge that comes next, the token at the left and at the right end
        self.next_rank = np.full((self.tokens, self.steps), NEVER, np.int32)
        self.left_end = np.full((self.tokens, self.steps), -1, np.int32)
        self.right_end = np.full((self.tokens, self.steps), -1, np.int32)
        for i, s in states.items():
            n = len(s)
            self.next_rank[i, : n - 1] = [x[0] for x in s[1:]]
            self.left_end[i, :n] = [x[1] for x in s]
            self.right_end[i, :n] = [x[2] for x in s]
        self.reached = states.keys()
        pairs = {(a, b): self.rank[i] for i, p in self.text.items() for k in range(1, len(p)) if (a := self.id.get(p[:k], -1)) >= 0 and (b := self.id.get(p[k:], -1)) >= 0}
        keys = np.array([a * self.tokens + b for a, b in pairs], np.int64)
        self.border = Lookup(keys, np.array(list(pairs.values()), np.int32))

    def _trie(self) -> None:
        self.classes = np.zeros(0x110000, np.int32)
        chars = sorted({c for p in self.text.values() for c in p})
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_classes = len(chars) + 1
        nodes, ends = {"": 0}, {}
        for i in sorted(self.reached):
            p = self.text[i]
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
            ends[nodes[p]] = i
        self.token_at = np.full(len(nodes), -1, np.int32)
        self.token_at[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.text.values()))
        edges = [(nodes[x[:-1]] * self.n_classes + int(self.classes[ord(x[-1])]), n) for x, n in nodes.items() if x]
        self.children = Lookup(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32))
        self.length = np.array([len(self.text.get(i, "")) for i in range(self.tokens)], np.int64)
        self.id_text = [str(i) for i in range(self.tokens)]
        # a character outside the vocabulary ends a run; line ends and tabs are the frequent ones
        alone = "".join(c for c in "\t\n\r" if not self.classes[ord(c)])
        self.runs = re.compile(f"{SEPARATOR}*[^{SEPARATOR}{alone}]+|{SEPARATOR}+" + (f"|[{alone}]+" if alone else ""))

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which tokens of `second` may follow those of `first`: whether the joint text encodes to the two."""
        keys = first.astype(np.int64) * self.tokens + second
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TESTED_BITS)).astype(np.int64)
        new = np.flatnonzero(self._tested[slots] != keys)
        holds = self._holds[slots]
        if new.size:
            holds[new] = self._compatible(first[new], second[new])
            self._tested[slots[new]], self._holds[slots[new]] = keys[new], holds[new]
        return holds

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at_a, at_b, holds, left = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.ones(len(a), bool), np.arange(len(a))
        while left.size:
            i, j = at_a[left], at_b[left]
            own_a, own_b = self.next_rank[a[left], i], self.next_rank[b[left], j]
            across = self.border(self.right_end[a[left], i].astype(np.int64) * self.tokens + self.left_end[b[left], j])
            across = np.where(across < 0, NEVER, across)
            # of equal ranks the leftmost merge comes first: one in a, then one over the border, then one in b
            crossed = (across > own_a) & (across >= own_b)
            done = (own_a == NEVER) & (own_b == NEVER)
            holds[left[crossed]] = False
            in_a = own_a >= own_b
            at_a[left[in_a]] += 1
            at_b[left[~in_a]] += 1
            left = left[~crossed & ~done]
        return holds

    def _matches(self, classes: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens that begin at starts and don't reach beyond the room there: their ends, the tokens, their lengths."""
        nodes, ends, tokens, lengths = np.zeros(starts.size, np.int64), [], [], []
        for length in range(1, self.longest + 1):
            nodes = self.children(nodes * self.n_classes + classes[starts + length - 1]).astype(np.int64)
            alive = nodes >= 0
            starts, nodes, room = starts[alive], nodes[alive], room[alive]
            token = self.token_at[nodes]
            hit = token >= 0
            ends.append(starts[hit] + length)
            tokens.append(token[hit])
            lengths.append(np.full(int(hit.sum()), length))
            more = room > length
            starts, nodes, room = starts[more], nodes[more], room[more]
        return tuple(map(np.concatenate, (ends, tokens, lengths)))

    def _ids_of_long(self, run: str) -> list[int]:
        """Ids of one run of known characters."""
        classes, n = self.classes[np.frombuffer(run.encode("utf-32-le"), np.uint32)], len(run)
        last, may_follow = array("i", bytes(4 * (n + 1))), self._may_follow
        for low in range(0, n, MATCHED):
            high = min(n, low + MATCHED)
            starts = np.arange(max(0, low - self.longest + 1), high)
            end, token, length = self._matches(classes, starts, high - starts)
            new = np.flatnonzero(end > low)
            new = new[np.lexsort((-length[new], end[new]))]
            done = 0
            for e, t, size in zip(end[new].tolist(), token[new].tolist(), length[new].tolist(), strict=True):
                # the longest that may follow what is before it
                if e != done and (e == size or may_follow(last[e - size], t)):
                    last[e] = t
                    done = e
        ids, end = [], n
        while end:
            ids.append(last[end])
            end -= len(self.text[last[end]])
        return ids[::-1]

    def _states(self, token: int) -> tuple[list[int], list[int], list[int]]:
        """Of a token's own encoding, step by step: the rank of the merge that comes next, its left and right ends."""
        if token not in self._timeline:
            n = int((self.left_end[token] >= 0).sum())
            self._timeline[token] = tuple(x[token, :n].tolist() for x in (self.next_rank, self.left_end, self.right_end))
        return self._timeline[token]

    def _may_follow(self, first: int, second: int) -> bool:
        """The same as `compatible`, for one pair."""
        key = first * self.tokens + second
        if key not in self._followers:
            if len(self._followers) > FOLLOWERS:
                self._followers.clear()
            (ranks_a, _, right), (ranks_b, left, _) = self._states(first), self._states(second)
            i = j = 0
            while (own_a := ranks_a[i]) + (own_b := ranks_b[j]) > 2 * NEVER:
                across = self.rank.get(self.id.get(self.text[right[i]] + self.text[left[j]], -1), NEVER)
                if across > own_a and across >= own_b:
                    break
                i, j = (i + 1, j) if own_a >= own_b else (i, j + 1)
            across = self.rank.get(self.id.get(self.text[right[i]] + self.text[left[j]], -1), NEVER)
            self._followers[key] = not (across > own_a and across >= own_b)
        return self._followers[key]

    def _ids_of_many(self, runs: list[str]) -> list[str]:
        """Ids, joined by commas, of many short runs of known characters: one prefix table for all of them, end to end."""
        lengths = np.array([len(r) for r in runs], np.int64)
        ends = np.cumsum(lengths)
        classes = self.classes[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        n = classes.size
        place = np.arange(n) - np.repeat(ends - lengths, lengths)  # in its run
        end, token, length = self._matches(classes, np.arange(n), np.repeat(ends, lengths) - np.arange(n))
        end -= 1
        order = np.lexsort((-length, place[end]))
        end, token, length = end[order], token[order].astype(np.int64), length[order]
        steps = place[end] * (self.longest + 1) + self.longest - length
        bounds = np.flatnonzero(np.diff(steps, prepend=-1, append=-1))
        last = np.full(n, -1, np.int64)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e, t, size = end[low:high], token[low:high], int(length[low])
            undecided = last[e] < 0
            e, t = e[undecided], t[undecided]
            if not e.size:
                continue
            if place[e[0]] + 1 > size:
                holds = self.compatible(last[e - size], t)
                e, t = e[holds], t[holds]
            last[e] = t
        # backwards through all runs at once
        begins, counts = ends - lengths, np.zeros(len(runs), np.int64)
        at, active, steps_of = ends.copy(), np.arange(len(runs)), []
        while active.size:
            token = last[at[active] - 1]
            steps_of.append((active, token))
            counts[active] += 1
            at[active] -= self.length[token]
            active = active[at[active] > begins[active]]
        stops = np.cumsum(counts)
        ids = np.empty(int(stops[-1]), np.int64)
        for nth, (run, token) in enumerate(steps_of):
            ids[stops[run] - 1 - nth] = token
        ids, id_text = ids.tolist(), self.id_text.__getitem__
        return [",".join(map(id_text, ids[b:e])) for b, e in zip((stops - counts).tolist(), stops.tolist(), strict=True)]

    def _learn(self, runs: list[str]) -> None:
        """Put the encoding of new runs into the memory."""
        known = self.classes[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)] > 0
        lengths = np.array([len(r) for r in runs])
        together = (np.minimum.reduceat(known, np.cumsum(lengths) - lengths) & (lengths <= LONG_RUN)).tolist()
        whole = [r for r, t in zip(runs, together, strict=True) if t]
        for at in range(0, len(whole), TOGETHER):
            some = whole[at : at + TOGETHER]
            self._memory.update(zip(some, self._ids_of_many(some), strict=True))
        for r in (r for r, t in zip(runs, together, strict=True) if not t):
            ids = []
            for known, part in self._parts(r):
                if known:
                    ids += self._ids_of_long(part)
                else:
                    ids += [self.byte[b] for b in part.encode()] if self.byte else [self.unknown] * len(part)
            self._memory[r] = ",".join(map(str, ids))

    def _parts(self, run: str) -> list[tuple[bool, str]]:
        """A run cut where characters of the vocabulary and others meet."""
        known = self.classes[np.frombuffer(run.encode("utf-32-le"), np.uint32)] > 0
        cuts = [0, *(np.flatnonzero(known[1:] != known[:-1]) + 1).tolist(), len(run)]
        return [(bool(known[a]), run[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_parts(self, parts: list[tuple[str, bool]]) -> list[str]:
        """Ids, joined by commas, of each part of a text; each with whether it is the text's first."""
        cut = [self.runs.findall((SEPARATOR if first else "") + t.replace(" ", SEPARATOR)) if t else [] for t, first in parts]
        if self._bytes > self.remembered // 2:
            self._before, self._memory, self._bytes = self._memory, {}, 0
        memory, before = self._memory, self._before
        new = set().union(*cut).difference(memory)
        memory.update([(r, before[r]) for r in new if r in before])
        if unknown := [r for r in new if r not in before]:
            self._learn(unknown)
        found = [",".join(map(memory.__getitem__, runs)) for runs in cut]
        for r in new:
            if len(r) > LONG_RUN:
                del memory[r]
            else:
                self._bytes += OVERHEAD + len(r) + len(memory[r])
        return found

    def encode(self, text: str | None) -> list[int]:
        ids = ",".join(self.encode_parts([(p, not i) for i, p in enumerate(parts_of(text))]))
        return [int(i) for i in ids.split(",")] if ids else []

    def decode_bytes(self, ids: list[str], first: bool = True) -> bytes:
        """What ids, as texts, decode to, in UTF-8: byte tokens are put together, separators become blanks, and the one put
        in front of a text goes."""
        data = b"".join(map(self.decoded.__getitem__, ids))
        return data[1:] if first and ids and self.text.get(int(ids[0]), "").startswith(SEPARATOR) else data

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes([str(i) for i in ids]).decode(errors="replace")


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each worker process and model."""
    return PieceCodec(model_path)


#: Characters of text whose runs are handled together, and of a part of a text at least.
BATCH_CHARS = 1 << 20


def parts_of(text: str | None) -> Iterator[str]:
    """A text in parts of about BATCH_CHARS characters, cut where a blank follows another character and so a run begins."""
    text, at = text or "", 0
    while len(text) - at > BATCH_CHARS and (cut := re.compile(r"(?<! ) ").search(text, at + BATCH_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True, keep_decoded: bool = True, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the
    decoded text), and if kept also ids (array<int>) and decoded. A worker remembers runs of so many bytes, about."""
    require(docs, id_column, text_column)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kinds |= ({"ids": pa.list_(pa.int32())} if keep_ids else {}) | ({"decoded": pa.string()} if keep_decoded else {})

    class Row:
        """A document on its way: hashes of its ids and of what they decode to."""

        def __init__(self) -> None:
            self.n_tokens, self.of_ids, self.of_text, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256(), [], []

        def add(self, own: PieceCodec, ids: str) -> None:
            if not ids:
                return
            each, first = ids.split(","), not self.n_tokens
            data = own.decode_bytes(each, first)
            self.n_tokens += len(each)
            self.of_ids.update((ids if first else "," + ids).encode())
            self.of_text.update(data)
            if keep_ids:
                self.ids.append(np.fromiter(map(int, each), np.int32, len(each)))
            if keep_decoded:
                self.decoded.append(data)

        def values(self) -> dict:
            found = {"n_tokens": self.n_tokens, "ids_sha256": self.of_ids.hexdigest(), "decoded_sha256": self.of_text.hexdigest()}
            return found | ({"ids": np.concatenate([*self.ids, np.empty(0, np.int32)])} if keep_ids else {}) | ({"decoded": b"".join(self.decoded).decode()} if keep_decoded else {})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        own.remembered = remembered

        def finished(ids: pa.Array, rows: list[Row]) -> pa.RecordBatch:
            values = [r.values() for r in rows]
            return pa.RecordBatch.from_arrays([ids, *[pa.array([v[c] for v in values], t) for c, t in kinds.items()]], ["id", *kinds])

        for batch in batches:
            rows: list[Row] = []
            waiting, size, start = [], 0, 0
            for nth in range(batch.num_rows):
                rows.append(Row())
                for i, part in enumerate(parts_of(batch.column(1)[nth].as_py())):
                    waiting.append((rows[-1], part, not i))
                    size += len(part)
                    if size >= BATCH_CHARS:
                        for (row, _, _), ids in zip(waiting, own.encode_parts([w[1:] for w in waiting]), strict=True):
                            row.add(own, ids)
                        waiting, size = [], 0
                if not waiting:
                    yield finished(batch.column(0).slice(start, len(rows)), rows)
                    rows, start = [], nth + 1
            for (row, _, _), ids in zip(waiting, own.encode_parts([w[1:] for w in waiting]), strict=True):
                row.add(own, ids)
            if rows:
                yield finished(batch.column(0).slice(start, len(rows)), rows)

    id_type = dict(docs.dtypes)[id_column]
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_decoded else "")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(encoded, schema).withColumnRenamed("id", id_column)
