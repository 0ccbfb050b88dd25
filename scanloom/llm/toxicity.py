"""Toxicity of texts that may hide their words: noisy-channel decoding, then a lexicon learned from labels.

Channel: words are written with digits and signs for letters, with separators between their letters, or with letters
repeated. A token that shows such marks becomes a lattice of the letters it may stand for, each step with the cost of
that distortion, and a Viterbi search takes the path of least cost under the distortions and a character trigram model
of the whole corpus. Tokens without marks have a single path and stay as they are. Tokens may have any length. One with
digits or signs behind it is read with them and without, one with a sign twice running also with that sign
once, and a run of single letters also as one word.

Score: of the words of all readings and their openings of 4 and 5 letters, the one that says most. A feature's chance
to mean toxic text comes from the labelled documents with and without it; evidence from toxic documents counts once
for each different word before it, so copies of one document teach as one, and that of an opening once for each
different word with it, so that one word doesn't speak for others that begin like it. The lexicon is learned from a bounded
sample of labelled rows (`per_class` documents of either class, by a hash of the id); the character model is counted
over all documents, and all texts are scored whole where they lie.

Defined results: a null or empty text scores 0, and so does every text if no labels were there to learn from; a null
label teaches nothing; of several labels of an id the highest counts; repeated rows get equal results; null ids stay
and are never labelled; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.char_lm import CLASSES, classes, counted, losses
from scanloom.llm.common import checkpointed, require

#: The letters that digits and signs are written for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "¡": "i"}
SEPARATORS = " .-_*~"
#: Costs of the channel, in nats: a letter written as a sign, a separator put in, a letter repeated.
SIGN_COST, SEPARATOR_COST, REPEAT_COST = 1.0, 0.3, 0.3
#: From this score on a text counts as toxic.
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(STANDS_FOR))
_LETTER = r"[^\W\d_]"
#: Signs among letters; single letters or signs between separators of one kind; a letter three times in a row.
SIGNED = re.compile(rf"{_LETTER}*[{_SIGNS}](?:{_LETTER}|[{_SIGNS}])*")
_SPELT = rf"(?:[^\W_]|[{re.escape(''.join(c for c in STANDS_FOR if not c.isdigit()))}])"
SPACED = re.compile(rf"(?<!\w){_SPELT}([{re.escape(SEPARATORS)}])(?:{_SPELT}\1)+{_SPELT}(?!\w)")
SPELT_APART = re.compile(rf"(?<!\w){_SPELT} (?:{_SPELT} )+{_SPELT}(?!\w)")
THRICE = re.compile(rf"({_LETTER})\1\1")
TOKEN = re.compile(r"\S+")
#: Digits and signs that may also just stand behind a word: it is read with them and without.
BEHIND = "$@\u20ac\u00a10123456789"
#: The cost of a digit that is taken for itself behind a word.
DIGIT_COST = 3.0
DOUBLED = re.compile(rf"([{_SIGNS}])\1+")
#: What a token without any mark can't hold: a sign, two separators around a character, a character three times.
HINT = re.compile(rf"[{_SIGNS}]|[{re.escape(SEPARATORS)}].[{re.escape(SEPARATORS)}]|(.)\1\1")
#: Tokens of no more characters are remembered, and so many of them.
KEPT, REMEMBERED = 40, 500_000


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for and at what cost: a letter, nothing, or (a blank) the end of a word."""
    spaced = len(token) > 2 and token[1] in SEPARATORS and set(token[1::2]) == {token[1]}
    letters = token[::2] if spaced else token
    long_run = {m.start() + i for m in re.finditer(r"(.)\1{2,}", letters) for i in range(1, len(m[0]))}  # what repetition may have put in
    steps = []
    for nth, c in enumerate(token):
        if spaced and c == token[1]:
            steps.append([("", SEPARATOR_COST), (" ", 0.0)] if c == " " else [("", SEPARATOR_COST)])
            continue
        own = [(c, 0.0)] if c.isalpha() else [(x, SIGN_COST) for x in STANDS_FOR.get(c, "")] or [(c, 0.0)]
        steps.append(own + ([("", REPEAT_COST)] if (nth // 2 if spaced else nth) in long_run else []))
    return steps


def decode(token: str, losses: np.ndarray) -> tuple[str, float]:
    """The reading of a token, in lower case, of least cost, and that cost. A word stands between blanks."""
    table, loss = classes(), losses.item
    blank = int(table[32])
    paths = {(0, blank): (0.0, None)}  # by the classes of the last two letters: cost, and the last letter with those before it
    for step in lattice(token):
        found: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        options = [(x, extra, int(table[ord(x)]) if x else -1) for x, extra in step]
        for (a, b), (cost, out) in paths.items():
            for x, extra, k in options:
                state, total, text = ((b, k), cost + extra + loss((a * CLASSES + b) * CLASSES + k), (out, x)) if x else ((a, b), cost + extra, out)
                if state not in found or total < found[state][0]:
                    found[state] = (total, text)
        paths = found
    cost, at = min(((cost + loss((a * CLASSES + b) * CLASSES + blank), out) for (a, b), (cost, out) in paths.items()), key=lambda x: x[0])
    letters = []
    while at is not None:
        at, x = at
        letters.append(x)
    return "".join(reversed(letters)), cost


def marked(text: str) -> list[tuple[int, int]]:
    """Where the marks of a distortion are: spans of whole tokens, in order and apart."""
    spans = [m.span() for m in SPACED.finditer(text) if any(map(str.isalpha, m[0]))]
    for m in SIGNED.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in "!+(|":  # at the end of a word a sign is itself
            end -= 1
        token = text[start:end]
        if len(token) >= 3 and any(map(str.isalpha, token)) and not token.isalpha() and not (start and text[start - 1].isalnum()) and not (m.end() < len(text) and text[m.end()].isalnum()):
            spans.append((start, end))
    seen = 0
    for m in THRICE.finditer(text):
        start, end = m.span()
        if start < seen:  # in the same word
            continue
        while start and text[start - 1].isalpha():
            start -= 1
        while end < len(text) and text[end].isalpha():
            end += 1
        seen = end
        spans.append((start, end))
    apart: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if not apart or start >= apart[-1][1]:
            apart.append((start, end))
    return apart


class Remembered(dict):
    """Results of a function of tokens, kept for when they come again; there is a bound on their number and length."""

    def __init__(self, result) -> None:
        super().__init__()
        self.result = result

    def __missing__(self, token: str):
        found = self.result(token)
        if len(token) <= KEPT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found


class Reader:
    """Readings of texts under a model, the losses of character trigrams."""

    def __init__(self, losses: np.ndarray) -> None:
        self.losses = losses
        #: by token: what it is restored to, and the words of all its readings
        self.tokens = Remembered(self._token)

    def readings(self, marked_token: str) -> tuple[str, list[str]]:
        """What a marked token is restored to, and its readings."""
        whole, cost = decode(marked_token, self.losses)
        stem = marked_token.rstrip(BEHIND)
        found, shown, tail = [whole], whole, marked_token[len(stem) :]
        if stem and tail:
            own, own_cost = decode(stem, self.losses)
            found.append(own)
            if not tail.isdigit():
                shown = f"{own} {whole}"
            elif own_cost + DIGIT_COST * len(tail) < cost:
                shown = own + tail
        others = {DOUBLED.sub(r"\1", marked_token)}
        if SPELT_APART.fullmatch(marked_token):
            others.add(marked_token[::2])  # one word, whatever the model says
        return shown, found + [decode(x, self.losses)[0] for x in sorted(others - {marked_token})]

    def _marked(self, text: str) -> tuple[str, tuple[str, ...]]:
        shown, words, at = [], [], 0
        for start, end in marked(text):
            own, readings = self.readings(text[start:end])
            shown += [text[at:start], own]
            words += WORD.findall(text[at:start])
            for reading in readings:
                words += WORD.findall(reading)
            at = end
        return "".join([*shown, text[at:]]), (*words, *WORD.findall(text[at:]))

    def _token(self, token: str) -> tuple[str, tuple[str, ...]]:
        if HINT.search(token):
            return self._marked(token)
        return token, (token,) if token.isalpha() else tuple(WORD.findall(token))

    def pieces(self, text: str) -> Iterator[tuple[str, tuple[str, ...]]]:
        """text, in lower case, in pieces: tokens and runs of letters apart, each restored, with the words of its readings."""
        at = 0
        if 1 in set(map(len, text.split())):
            for m in SPELT_APART.finditer(text):
                if any(map(str.isalpha, m[0])):
                    yield from map(self.tokens.__getitem__, text[at : m.start()].split())
                    yield self._marked(m[0])
                    at = m.end()
        yield from map(self.tokens.__getitem__, text[at:].split())


def restored(text: str, reader: Reader) -> str:
    """text in lower case with its marked tokens decoded; white space stays."""
    text = text.lower()
    out, at = [], 0
    for m in SPELT_APART.finditer(text):
        if any(map(str.isalpha, m[0])):
            out += [TOKEN.sub(lambda t: reader.tokens[t[0]][0], text[at : m.start()]), reader._marked(m[0])[0]]
            at = m.end()
    return "".join([*out, TOKEN.sub(lambda t: reader.tokens[t[0]][0], text[at:])])


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "~" for n in (4, 5) if len(word) >= n))


@dataclass(frozen=True)
class Fit:
    """per_class: bound of the sampled documents. prior: share of features that mean toxic text. pure: how often such a
    feature's documents are toxic. least: features of a lower chance are left out of the lexicon."""

    per_class: int = 20_000
    prior: float = 1e-5
    pure: float = 0.98
    least: float = 0.05


def _sample(rows: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, sizes.get(1, 1)))).otherwise(min(1.0, per_class / max(1, sizes.get(0, 1))))
    return rows.filter(chance < share), sizes


def learn_lexicon(docs: DataFrame, labels: DataFrame, key: str, shared, fit: Fit) -> dict[str, float]:
    """docs: id and text; labels: id and toxic, of the rows to learn from. The chance of each feature to mean toxic text."""
    chosen, sizes = _sample(labels.select("id", F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")), fit.per_class)
    if not sizes.get(1) or not sizes.get(0):
        return {}

    def counted_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, shared)
        found = defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            for text, toxic in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                before, seen = "", set()
                found[""][toxic] += 1
                for word in (w for _, words in reader.pieces((text or "").lower()) for w in words):
                    for f in features_of(word):
                        if f not in seen:
                            seen.add(f)
                            found[f][toxic] += 1
                        if toxic:
                            found[f][2] |= 1 << (crc32((word if f[-1] == "~" else before).encode()) & 63)
                    before = word
        names = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[f][1] for f in names], pa.int64()), pa.array([found[f][0] for f in names], pa.int64()), pa.array(np.array([found[f][2] for f in names], np.uint64).view(np.int64))], ["feature", "toxic", "clean", "contexts"])

    # at most about 2 * per_class rows of two numbers each, so they may be broadcast and no text is moved
    rows = docs.join(F.broadcast(chosen), "id").select("text", "toxic")
    sums = rows.mapInArrow(counted_features, "feature string, toxic long, clean long, contexts long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("contexts")).alias("filled"))
    sums = checkpointed(sums.filter("toxic > 0"))
    whole = sums.filter("feature = ''").first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return {}
    base = whole["toxic"] / (whole["toxic"] + whole["clean"])
    # different words before a feature, or with an opening, from the filled places of 64
    contexts = F.when(F.col("filled") < 64, -64 * F.log(1 - F.col("filled") / 64)).otherwise(F.col("toxic"))
    evidence = F.least(F.col("toxic").cast("double"), contexts) * float(np.log(fit.pure / base)) + F.col("clean") * float(np.log((1 - fit.pure) / (1 - base))) + float(np.log(fit.prior / (1 - fit.prior)))
    chance = 1 / (1 + F.exp(-evidence))
    return {r["feature"]: r["chance"] for r in sums.filter("feature != ''").withColumn("chance", chance).filter(F.col("chance") >= fit.least).select("feature", "chance").collect()}


#: The reader and the scorer that a worker process used last, by the key of their run.
_last_reader: dict[str, Reader] = {}
_last_scorer: dict[str, Scorer] = {}


def _reader(key: str, shared) -> Reader:
    if key not in _last_reader:
        _last_reader.clear()
        _last_reader[key] = Reader(shared.value)
    return _last_reader[key]


class Scorer:
    """Scores of texts by a lexicon: the chance of each feature to mean toxic text."""

    def __init__(self, reader: Reader, chances: dict[str, float]) -> None:
        self.reader, self.chances = reader, chances
        #: by token: the best of its features, None if none counts
        self.tokens = Remembered(lambda token: self._best(reader._token(token)[1]))

    def _best(self, words: tuple[str, ...]) -> tuple[float, str] | None:
        return max(((self.chances[f], f) for word in words for f in features_of(word) if f in self.chances), default=None)

    def score(self, text: str) -> tuple[float, str]:
        text, apart = text.lower(), ()
        tokens = set(text.split())
        if 1 in set(map(len, tokens)):
            apart = [m[0] for m in SPELT_APART.finditer(text) if any(map(str.isalpha, m[0]))]
            if apart:
                tokens = set(SPELT_APART.sub(lambda m: " " if any(map(str.isalpha, m[0])) else m[0], text).split())
        found = [x for t in tokens if (x := self.tokens[t])] + [x for run in apart if (x := self._best(self.reader._marked(run)[1]))]
        return max(found, default=(0.0, ""))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", fit: Fit | None = None) -> DataFrame:
    """docs scored by what labels (id, toxic) teach: row, score (0 to 1), and the feature that says most."""
    require(docs, id_column, text_column)
    context, key = docs.sparkSession.sparkContext, uuid.uuid4().hex
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    character_model = context.broadcast(losses(counted(rows.select("text", F.lit(None).cast("int").alias("group")), 0)[0]))
    lexicon = context.broadcast(learn_lexicon(rows, labels.toDF("id", "toxic"), key, character_model, fit or Fit()))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _last_scorer:
            _last_scorer.clear()
            _last_scorer[key] = Scorer(_reader(key, character_model), lexicon.value)
        own = _last_scorer[key]
        for texts in batches:
            found = [own.score(text or "") for text in texts]
            yield pd.DataFrame({"score": [x[0] for x in found], "reason": [x[1] for x in found]}).astype({"score": "float64"})

    score = F.pandas_udf(scored, "score double, reason string")
    return docs.select(F.struct(*docs.columns).alias("row"), score(F.col(text_column)).alias("x")).select("row", "x.score", "x.reason")
