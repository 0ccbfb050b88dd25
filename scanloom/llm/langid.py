"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes single blanks, and their n-grams of 1 to 3 characters are hashed
to a fixed number of features. Document frequencies come from all labelled training rows, in one pass that adds up per
partition before its small shuffle. The regression is fitted by follow-the-regularised-leader with an elastic net, on
a bounded sample of the training rows (`per_language` of each language, chosen by a hash of the id); a fifth of the
sample is kept back, and the temperature that minimises its log loss calibrates the scores. Model and frequencies have
a fixed size, whatever the corpus, and go to the tasks as a broadcast; texts are scored whole where they lie.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if no labelled row
was there to learn from; rows with a null language or text teach nothing; repeated rows get equal results; null ids
stay; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import crc32_mod, require

UNKNOWN = "und"
FEATURES, ORDERS = 1 << 15, (1, 2, 3)
#: Characters that are turned into n-grams at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Fit:
    """per_language: bound of the sampled rows. alpha, beta, l1, l2: the learning rate and penalties of the leader."""

    per_language: int = 500
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 0.05
    l1: float = 0.004
    l2: float = 0.001
    held_back: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point, or 32 where it isn't a letter."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, np.uint32(32))


def counts_of(text: str) -> np.ndarray | None:
    """How often the text has the n-grams of each feature; None if it has no letter. Long texts are turned piece by
    piece, each with what the n-grams over its border need of the piece before."""
    table, counts, longest = _letters(), np.zeros(FEATURES, np.int64), max(ORDERS)
    lower, before, seen = text.lower(), np.array([32], np.uint32), 0
    for at in range(0, len(lower) + 1, CHUNK):
        points = table[np.frombuffer(lower[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + CHUNK > len(lower):
            points = np.append(points, np.uint32(32))
        blank = points == 32
        points = points[~(blank & np.concatenate((before[-1:] == 32, blank[:-1])))]
        seen += points.size
        new, points = points.size, np.concatenate((before, points))
        # the first piece's blank in front is an n-gram's end as well
        ends = points.size - new if at else 0
        state = np.zeros(points.size, np.uint32)
        for n in range(longest):
            state = (state[: points.size - n] ^ points[n:]) * np.uint32(0x9E3779B1) + np.uint32(n + 1)
            if n + 1 in ORDERS:
                mixed = state[max(0, ends - n) :]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
                counts += np.bincount((mixed >> np.uint32(17)).astype(np.int64), minlength=FEATURES)
        before = points[-(longest - 1) :]
    return counts if seen else None


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their values, of norm 1. Counts are damped by their logarithm."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / np.sqrt((values**2).sum())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader: weights come from gradient sums z and squared sums n, coordinate by coordinate."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) <= fit.l1, 0, -(pull - np.sign(pull) * fit.l1) / ((fit.beta + np.sqrt(n[at])) / fit.alpha + fit.l2))

    random = np.random.default_rng(fit.seed)
    for _ in range(fit.epochs):
        for i in random.permutation(len(rows)):
            at, values = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            w = weights(at)
            slope = _softmax(values @ w)
            slope[labels[i]] -= 1
            gradient = values[:, None] * slope
            squared = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(squared) - np.sqrt(n[at])) / fit.alpha * w
            n[at] = squared
    final = weights(np.arange(FEATURES + 1))
    return final[:-1], final[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        return float((np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)) + x.max(axis=1) - x[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows, and how many texts there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (counts := counts_of(text.as_py())) is not None:
                    found[:-1] += counts > 0
                    found[-1] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["feature", "n"])

    total = rows.select("text").mapInArrow(counted, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(FEATURES + 1, np.int64)
    for feature, n in total:
        found[feature] = n
    return found[:-1], int(found[-1])


def _sample(rows: DataFrame, per_language: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, hash, features, counts) of about per_language rows of each language at most, by a hash of the id."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(chance < F.element_at(share, F.col("lang"))).select("lang", F.xxhash64("id", "text").alias("h"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [(lang, h, np.flatnonzero(c).astype(np.int32), c) for lang, h, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) if (c := counts_of(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in every], pa.string()), pa.array([x[1] for x in every], pa.int64()), pa.array([x[2].tobytes() for x in every], pa.binary()), pa.array([x[3][x[2]].tobytes() for x in every], pa.binary())], ["lang", "h", "at", "n"])

    found = chosen.mapInArrow(features, "lang string, h long, at binary, n binary").collect()
    return sorted(((r["lang"], r["h"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int64)) for r in found), key=lambda r: (r[0], r[1]))


def fit_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fit: Fit | None = None) -> LanguageModel:
    """A model from the rows of docs that have a language; leave held-out rows out of docs."""
    fit = fit or Fit()
    require(docs, id_column, text_column, lang_column)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).filter("lang is not null and text is not null")
    sample = _sample(rows, fit.per_language)
    languages = sorted({x[0] for x in sample})
    if not languages:
        return LanguageModel([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    frequencies, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + frequencies)) + 1

    def features(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (1 + np.log(counts)) * idf[at]
        return at, values / np.sqrt((values**2).sum())

    data, labels = [features(x[2], x[3]) for x in sample], np.array([languages.index(x[0]) for x in sample])
    back = np.random.default_rng(fit.seed).random(len(data)) < fit.held_back
    taught, kept = np.flatnonzero(~back), np.flatnonzero(back)
    weights, bias = fit_leader([data[i] for i in taught], labels[taught], len(languages), fit)
    logits = np.array([data[i][1] @ weights[data[i][0]] + bias for i in kept]).reshape(len(kept), len(languages))
    return LanguageModel(languages, idf, weights, bias, best_temperature(logits, labels[kept]))


def predict_languages(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """docs with lang_pred and score in front; all columns of docs stay, in a struct `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            names, scores = [], []
            for text in texts:
                text = text.as_py()
                counts = counts_of(text) if text and own.languages else None
                if counts is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, values = tf_idf(counts, own.idf)
                chances = _softmax((values @ own.weights[at] + own.bias) / own.temperature)
                names.append(own.languages[int(chances.argmax())])
                scores.append(float(chances.max()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.select(F.struct(*docs.columns).alias("row"), F.arrow_udf(predicted, "lang_pred string, score double")(F.col(text_column)).alias("p")).select("row", "p.lang_pred", "p.score")


def held_out(id_column: str, folds: int = 5, fold: int = 0) -> Column:
    return crc32_mod(id_column, folds) == fold


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out, and predict all: row, lang_pred, score."""
    return predict_languages(docs, fit_languages(docs.filter(~held_out(id_column)), id_column, text_column, lang_column), text_column)


def keep_identified(docs: DataFrame, least: float = 0.5, **columns: str) -> DataFrame:
    """docs without the documents that no learned language explains: `und`, or a score below `least`."""
    names = docs.columns
    found = identify(docs, **columns).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col("row")[c].alias(c) for c in names])
