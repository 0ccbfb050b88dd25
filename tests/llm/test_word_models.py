"""LM scoring by words: what a corpus says about words and scripts counts, against plain loops."""

from collections import Counter
from math import log

import pytest

from scanloom.llm import lm_scoring


def test_word_losses(spark):
    texts = {1: "абв где абв", 2: "жзи где  абв", 3: "one two\tone two", 4: "абв жзи", 5: " \n", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in lm_scoring.score_documents(docs, spark.createDataFrame([(1,), (4,)], "i long")).collect()}
    words = {i: (t or "").split() for i, t in texts.items()}

    def model(ids):
        return Counter(p for i in ids for p in zip(["", *words[i]], words[i])), Counter(w for i in ids if words[i] for w in ["", *words[i]])

    t, b = model([1, 4]), model(words)
    size, of_all = (sum(pairs.values()) for pairs, _ in (t, b))

    def loss(model, times, v, w):
        pairs, ones = model
        p = (ones[w] * times + 5 / (of_all + 1)) / (size + 5)
        return -log((pairs[v, w] * times + 5 * p) / (ones[v] * times + 5))

    assert set(found) == set(texts)
    for i, own in words.items():
        each = [(loss(t, 1, v, w), loss(b, size / of_all, v, w)) for v, w in zip(["", *own], own)]
        assert found[i].n_tokens == len(own)
        for k, value in enumerate((found[i].target_loss, found[i].background_loss)):
            assert value == pytest.approx(sum(x[k] for x in each) / max(len(each), 1), abs=1e-8)
    assert found[1].score < found[3].score and found[5].score == found[6].score == 0


def test_blocks_and_ranges_change_nothing(spark, sf, monkeypatch):
    """Many small blocks and key ranges give what one of each gives; so does an id with a third of all rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.selectExpr("7L", "text")).unionAll(docs.selectExpr("null", "text"))
    good = spark.range(0, 40).selectExpr("id * 5 + 2")
    whole = sorted(map(tuple, lm_scoring.score_documents(docs, good).collect()), key=str)
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(lm_scoring, "RANGE_KEYS", 3_000)
    assert sorted(map(tuple, lm_scoring.score_documents(docs, good).collect()), key=str) == whole
    assert len(whole) == docs.count()
