"""Benchmark windows in documents against plain loops."""

import hashlib
import random
import re

import pytest

from scanloom.llm import decontaminate
from scanloom.llm.queries import queries

ITEMS = "item_id string, text string, word string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(documents, items, window=10):
    """(n_words, hit word places, items) of each text."""
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for text in documents:
        own, hit, names = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if found := windows.get(tuple(own[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(own), hit, sorted(names)))
    return out


def test_query(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = queries()["op11_decontamination"](spark, sf).orderBy("doc_id").collect()
    expected = plain([d.text for d in documents], items)
    assert any(e[1] for e in expected)
    for d, r, (n, hit, names) in zip(documents, found, expected, strict=True):
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (d.doc_id, n, len(hit), len(names), sha, bool(hit))


@pytest.fixture(scope="module")
def made(spark):
    """Texts over few words, so that windows of any length meet by chance, with odd signs between and beyond ASCII."""
    source = random.Random(4)
    letters = ["a", "B", "c7", "É", "漢字", "ß"]
    some = lambda n: "".join(source.choice(letters) + source.choice([" ", "-", "\n\n", "\x00", "_"]) for _ in range(n))
    texts = [some(source.choice([0, 1, 2, 5, 40, 300])) for _ in range(60)] + [None, "", "  ..", "é" * 3000, "word " * 4000]
    items = [(str(i % 17) if i else None, some(source.choice([1, 3, 4, 8, 30])), "x") for i in range(40)] + [("n", None, "x"), ("e", "!!", "x"), ("long", "word " * 500, "x"), ("one", "é" * 3000, "x")]
    documents = [(i % 50, t, "k", i) for i, t in enumerate(texts)] + [(None, texts[3], "k", 99), (3, texts[3], "k", 98)]
    return spark.createDataFrame(documents, "doc_id long, text string, carried string, items int"), spark.createDataFrame(items, ITEMS), documents, items


@pytest.mark.parametrize("piece, most, chunk", [(4096, 10**6, 1 << 20), (4, 60, 64), (1, 25, 7)])
def test_pieces_and_slices(made, monkeypatch, piece, most, chunk):
    """Windows of 4 words, with items cut into pieces, several slices, and hashes made of short stretches of bytes."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    docs, benchmark, documents, items = made
    found = decontaminate.find_contamination(docs, benchmark, window=4, most=most, carry=("items", "doc_id")).collect()
    assert len(found) == len(documents)
    expected = dict(zip([d[3] for d in documents], plain([d[1] for d in documents], [i[:2] for i in items], 4), strict=True))
    for r in found:
        n, hit, names = expected[r.carried["items"]]
        own = {p for low, high in zip(r.hits[::2], r.hits[1::2], strict=True) for p in range(low, high)}
        assert (r.n_words, r.n_hit, own, r["items"]) == (n, len(hit), hit, names)
        assert r.hits == sorted(set(r.hits))


@pytest.mark.parametrize("most", [10**6, 60])
def test_documents_or_runs_go(made, most):
    docs, benchmark, documents, items = made
    expected = plain([d[1] for d in documents], [i[:2] for i in items], 4)
    kept = decontaminate.decontaminated(docs, benchmark, window=4, most=most)
    assert kept.columns == docs.columns
    assert sorted(r["items"] for r in kept.collect()) == sorted(d[3] for d, e in zip(documents, expected) if not e[1])
    cut = {r["items"]: r.text for r in decontaminate.decontaminated(docs, benchmark, spans=True, window=4, most=most).collect()}
    for d, (n, hit, _) in zip(documents, expected):
        assert words(cut[d[3]]) == [w for i, w in enumerate(words(d[1])) if i not in hit] or hit and "".join(words(cut[d[3]])) == "".join(w for i, w in enumerate(words(d[1])) if i not in hit)
        assert hit or cut[d[3]] == d[1]


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.find_contamination(no_docs, none).count() == 0
    found = decontaminate.find_contamination(odd_docs, none).collect()
    assert len(found) == odd_docs.count() and all(r.n_hit == 0 and r["items"] == [] for r in found)
