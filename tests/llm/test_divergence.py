"""The audit of sources against plain loops over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from scanloom.llm import divergence
from scanloom.llm.queries import queries


def plain(rows, top=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = sorted(s for x, s in groups if x == lang)
        totals = {s: sum(count[lang, s][t] for t in kept) for s in own}
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        of = {s: {t: share(count[lang, s][t], totals[s]) for t in kept} for s in own}
        whole = {t: share(sum(count[lang, s][t] for s in own), sum(totals.values())) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in own:
            pairs = [(sum(f(of[s][t], of[r][t]) for t in kept), r) for r in own if r != s]
            terms = [(f(of[s][t], whole[t]), t) for t in kept if count[lang, s][t] and of[s][t] > whole[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_query(spark, sf):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries()["op12_divergence"](spark, sf)) == plain(rows)


@pytest.fixture(scope="module")
def made(spark):
    source = random.Random(9)
    rare = [f"w{'xyz'[i % 3] * (i // 3 + 1)}" for i in range(60)]
    rows = []
    for i in range(240):
        own = source.randrange(9)
        text = " ".join(source.choice(["The", "of", "É", "ß1ß"]) for _ in range(source.randrange(12))) + "-" + " ".join(source.choice(rare[own * 5 : own * 5 + 20]) for _ in range(source.randrange(5)))
        rows.append((source.choice(["en", "en", "en", None, "de"]), [None, "a", "b", "c", "d", "e", "é", "g", "h"][own], text))
    rows += [("fr", "alone", "x y z"), ("it", "a", None), ("it", "b", "..."), ("es", "a", "hola"), ("es", "b", "hola"), ("es", "b", "hola hola"), *rows[:3]]
    return spark.createDataFrame([(*r, "t") for r in rows], "lang string, source string, text string, term string"), rows


@pytest.mark.parametrize("tile, chunk, heavy, held", [(512, 512, 4, 400_000), (3, 2, 2, 5), (7, 4, 1, 50), (5, 3, 10**6, 1), (5, 3, 10**6, 400), (512, 512, 10**6, 400), (512, 512, 4, 1), (512, 512, 1000, 400)])
def test_tiles_and_chunks(made, monkeypatch, tile, chunk, heavy, held):
    """Few terms a tile, few sources a chunk, all terms light or all heavy: the same whole numbers."""
    for name, value in (("TILE_TERMS", tile), ("CHUNK", chunk), ("HEAVY", heavy), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    docs, rows = made
    assert found(divergence.audit(docs)) == plain(rows)


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 5)
    data = ("ab cdefghij k " * 9 + "é" * 20).encode()
    assert [t for piece in divergence._pieces(data) for t in divergence._TERM.findall(piece)] == divergence._TERM.findall(data)


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert found(divergence.audit(odd_docs)) == plain([(r.lang, r.source, r.text) for r in odd_docs.collect()])
    assert divergence.audit(no_docs).count() == 0
