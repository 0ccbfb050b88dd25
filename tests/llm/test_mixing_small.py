"""Sources of few documents: what they take against the best of all choices."""

from itertools import product

import numpy as np
import pytest

from scanloom.llm import mixing


@pytest.mark.parametrize("seed", range(40))
def test_best_draws(seed):
    random = np.random.default_rng(seed)
    sizes = random.integers(1, 400, random.integers(1, 7)).tolist()
    most = int(random.integers(1, 4))
    rest = int(random.integers(0, sum(sizes) * most + 50))
    best = min(abs(rest - sum(n * s for n, s in zip(draws, sizes))) for draws in product(range(most + 1), repeat=len(sizes)))
    draws = mixing.best_draws(sizes, rest, most)
    assert max(draws) <= most and abs(rest - sum(n * s for n, s in zip(draws, sizes, strict=True))) == best


def test_best_draws_of_long_documents(monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1000)
    sizes = [1_234_567, 2_345_678, 345_678, 45_678, 5_000_001]
    draws = mixing.best_draws(sizes, 7_000_000, 2)
    assert abs(7_000_000 - sum(n * s for n, s in zip(draws, sizes, strict=True))) < 5 * 7_000_000 / 1000


@pytest.mark.parametrize("small", [64, 0])
def test_small_sources(spark, monkeypatch, small):
    """Sources of 2 to 10 documents, of which the largest may be most of the source; with small=0 by the filling rounds."""
    monkeypatch.setattr(mixing, "SMALL_SOURCE", small)
    random, rows = np.random.default_rng(5), []
    for source in range(18):
        sizes = random.integers(1, 300, random.integers(2, 7)).tolist() + ([1200] if source % 2 else [])
        rows += [(len(rows) + i, "w " * n, f"s{source:02}") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert all(len(r.shards) <= mixing.CAP for r in own)
        sums = {0}
        for r in own:
            sums = {s + n * r.size for s in sums for n in range(mixing.CAP + 1)}
        best = min(abs(s - own[0].target) for s in sums)
        gap = abs(sum(r.size * len(r.shards) for r in own) - own[0].target)
        # rounds end when nothing fits that may still be drawn
        left = [r.size for r in own if len(r.shards) < mixing.CAP]
        assert gap <= 1 + (best + min(r.size for r in own) if small else max(best, min(left, default=0))), (source, gap, best, [(r.size, len(r.shards)) for r in own], own[0].target)
    assert sorted(r.shards for r in found) == sorted(r.shards for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(docs).count() == sum(len(r.shards) for r in found)
