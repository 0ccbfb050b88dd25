"""Mixing where keys are hot or many: equal ids and rows, many sources, and counts beyond numpy's bound."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import mixing


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)


@pytest.mark.parametrize("doc_id", ["7L", "cast(null as bigint)"])
def test_one_id_for_all_rows(spark, small_buckets, doc_id):
    """Rows that share an id are dealt out over the order as others are, and each meets its own draws."""
    docs = spark.range(3000).selectExpr(f"{doc_id} as doc_id", "concat_ws(' ', 'w', id, repeat('x ', id % 7)) as text", "if(id % 3 = 0, 'a', 'b') as source", "id as other")
    rows = mixing._mix(docs, "doc_id", "text", "source", mixing.WEIGHTS, mixing.CAP, mixing.SEED, mixing.SHARDS, mixing.BLOCK_WORDS)
    keys = [r.key for r in rows.select(mixing._key(mixing.SEED, "id", "size", "h", "nth").alias("key")).collect()]
    assert len(set(keys)) == 3000
    largest = max(Counter(k >> (mixing.KEY_BITS - 5) for k in keys).values())
    assert largest < 3 * 3000 / 32
    mixed, taken = mixing.mixed_documents(docs).collect(), mixing.mix(docs).collect()
    assert len(mixed) == sum(len(r.shards) for r in taken)
    words = lambda t: len(t.split())
    assert Counter(words(r.text) for r in mixed) == sum((Counter({r.size: len(r.shards)}) for r in taken), Counter())


@pytest.mark.parametrize("equal", [10_000, 3])
def test_equal_rows(spark, monkeypatch, equal):
    """A third of the rows is one row; each of them counts, whether or not it is dealt out over tasks."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", equal)
    docs = spark.range(300).selectExpr("if(id < 100, 5, id) as doc_id", "if(id < 100, 'same text here', concat('w ', id)) as text", "if(id % 2 = 0 or id < 100, 'a', 'b') as source", "if(id < 100, 0, id) as n")
    docs = docs.repartition(5)
    taken = mixing.mix(docs).collect()
    assert len(taken) == 300
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    times = Counter()
    for r in taken:
        times[r.doc_id] += len(r.shards)
    assert mixed == Counter({i: n for i, n in times.items() if n})


def test_many_sources(spark):
    """Targets of a thousand sources against a plain loop, and quotas that add up without any source on the driver."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + pow(id % 1000, 1.7) / 500 as int)) as text", "concat('host', id % 1000) as source")
    rows = mixing.mix(docs, block_words=16).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    capped: set[str] = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in sizes if 3 * sizes[s] / weight[s] < level}
        if more == capped:
            break
        capped = more
    for r in rows:
        assert r.target == pytest.approx(3 * sizes[r.source] if r.source in capped else weight[r.source] * level)
    blocks = Counter(shard for r in rows for shard in r.shards)
    assert set(blocks) == set(range(mixing.SHARDS))


def test_quotas_beyond_the_bound():
    """Large counts are split exactly: rows and columns add up, and shares lie where they should."""
    draws = [3_000_000_000, 5, 40_000_000_000, 0, 999]
    quotas = mixing.shard_quotas(draws, 7)
    assert quotas.sum(axis=1).tolist() == draws and np.ptp(quotas.sum(axis=0)) <= 1
    assert np.abs(quotas[0] - draws[0] / 7).max() < 12 * (draws[0] / 7) ** 0.5


def test_large_draws_have_the_distribution(monkeypatch):
    monkeypatch.setattr(mixing, "NUMPY_BOUND", 0)
    random = np.random.default_rng(1)
    for good, bad, n in ((7, 5, 4), (300, 500, 200), (10, 0, 3), (0, 4, 2), (6, 6, 12), (5, 5, 0)):
        own = np.array([mixing.hypergeometric(random, good, bad, n) for _ in range(4000)])
        other = random.hypergeometric(good, bad, n, 4000)
        assert abs(own.mean() - other.mean()) < 0.1 * max(1, other.std()) and abs(own.std() - other.std()) < 0.1 * max(1, other.std())
        assert own.min() >= max(0, n - bad) and own.max() <= min(n, good)


def test_null_source_and_no_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a"), (None, "", None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert [(r.size, r.target, r.shards) for r in rows] == [(0, 0.0, [])] * 3
    assert mixing.mixed_documents(docs).count() == 0 and mixing.mix(docs.filter(F.lit(False))).count() == 0
