"""Top-k search over many blocks: equal to a plain search, and what is moved grows with the candidates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import topk


def plain(rows, is_query, k):
    found, queries = set(), {}
    for i, v in rows:
        if is_query(i):
            queries[i] = min(queries.get(i, v), v)
    for q, x in queries.items():
        scores = sorted(((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in rows if i != q))[:k]
        found |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, [x / topk.SCALE for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["spread", "equal norms", "copies"])
def test_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "LEAD", 30)
    generator = random.Random(kind)
    rows = []
    for i in range(300):
        v = [generator.randint(-9, 9) for _ in range(5)]
        v = {"spread": [x * (1 + i % 17) for x in v], "equal norms": random.Random(i).sample([3, -1, 4, 1, -5], 5), "copies": [1, 2, 3, 4, 5] if i % 3 == 0 else v}[kind]
        rows.append((7 if kind == "copies" and i % 6 == 0 else i, v))
    found = topk.top_k(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 6).collect()
    expected = plain(rows, lambda i: i % 20 == 0, 6)
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_what_is_moved_grows_with_the_candidates(spark, monkeypatch):
    """At a fixed number of queries: each candidate once, and queries by the block."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    random_ = np.random.default_rng(1)
    moved = {}
    for n in (400, 800, 1600):
        rows = spark.createDataFrame([(i, v.tolist(), i < 20) for i, v in enumerate(random_.integers(-50, 50, (n, 8)))], "id long, v array<long>, asks boolean")
        met, _ = topk.meetings(rows, 5)
        counts = {r.asks: r["count"] for r in met.groupBy("asks").count().collect()}
        assert counts[False] == n
        moved[n] = n + counts[True]
    assert moved[800] < 2.2 * moved[400] and moved[1600] < 2.2 * moved[800]
