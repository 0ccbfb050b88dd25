"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from scanloom.llm import hard_negatives
from scanloom.llm.queries import queries

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string"


def plain(rows, positives=5, negatives=5):
    """rows: (id, label, whole components); the anchors' ids are those divisible by 100."""
    anchors = {}
    for i, label, v in rows:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scores = [(-sum(x * y for x, y in zip(v, w)), i, own == label) for i, own, w in rows if i != a]
        for score, p, _ in sorted(s for s in scores if s[2])[:positives]:
            inside = sorted((s, i) for s, i, same in scores if not same and 80 * -score <= 100 * -s <= 100 * -score)
            out += [(a, p, rank + 1, i, -score, -s) for rank, (s, i) in enumerate(inside[:negatives])]
    return sorted(out)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries()["op13_hard_negatives"](spark, sf)) == plain(rows)


@pytest.mark.parametrize("bucket, slab, lead", [(4096, 1024, 2048), (40, 16, 8), (40, 7, 0)])
def test_buckets(spark, monkeypatch, bucket, slab, lead):
    """Few candidates a bucket, a common vector, ties, repeated rows and ids, odd lengths, and rows that take no part."""
    for name, value in (("BUCKET", bucket), ("SLAB", slab), ("LEAD", lead), ("TILE", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    source = random.Random(2)
    rows = [(i, [source.gauss(0.3, 0.5) for _ in range(source.choice([5, 5, 5, 3]))], source.randrange(3), i, "v") for i in range(0, 1200, 4)]
    rows += [(i, [0.5, 0.5, 0.25, 0.0, 0.125], i % 2, i, "v") for i in range(1, 240, 2)]  # one vector of many
    rows += [rows[0], rows[25], rows[25], (100, [1.0, -1.0], 2, 0, "v"), (300, [0.0] * 5, 1, 0, "v")]
    kept = [(r[0], r[2], whole(r[1])) for r in rows]
    odd = [(5000, None, 1, 0, "v"), (5100, [1.0, None], 1, 0, "v"), (5200, [float("nan")], 1, 0, "v"), (5300, [float("inf"), 1.0], 0, 0, "v"), (5400, [1.0], None, 0, "v"), (None, [1.0], 1, 0, "v")]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(5)
    expected = plain(kept)
    assert len(expected) > 50
    assert found(hard_negatives.mine(df, df["vec_id"] % 100 == 0)) == expected


def test_large_components(spark):
    """Sums beyond 2^53 are added up as whole numbers."""
    rows = [(i * 50, [float(2**18 + i), float(2**18 - i * i)], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    assert found(hard_negatives.mine(df, df["vec_id"] % 100 == 0)) == plain(kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(df, df["vec_id"] % 100 == 0).count() == 0
