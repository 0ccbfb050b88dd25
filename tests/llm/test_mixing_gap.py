"""The part of a target after the whole passes, where a very long document straddles the cut."""

from collections import defaultdict

import pytest

from scanloom.llm import mixing


@pytest.mark.parametrize("shift", [0, 7000])
def test_long_document_at_the_cut(spark, shift):
    # s1 wants 58,000 of its 120,000 words; its short documents alone could meet that
    rows = [(shift + i, "w " * 20, "s1") for i in range(3000)] + [(shift + 3000, "w " * 60_000, "s1")]
    rows += [(shift + 4000 + i, "w " * 100, "s2") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs, weights=(29, 41), cap=5).collect():
        taken[r.source] += r.size * len(r.shards)
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 20 for s, t in target.items()), (dict(taken), target)
    assert sum(len(r.shards) for r in mixing.mix(docs, weights=(29, 41), cap=5).collect()) == mixing.mixed_documents(docs, weights=(29, 41), cap=5).count()
