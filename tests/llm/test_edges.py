"""Each operator on odd rows and on an empty table: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from scanloom.llm import exact_dedup, langid, lm_scoring, mixing, pii, piece_codec, secrets, simhash, topk, toxicity
from scanloom.llm.queries import piece_model

FOUND = {
    "exact_dedup": exact_dedup.exact_duplicates,
    "keep_first": exact_dedup.keep_first_copies,
    "simhash": simhash.near_duplicates,
    "mixing": mixing.mix,
    "pii": pii.find_personal_data,
    "secrets": secrets.find_secrets,
    "pieces": lambda d: piece_codec.encode_documents(d, piece_model()),
    "langid": langid.identify,
    "lm": lambda d: lm_scoring.score_documents(d, d.filter("lang = 'en'").select("doc_id")),
    "toxicity": lambda d: toxicity.score_documents(d, d.select("doc_id", F.lit(1))),
}


@pytest.mark.parametrize("name", FOUND)
def test_empty_table(no_docs, name):
    assert FOUND[name](no_docs).count() == 0


@pytest.mark.parametrize("name", [n for n in FOUND if n != "keep_first"])
def test_one_row_for_each(odd_docs, name):
    assert FOUND[name](odd_docs).count() == odd_docs.count()


def test_empty_stages(no_docs):
    for stage in (langid.keep_identified, exact_dedup.keep_first_copies, simhash.keep_one_of_each_group, mixing.mixed_documents):
        assert stage(no_docs).columns == no_docs.columns
        assert stage(no_docs).count() == 0


def test_stages_keep_columns(odd_docs):
    for stage in (exact_dedup.keep_first_copies, simhash.keep_one_of_each_group, mixing.mixed_documents):
        assert stage(odd_docs).columns == odd_docs.columns


def test_exact_on_odd_rows(odd_docs):
    rows = exact_dedup.exact_duplicates(odd_docs).collect()
    kept = [r for r in rows if r.kept]
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 2, 3, 4, 5, 6, 8, 10, 11, 12]
    assert len(kept) == 11  # and the text without id
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].keep_id == 0 and by_id[1].group_size == 2  # null and empty
    assert by_id[7].keep_id == 5 and by_id[7].group_size == 4
    assert exact_dedup.keep_first_copies(odd_docs).count() == len(kept)


def test_simhash_on_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].fp == by_id[1].fp == by_id[2].fp == 0
    assert by_id[2].component_id == 0 and by_id[9].component_id == 8 and by_id[7].component_id == 5


def test_mixing_on_odd_rows(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert {r.source for r in rows} == {"a", "b", None, ""}
    total = sum(r.size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6
    assert all(len(r.shards) <= 3 for r in rows)
    assert sum(len(r.shards) for r in rows) == mixing.mixed_documents(odd_docs).count()


def test_topk_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [3.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<float>")
    found = [tuple(r) for r in topk.top_k(vectors, "vec_id", "v", F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 64 * 64 + 128 * 128), (0, 2, 1, 64 * 64 + 128 * 128), (0, 3, 7, 64 * 192), (0, 4, 6, 0)]
    clashing = vectors.select("*", *[F.lit("x").alias(c) for c in ("id", "asks", "square", "n", "block", "bar", "rank", "score", "query_id", "embedding")])
    assert [tuple(r) for r in topk.top_k(clashing, "vec_id", "v", F.col("vec_id") == 0).orderBy("rank").collect()] == found
    assert topk.top_k(vectors.limit(0), "vec_id", "v", F.col("vec_id") == 0).count() == 0


def test_no_labels_no_language(odd_docs):
    found = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in found] == [("und", 0.0)]
    scores = toxicity.score_documents(odd_docs, odd_docs.select("doc_id", F.lit(None).cast("int"))).select("score").distinct().collect()
    assert [r.score for r in scores] == [0.0]
