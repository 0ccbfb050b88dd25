"""The pipeline over odd and empty tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import langid


def test_odd_table(spark, odd_docs, tmp_path, sf):
    """Rows with nulls in any column, blank and long texts, repeated rows and clashing column names, among plain ones."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "'x' as h", "1 as norm", "'r' as row", "'i' as id", "'k' as key")
    odd_docs.unionByName(plain).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    texts = [r.text for r in docs.collect()]
    assert texts and all(t and t.strip() for t in texts)
    every = spark.read.parquet(str(tmp_path / "simhash_near_dedup"))
    assert every.filter("text like 'The same%'").count() <= 1 and every.count() == every.select("text").distinct().count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() == len(texts)


def test_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_to_learn_from(spark, odd_docs):
    assert langid.keep_identified(odd_docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0
