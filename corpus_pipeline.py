"""A corpus of training text from documents, in five stages, each written and read again before the next.

Language identification drops what no learned language explains; exact and near copies leave one document each; the
sources are mixed to their target weights, documents being dropped or repeated; and what is left is encoded. All but the
last stage return the columns of documents.

Defined results: a null, empty or letterless text goes in the first stage, as no language explains it, and so does every
text if no document has a language to learn from; null ids, languages and sources stay (a null source is one of its own);
of repeated rows, and of copies and near copies, the row with the least id stays, a null id last; an empty table gives an
empty result; columns that documents have besides its own are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import exact_dedup, langid, mixing, near_dedup, piece_codec
from scanloom.llm.common import read_table, shared_folder
from scanloom.llm.queries import piece_model
from scanloom.sources.tables import remove_folder


#: Documents that go to a Python worker at once: they are long, and workers of all stages share the executors' memory.
BATCH_ROWS = 512
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """A setting for the stages, unless the session asks for fewer rows itself; run() restores the session's own."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return near_dedup.keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return piece_codec.encode_documents(docs, piece_model(), keep_decoded=False).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The model of the first stage and the draws of the fourth can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table. Each is written to the shared folder and read again; when the next one
    is written its folder goes, so the last stage's stays for the result to be read from."""
    folder, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    docs, batch_rows = read_table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, f"{folder}/{before}")
            docs, before = spark.read.parquet(f"{folder}/{name}"), name
    finally:
        spark.conf.set(BATCH_SETTING, batch_rows)
    return docs
