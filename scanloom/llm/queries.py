"""The queries of this folder's operators: each applies its operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, divergence, exact_dedup, hard_negatives, langid, lm_scoring, mixing, pii, piece_codec, secrets, simhash, topk, toxicity
from scanloom.llm.common import crc32_mod, read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_mixing that SQL can say: the sizes and targets, without what the mix takes."""
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), good)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod("doc_id", 3) == 1
    taught = read_table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    found = toxicity.score_documents(read_table(spark, sf_dir, "documents"), taught)
    return found.select("row.doc_id", "score", "reason").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "reason")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "lang_pred", "score").withColumn("held_out", langid.held_out("doc_id"))


def piece_model() -> str:
    """The model file of the public tokenizers; another path may be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(read_table(spark, sf_dir, "documents"), piece_model(), keep_ids=False, keep_decoded=False, remembered=96 << 20)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.BASE_KINDS],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "carried.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_topk": op2_topk,
        "op3_mixing": op3_mixing,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_toxicity": op5_toxicity,
        "op6_langid": op6_langid,
        "op7_pieces": op7_pieces,
        "op8_secrets": op8_secrets,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_pii": op10_pii,
        "op11_decontamination": op11_decontamination,
        "op12_divergence": op12_divergence,
        "op13_hard_negatives": op13_hard_negatives,
        "mixing_targets": mixing_targets,
    }
