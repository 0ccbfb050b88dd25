"""Scores of new images, from a folder once or as they arrive, with the same columns."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.functions.expressions import probability_table
from scanloom.functions.pixels import F13
from scanloom.jobs.features import described_f13, features_f13
from scanloom.operators.cohort import accepted_uploads
from scanloom.operators.kmeans import nearest, squared_distances
from scanloom.operators.scale import EPSILON
from scanloom.operators.supervised import classified, load_classifier, save_classifier
from scanloom.sources.images import stream_images, to_gray
from scanloom.sources.tables import current_version, load_model, publish, save_model


def save_scorer(path: str, scaler: DataFrame, centers: DataFrame, names: list[str], classifier=None) -> None:
    """scaler, centers and the class name of each cluster as tables; the classifier, whose classes 0, 1, ... have the same
    names, beside them."""
    spark = scaler.sparkSession
    save_model(path, scaler=scaler, centers=centers, names=spark.createDataFrame(list(enumerate(names)), "cluster int, class_name string"), parts=spark.createDataFrame([(classifier is not None,)], "has_classifier boolean"))
    if classifier is not None:
        save_classifier(classifier, f"{path}/classifier")


def load_scorer(spark: SparkSession, model_dir: str) -> dict:
    """scaler, centers and class names of clusters, small tables that become literals of the scoring projection, and the
    classifier if one was saved."""
    tables = load_model(spark, model_dir, "scaler", "centers", "names", "parts")
    scaler = {r["feature"]: (r["mu"], r["sigma"]) for r in tables["scaler"].collect()}
    centers = [r["center"] for r in tables["centers"].orderBy("cluster").collect()]
    classifier = load_classifier(spark, f"{model_dir}/classifier") if tables["parts"].first()["has_classifier"] else None
    return {"scaler": scaler, "centers": np.array(centers, float), "names": [r["class_name"] for r in tables["names"].orderBy("cluster").collect()], "classifier": classifier}


def scored_features(features: DataFrame, model: dict, columns: tuple[str, ...] = F13) -> DataFrame:
    """features with cluster_id, predicted_class (of the cluster) and probabilities, the likeliest class first; then
    classifier_pred and confidence, its class and that class's chance (null without a classifier), and the diagnosis."""
    scaled = features.withColumns({c: (F.col(c) - F.lit(float(mu))) / F.lit(float(sigma) + EPSILON) for c, (mu, sigma) in model["scaler"].items()})
    rows = scaled.withColumn("_d", F.transform(squared_distances(list(columns), model["centers"]), lambda x: F.sqrt(x)))
    rows = rows.withColumn("cluster_id", nearest(F.col("_d"))).withColumn("probabilities", probability_table(model["names"], F.col("_d")))
    names = F.array(*[F.lit(n) for n in model["names"]])
    rows = rows.withColumn("predicted_class", F.element_at(names, F.col("cluster_id") + 1))
    if model.get("classifier") is not None:
        rows = classified(model["classifier"], rows, list(columns), "classifier_pred")
    else:
        rows = rows.withColumns({"classifier_pred": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double")})
    return final_diagnosis(rows, model["names"]).drop("_d", *columns)


def score_images(images: DataFrame, model: dict, keep: tuple[str, ...] = ("path", "file_name")) -> DataFrame:
    """Images (as read or streamed) to predictions; images of other file types or without a valid region have no row."""
    return scored_features(features_f13(to_gray(accepted_uploads(images), keep=keep), keep), model)


def unscorable(images: DataFrame, scored: DataFrame) -> DataFrame:
    """(path, reason) of the images that got no prediction."""
    kinds = F.when(~F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).isin(".png", ".jpg", ".jpeg", ".bmp"), "file type").when(F.col("image.width") <= 0, "not decoded").otherwise("no valid region")
    return images.join(scored.select("path"), "path", "left_anti").select("path", kinds.alias("reason"))


def score_stream(spark: SparkSession, in_dir: str, model_dir: str, out_dir: str, checkpoint_dir: str, once: bool = True) -> StreamingQuery:
    """Appends predictions of arriving images as Parquet. Rows are scored one by one, so there is no state and nothing
    can be late; the checkpoint keeps track of the files that are done."""
    scored = score_images(stream_images(spark, in_dir), load_scorer(spark, model_dir))
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def publish_scorer(root: str, scaler: DataFrame, centers: DataFrame, names: list[str], classifier=None) -> int:
    """Saves a scorer as the next version under root; streams that read root take it from their next batch on."""
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    save_scorer(folder, scaler, centers, names, classifier)
    return publish(scaler.sparkSession, root, folder)


def scored_and_rejected(described: DataFrame, model: dict) -> tuple[DataFrame, DataFrame]:
    """Predictions of images that `described_f13` has looked at, and those that have none with the reason. Keep the rows
    while both are written, and each image is looked at once; batches and streams take their rows from here."""
    rejected = described.filter("reason is not null").drop(*F13)
    return scored_features(described.filter("reason is null").drop("reason"), model), rejected


def score_stream_versions(spark: SparkSession, in_dir: str, model_root: str, out_dir: str, checkpoint_dir: str, once: bool = True, seconds: int = 10) -> StreamingQuery:
    """Scores arriving images with the version of the scorer that is current when a batch begins. Each batch is described
    once and written as <out_dir>/predictions/batch_id=N, with the version's number, and <out_dir>/rejects/batch_id=N. A batch
    that runs again writes its folders anew, so images have one row in one of the two."""
    known: dict[int, dict] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        version, folder = current_version(batch.sparkSession, model_root) or (None, None)
        if version is None:
            raise ValueError(f"no scorer has been published under {model_root}")
        if version not in known:
            known.clear()
            known[version] = load_scorer(batch.sparkSession, folder)
        # the rows are described as they are cached, once for both
        described = described_f13(batch).persist()
        try:
            scored, rejected = scored_and_rejected(described, known[version])
            scored.withColumn("model_version", F.lit(version)).write.mode("overwrite").parquet(f"{out_dir}/predictions/batch_id={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{out_dir}/rejects/batch_id={batch_id}")
        finally:
            described.unpersist()

    images = stream_images(spark, in_dir)
    writer = images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def final_diagnosis(df: DataFrame, names: list[str], classifier: str = "classifier_pred", clusters: str = "cluster_id") -> DataFrame:
    """df with diagnosis: the classifier's class where there is one, else the cluster's."""
    return df.withColumn("diagnosis", F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(F.col(classifier), F.col(clusters)).cast("int") + 1))
