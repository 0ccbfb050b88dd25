"""Streams that write predictions and rejects, and take a new scorer between two batches."""

import pytest
from pyspark.sql import functions as F

from scanloom.functions import pixels as K
from scanloom.jobs import features as J
from scanloom.operators import scale, supervised
from scanloom.sources import tables
from scanloom.sources.images import read_images, to_gray, with_path_parts
from scanloom.streaming.score import load_scorer, publish_scorer, score_stream_versions, scored_and_rejected
from test_images import png, scan


@pytest.fixture
def trained(spark, tmp_path):
    """A scaler, two centers and two forests: the second has the classes the other way round."""
    root = tmp_path / "train" / "Training"
    for i in range(4):
        png(root / "glioma_tumor" / f"g{i}.png", scan(i))
        png(root / "no_tumor" / f"n{i}.png", scan(i, blob=False))
    rows = J.features_f13(to_gray(read_images(spark, str(root.parent))), ("path", "class_name")).cache()
    scaler = scale.fit_zscore(rows, list(K.F13))
    scaled = scale.apply_zscore(rows, scaler).withColumn("label", (F.col("class_name") == "no_tumor").cast("int"))
    centers = scaled.groupBy("label").agg(F.array(*[F.avg(c) for c in K.F13]).alias("center")).orderBy("label").select(F.col("label").alias("cluster"), "center")
    forests = [supervised.random_forest(scaled.withColumn("label", y), list(K.F13), trees=5, depth=3) for y in (F.col("label"), 1 - F.col("label"))]
    return scaler, centers, ["tumor", "no_tumor"], forests


def arrive(folder, i):
    png(folder / "Training" / "x" / f"blob{i}.png", scan(i))
    png(folder / "Training" / "x" / f"flat{i}.png", scan(0) * 0)
    (folder / "Training" / "x" / f"broken{i}.png").write_bytes(b"no image")
    (folder / "Training" / "x" / f"notes{i}.txt").write_bytes(b"text")


def test_swap_between_batches(spark, trained, tmp_path):
    scaler, centers, names, forests = trained
    root, folder, out = str(tmp_path / "models"), tmp_path / "in", str(tmp_path / "out")
    assert tables.current_version(spark, root) is None
    assert publish_scorer(root, scaler, centers, names, forests[0]) == 1
    arrive(folder, 1)
    query = score_stream_versions(spark, str(folder), root, out, str(tmp_path / "state"), once=False, seconds=1)
    try:
        query.processAllAvailable()
        assert publish_scorer(root, scaler, centers, names, forests[1]) == 2
        arrive(folder, 2)
        query.processAllAvailable()
    finally:
        query.stop()
    found = {r.file_name: r for r in spark.read.parquet(f"{out}/predictions").collect()}
    assert {n: r.model_version for n, r in found.items()} == {"blob1.png": 1, "blob2.png": 2}
    assert found["blob1.png"].diagnosis != found["blob2.png"].diagnosis
    rejects = {r.file_name: r.reason for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert rejects == {f"{n}{i}.{e}": why for i in (1, 2) for n, e, why in (("flat", "png", "no valid region"), ("broken", "png", "not decoded"), ("notes", "txt", "file type"))}

    # a batch over the same files gives the same rows and reasons
    images = spark.read.format("image").option("recursiveFileLookup", True).load(str(folder))
    described = J.described_f13(with_path_parts(images, "image.origin")).cache()
    for version in (1, 2):
        folder_of = spark.read.text(f"{root}/manifests/{version:08d}").first()["value"]
        scored, rejected = scored_and_rejected(described, load_scorer(spark, folder_of))
        assert {r.file_name: r.reason for r in rejected.collect()} == rejects
        for r in scored.filter(F.col("file_name") == f"blob{version}.png").collect():
            own = found[r.file_name]
            assert (r.diagnosis, r.cluster_id, round(r.confidence, 9)) == (own.diagnosis, own.cluster_id, round(own.confidence, 9))


def test_a_version_is_never_lost(spark, tmp_path, monkeypatch):
    """Two that publish at once get a number each, whatever either saw as the latest."""
    root = str(tmp_path / "models")
    assert tables.publish(spark, root, "a") == 1
    monkeypatch.setattr(tables, "current_version", lambda *_: None)
    assert tables.publish(spark, root, "b") == 2
    monkeypatch.undo()
    assert tables.current_version(spark, root) == (2, "b")


def test_no_scorer(spark, tmp_path):
    arrive(tmp_path / "in", 1)
    query = score_stream_versions(spark, str(tmp_path / "in"), str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match="no scorer"):
        query.awaitTermination(60)
