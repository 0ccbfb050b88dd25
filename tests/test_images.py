"""Image sources, kernels and scores on small images that the tests write."""

import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import pixels as K
from scanloom.jobs import features as J
from scanloom.operators import scale, supervised
from scanloom.sources.images import read_images, rejects, to_gray
from scanloom.sources.tables import load_model
from scanloom.streaming.score import load_scorer, save_scorer, score_images, score_stream, unscorable


def png(path, plane):
    """An 8-bit PNG of a grey (rows, columns) or red-green-blue (rows, columns, 3) plane."""
    h, w = plane.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + plane[i].astype(np.uint8).tobytes() for i in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if plane.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def scan(seed, blob=True):
    random = np.random.default_rng(seed)
    y, x = np.mgrid[:128, :128]
    plane = 20 + 90.0 * ((x - 64) ** 2 / 2500 + (y - 64) ** 2 / 3000 < 1)
    if blob:
        plane += 110 * ((x - 50 - seed) ** 2 + (y - 60) ** 2 < 260)
    return np.clip(plane + random.normal(0, 4, plane.shape), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scans") / "Training"
    for i in range(4):
        png(root / "glioma_tumor" / f"a b{i}.png", scan(i))
        png(root / "no_tumor" / f"n{i}.png", scan(i, blob=False))
    png(root / "pituitary_tumor" / "colour.png", np.array([[[255, 0, 0], [0, 0, 255]]]))
    (root / "no_tumor" / "broken.png").write_bytes(b"not an image")
    return str(root.parent)


def test_read_images(spark, folder):
    rows = read_images(spark, folder, drop_invalid=False)
    assert rows.count() == 10
    assert [r.path.rsplit("/", 1)[1] for r in rejects(rows).collect()] == ["broken.png"]
    assert {(r.class_name, r.label, r.split) for r in rows.collect()} == {("glioma_tumor", 0, "Training"), ("no_tumor", 2, "Training"), ("pituitary_tumor", 3, "Training")}
    assert read_images(spark, folder).filter(F.col("file_name") == "a b1.png").count() == 1


def test_to_gray(spark, folder):
    grey = {r.file_name: r for r in to_gray(read_images(spark, folder)).collect()}
    assert all((r.h, r.w, len(r.pixels)) == (128, 128, 128 * 128) for r in grey.values())
    assert grey["a b2.png"].pixels == scan(2).tobytes()
    levels = np.frombuffer(grey["colour.png"].pixels, np.uint8).reshape(128, 128)
    assert (levels == K.resize(np.array([[76, 29]], np.uint8))).all() and levels[0, 0] > levels[0, 64] > levels[0, -1]


@pytest.mark.parametrize("kind", [None, "forest", "logistic"])
def test_scores_of_batch_and_stream_agree(spark, folder, tmp_path, kind):
    features = J.features_f13(to_gray(read_images(spark, folder)), ("path", "class_name")).cache()
    scaler = scale.fit_zscore(features, list(K.F13))
    scaled = scale.apply_zscore(features, scaler)
    centers = scaled.groupBy("class_name").agg(F.array(*[F.avg(c) for c in K.F13]).alias("center")).orderBy("class_name").collect()
    names = [r.class_name for r in centers]
    rows = scaled.withColumn("label", F.array_position(F.array(*map(F.lit, names)), F.col("class_name")).cast("int") - 1)
    fit = {None: lambda: None, "forest": lambda: supervised.random_forest(rows, list(K.F13), trees=9), "logistic": lambda: supervised.logistic_regression(rows, list(K.F13))}[kind]
    model = str(tmp_path / "model")
    save_scorer(model, scaler, spark.createDataFrame([(i, r.center) for i, r in enumerate(centers)], "cluster int, center array<double>"), names, fit())
    assert load_model(spark, model, "scaler")["scaler"].count() == 13
    batch = score_images(read_images(spark, folder, drop_invalid=False), load_scorer(spark, model))
    row = lambda r: (r.predicted_class, round(r.probabilities[0].value, 6), r.classifier_pred, r.confidence and round(r.confidence, 6), r.diagnosis)
    got = {r.file_name: row(r) for r in batch.collect()}
    query = score_stream(spark, folder, model, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert got == {r.file_name: row(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} and len(got) >= 4
    assert all(abs(sum(p.value for p in r.probabilities) - 1) < 1e-9 for r in batch.collect())
    for predicted, _, label, confidence, diagnosis in got.values():
        assert diagnosis == (predicted if kind is None else names[label]) and (confidence is None) == (kind is None)
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in unscorable(read_images(spark, folder, drop_invalid=False), batch).collect()}
    assert reasons["broken.png"] == "not decoded"


def test_kernels():
    random = np.random.default_rng(0)
    noise = random.integers(0, 256, (5, 32, 32)).astype(np.uint8)
    flat = np.full((1, 16, 16), 77, np.uint8)
    assert (K.blur(flat) == 77).all() and (K.equalize_hist(flat) == 0).all() and K.otsu_threshold(K.normalize(flat))[0] == 0
    mask = noise > 150
    assert (K.erode(mask) <= mask).all() and (mask <= K.dilate(mask)).all()
    largest = K.largest_component(mask)
    for m, own in zip(mask, largest, strict=True):
        seen, todo, best = set(), [], []
        for start in map(tuple, np.argwhere(m)):
            if start in seen:
                continue
            part, todo = [], [start]
            seen.add(start)
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= p[0] < 32 and 0 <= p[1] < 32 and m[p] and p not in seen:
                        seen.add(p)
                        todo.append(p)
            if len(part) > len(best):
                best = part
        assert {tuple(p) for p in np.argwhere(own)} == set(best)
    tie = np.zeros((1, 5, 5), bool)
    tie[0, 0, :2] = tie[0, 4, 3:] = True
    assert K.largest_component(tie)[0, 0, 0] and not K.largest_component(tie)[0, 4, 4]
    square = np.zeros((1, 12, 12), bool)
    square[0, 3:9, 3:9] = True
    assert K.border_compactness(square)[0] == pytest.approx(400 / 36, rel=1e-5) and K.edge_compactness(square)[0] == pytest.approx(576 / 36)
    assert K.weighted_perimeter(square)[0] == pytest.approx(20)
    assert K.glcm_features(np.zeros((4, 4), np.uint8)) == (0.0, 1.0, 1.0, 1.0)
    assert K.bounding_box(square[0]) == (3, 3, 9, 9)
    assert K.resize(noise[0][:20, :30], 128).shape == (128, 128)
    assert K.overlay(K.normalize(noise)[0], mask[0]).shape == (32, 32, 3)


def test_feature_table(spark, folder):
    images = to_gray(read_images(spark, folder))
    table = J.feature_table(images, "class_name", "file_name", 2).orderBy("index").collect()
    assert [r["index"] for r in table] == [1, 2, 3, 4, 5] and table[0].mean_text == f"{table[0]['mean']:.4f}"


def test_threshold_of_equal_variances():
    """Two levels of one variance, whose last bits differ: the first, as SQL and exact fractions have it."""
    levels = [
        [0, 110, 119, 152, 195, 148, 225, 75, 216, 103, 187, 111, 171, 203, 255, 189, 199, 50, 45, 157, 85, 167, 198, 61, 196, 94, 138, 118, 53, 75, 229, 164]
        + [240, 217, 145, 160, 48, 202, 50, 213, 140, 153, 119, 170, 154, 80, 36, 220, 111, 51, 195, 160, 65, 142, 206, 159, 103, 201, 93, 118, 55, 117, 135, 130],
        [65, 150, 100, 206, 113, 192, 9, 174, 139, 153, 112, 155, 198, 125, 210, 142, 111, 231, 167, 199, 87, 255, 150, 206, 150, 49, 114, 195, 129, 165, 131, 0]
        + [70, 231, 133, 38, 164, 100, 133, 144, 111, 161, 99, 224, 218, 132, 88, 85, 203, 89, 113, 228, 165, 57, 171, 81, 160, 146, 169, 96, 149, 130, 209, 105],
    ]
    images = K.preprocess(np.array(levels, np.uint8).reshape(-1, 8, 8))
    assert [round(t * 255) for t in K.otsu_threshold(images)] == [120, 116]
    for image, found in zip((images * 255).astype(np.uint8).reshape(-1, 64).astype(int).tolist(), K.otsu_threshold(images), strict=True):
        spread = {}
        for t in range(max(image)):
            below = [v for v in image if v <= t]
            if below and len(below) < 64:
                spread[t] = Fraction((sum(below) * 64 - sum(image) * len(below)) ** 2, len(below) * (64 - len(below)))
        assert min(t for t, v in spread.items() if v == max(spread.values())) == round(found * 255)
