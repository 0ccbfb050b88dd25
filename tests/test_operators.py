"""Clustering, trees, evaluation and learners against plain loops."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import cohort, evaluate, hierarchy, kmeans, numbering, scale, spatial, supervised
from scanloom.sources import tables
from scanloom.sources.tables import checkpointed

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    random = np.random.default_rng(3)
    x = np.concatenate([random.normal(m, 0.4, (12, 3)) for m in (0, 3, 6)])
    return spark.createDataFrame([(i, i // 12, *map(float, p)) for i, p in enumerate(x)], "id long, label int, a double, b double, c double").cache()


def plain(points):
    return np.array([[r.a, r.b, r.c] for r in points.orderBy("id").collect()])


def greedy(x, method):
    d, alive, out, new = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), {i: [i] for i in range(len(x))}, [], len(x)

    def apart(p, q):
        if method == "ward":
            return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(0) - x[q].mean(0))
        m = d[np.ix_(p, q)]
        return {"single": m.min(), "complete": m.max(), "average": m.mean()}[method]

    while len(alive) > 1:
        ids = sorted(alive)
        h, i, j = min((apart(alive[p], alive[q]), p, q) for n, p in enumerate(ids) for q in ids[n + 1 :])
        out.append((i, j, h))
        alive[new] = alive.pop(i) + alive.pop(j)
        new += 1
    return out


@pytest.mark.parametrize("few", [0, 512])
@pytest.mark.parametrize("method", ["ward", "average", "single", "complete"])
def test_trees(points, method, few):
    some = points.filter("id % 4 = 0")
    numbered = checkpointed(hierarchy.numbered_points(some, "id", COLUMNS))
    merges = hierarchy.ward(numbered, few) if method == "ward" else hierarchy.linkage(numbered, method, few)
    rows = merges.orderBy("step").collect()
    for row, (i, j, h) in zip(rows, greedy(plain(some), method), strict=True):
        assert (row.left_id, row.right_id) == (i, j) and row.height == pytest.approx(h)
    assert hierarchy.choose_cluster_count(merges).first().k in (2, 3)
    cut = hierarchy.cut_tree(merges, 9, 3).orderBy("id").collect()
    assert [r.cluster for r in cut] == [0, 0, 0, 1, 1, 1, 2, 2, 2] or len({tuple(r.cluster for r in cut[i : i + 3]) for i in (0, 3, 6)}) == 3


def test_ward_large(points):
    merges, own = hierarchy.ward_large(points, "id", COLUMNS, 6)
    assert own.count() == 36 and merges.count() == own.select("micro").distinct().count() - 1


def test_kmeans(points):
    run = kmeans.kmeans_multi(points, "id", COLUMNS, 3, n_init=4)
    labels = kmeans.predict(points, COLUMNS, run.centers)
    assert evaluate.align_clusters(evaluate.contingency(labels), 3)[1] == 1.0
    assert all(a >= b - 1e-9 for a, b in zip(run.history, run.history[1:]))
    table = {r.k: r.inertia for r in kmeans.elbow(points, "id", COLUMNS, range(2, 5), n_init=3).collect()}
    assert table[2] > table[3] >= table[4]
    same = kmeans.kmeans(points, "id", COLUMNS, 2)
    assert np.allclose(same.centers, kmeans.kmeans(points, "id", COLUMNS, 2).centers)


def test_empty_cluster_keeps_its_center(points):
    run = kmeans.kmeans_from(points, COLUMNS, np.array([[0.0] * 3, [1e6] * 3]), max_iter=2)
    assert run.centers[1].tolist() == [1e6] * 3


def test_assignment():
    random = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        gain = random.integers(0, 9, (n, n))
        best = max(gain[range(n), p].sum() for p in permutations(range(n)))
        order = evaluate.assignment(gain)
        assert sorted(order) == list(range(n)) and gain[range(n), order].sum() == best


def test_agreement(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0), (2, 2)], "cluster int, label int")
    counts = evaluate.contingency(rows)
    assert evaluate.align_clusters(counts, 3) == ([1, 0, 2], 1.0) == evaluate.align_clusters_assignment(counts)
    assert evaluate.adjusted_rand(counts).first().ari == pytest.approx(1.0)
    assert evaluate.align_clusters(counts.filter("cluster = 9"), 3) == ([0, 1, 2], 0.0)


def test_scaling(points):
    scaled = scale.apply_zscore(points, scale.fit_zscore(points, COLUMNS))
    row = scaled.agg(*[F.avg(c).alias(f"m{c}") for c in COLUMNS], *[F.stddev_pop(c).alias(f"s{c}") for c in COLUMNS]).first()
    assert np.allclose(list(row), [0, 0, 0, 1, 1, 1])
    projected, shares = scale.pca(scaled, COLUMNS, 2)
    assert shares[0] > 80 and abs(projected.agg(F.avg("pc1")).first()[0]) < 1e-9


def test_split_sizes(points):
    split = {(r.label, r.split): r["count"] for r in cohort.stratified_split(points, "label", "id").groupBy("label", "split").count().collect()}
    assert split == {(i, s): n for i in range(3) for s, n in (("test", 2), ("train", 10))}


def test_unknown_class(points):
    with pytest.raises(ValueError):
        cohort.only_class(points, points.select(F.col("label").alias("class_name")), "9", "label")


def test_learners(points):
    rows = scale.apply_zscore(points, scale.fit_zscore(points, COLUMNS)).withColumn("label", (F.col("label") > 0).cast("int"))
    forest = supervised.random_forest(rows, COLUMNS, trees=5, depth=3)
    for out in (supervised.probabilities(forest, rows, COLUMNS), supervised.probabilities(supervised.logistic_regression(rows, COLUMNS), rows, COLUMNS), supervised.FourierSVM(COLUMNS, 32, max_iter=10).fit(rows).transform(rows)):
        assert evaluate.accuracy(out).first().accuracy > 0.9
    assert supervised.feature_importance(forest, COLUMNS, rows.sparkSession).count() == 3


def test_classifiers_are_saved(points, tmp_path, spark):
    rows = scale.apply_zscore(points, scale.fit_zscore(points, COLUMNS)).withColumn("label", (F.col("label") > 0).cast("int"))
    models = supervised.random_forest(rows, COLUMNS, trees=5, depth=3), supervised.logistic_regression(rows, COLUMNS), supervised.FourierSVM(COLUMNS, 16, max_iter=10).fit(rows)
    for i, model in enumerate(models):
        supervised.save_classifier(model, str(tmp_path / f"{i}"))
        again = supervised.load_classifier(spark, str(tmp_path / f"{i}"))
        found = [sorted(map(tuple, supervised.classified(m, rows, COLUMNS).select("id", "pred", "confidence").collect())) for m in (model, again)]
        assert found[0] == found[1]
    with pytest.raises(ValueError):
        supervised.save_classifier(object(), str(tmp_path / "no"))


def test_numbers_and_percentiles(spark):
    random = np.random.default_rng(5)
    values = [(int(g), float(v)) for g, v in zip(random.integers(0, 3, 400), random.integers(0, 50, 400))]
    df = spark.createDataFrame([*values, (7, 1.5), (8, None)], "g int, v double").repartition(7)
    order = [r.v for r in numbering.numbered(df.filter("v is not null"), ["v"], "at").orderBy("at").collect()]
    assert order == sorted(v for _, v in [*values, (7, 1.5)])
    found = {r.g: (r.low, r.high) for r in numbering.percentiles(df, "g", "v", {"low": 0.01, "high": 0.82}).collect()}
    for g in range(3):
        assert found[g] == pytest.approx(tuple(np.percentile([v for x, v in values if x == g], (1, 82))))
    assert found[7] == (1.5, 1.5) and 8 not in found


def test_many_centers(points, monkeypatch):
    """A broadcast matrix gives what literals give, and oversampled starts are rows of the table."""
    monkeypatch.setattr(kmeans, "IN_EXPRESSION", 2)
    x = plain(points)
    run = kmeans.kmeans(points, "id", COLUMNS, 3)
    assert evaluate.align_clusters(evaluate.contingency(kmeans.predict(points, COLUMNS, run.centers)), 3)[1] == 1.0
    start = kmeans.oversampled(points, "id", COLUMNS, 8)
    assert all((np.abs(x - c).sum(axis=1) < 1e-12).any() for c in start.centers) and len(start.centers) == 8
    located = {r.id: (r.cluster, r.d2) for r in kmeans.located(points, COLUMNS, start.centers).collect()}
    monkeypatch.setattr(kmeans, "IN_EXPRESSION", 50)
    for r in kmeans.predict(points, COLUMNS, start.centers).collect():
        assert located[r.id] == (r.cluster, pytest.approx(r.d2))
    assert kmeans.oversampled(points, "id", COLUMNS, 500).centers.shape[0] <= 36


def test_too_many_points_are_refused(points, monkeypatch):
    numbered = checkpointed(hierarchy.numbered_points(points, "id", COLUMNS))
    monkeypatch.setattr(spatial, "MOST_BLOCKS", 2)
    monkeypatch.setattr(spatial, "BLOCK", 4)
    monkeypatch.setattr(hierarchy, "MOST_LINKED", 9)
    monkeypatch.setattr(evaluate, "MOST_ROWS", 9)
    for refused in (lambda: hierarchy.ward(numbered, 2), lambda: hierarchy.linkage(numbered), lambda: evaluate.silhouette(points, "id", COLUMNS, "label")):
        with pytest.raises(ValueError):
            refused()


def test_tables_are_written_and_read(points, tmp_path, spark):
    for kind in ("parquet", "json"):
        tables.write_feature_table(points, str(tmp_path / kind), kind)
        assert tables.read_feature_table(spark, str(tmp_path / kind), kind).count() == 36
    (tmp_path / "rows.json").write_text('{"rows": [{"index": 1, "mean": 0.5}, {"index": 2, "mean": 0.25}]}')
    assert [r["mean"] for r in tables.read_feature_table(spark, str(tmp_path / "rows.json"), "rows").orderBy("index").collect()] == [0.5, 0.25]
    counts = spark.createDataFrame([(0, "a", 3), (1, "b", 2), (1, "a", 1)], "cluster int, label string, n long")
    cards = evaluate.cluster_cards(counts, spark.createDataFrame([(0, "a"), (1, "b")], "class_id int, class_name string"))
    tables.write_cluster_summary(cards, "largest gap", str(tmp_path / "summary"))
    row = spark.read.json(str(tmp_path / "summary")).first()
    assert (row.cluster_count, row.purity_percent, len(row.cluster_cards)) == (2, 83.33, 2)
