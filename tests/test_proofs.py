"""Queries that SQL can't say, against plain NumPy over the given tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.jobs import queries as Q
from scanloom.operators import kmeans, supervised


@pytest.fixture(scope="module")
def plain(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding[:10] for r in rows], float)
    return [r.vec_id for r in rows], np.array([r.label % 2 for r in rows]), (x - x.mean(axis=0)) / x.std(axis=0)


def axes(z, share):
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    order = np.argsort(-values)
    n = int((np.cumsum(values[order]) / values.sum() < share - 1e-12).sum()) + 1
    return n, z @ vectors[:, order]


def test_axes_of_the_variance(spark, sf, plain):
    """M2: the number of axes, and the first one up to its sign."""
    ids, _, z = plain
    n, projected = axes(z, 0.90)
    found = Q.m2_pca_variance(spark, sf).orderBy("vec_id").collect()
    assert [r.vec_id for r in found] == ids and {r.axes for r in found} == {n}
    own = np.array([r.pc1 for r in found])
    assert np.allclose(np.abs(own @ projected[:, 0]), np.linalg.norm(own) * np.linalg.norm(projected[:, 0]))


def test_starts_are_drawn_by_squared_distance(spark):
    """M4: of many starts, each next center is a row as often as its squared distance from the first says."""
    x = np.array([0.0, 1.0, 2.0, 4.0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, a double").cache()
    runs = kmeans.plus_plus(df, "id", ["a"], {(2, seed): (2, seed) for seed in range(3000)})
    firsts, pairs = np.zeros(4), np.zeros((4, 4))
    for run in runs:
        a, b = (int(np.flatnonzero(x == c[0])[0]) for c in run.centers)
        firsts[a] += 1
        pairs[a, b] += 1
    assert np.abs(firsts / 3000 - 0.25).max() < 0.04
    for a in range(4):
        expected = (x - x[a]) ** 2 / ((x - x[a]) ** 2).sum()
        assert np.abs(pairs[a] / firsts[a] - expected).max() < 0.07


def test_fewer_rows_than_centers(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "id long, a double")
    assert len(kmeans.plus_plus(df, "id", ["a"], {(5, 1): (5, 1)})[0].centers) == 2


def test_importance(spark, sf):
    """T3: the forest's own numbers, the least first."""
    train, _ = Q.learners(spark, sf)
    forest = supervised.random_forest(train, Q.FEATURES, trees=7, depth=4)
    found = [(r.feature, r.importance) for r in supervised.feature_importance(forest, Q.FEATURES, spark).collect()]
    assert found == sorted(zip(Q.FEATURES, forest.featureImportances.toArray().tolist()), key=lambda f: (f[1], f[0]))


def two_clusters(x):
    """Ward's two clusters, merged one by one from the matrix of squared distances (Lance and Williams)."""
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, members = np.ones(len(x)), [[i] for i in range(len(x))]
    for _ in range(len(x) - 2):
        i, j = sorted(divmod(int(d.argmin()), len(x)))
        new = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / (size + size[i] + size[j])
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        members[i] += members[j]
        members[j] = []
    return np.array([next(n for n, m in enumerate(filter(None, members)) if i in m) for i in range(len(x))])


def test_evaluation_of_trees(spark, sf, plain):
    """W7: accuracy, adjusted Rand index and mean silhouette of Ward's two clusters on the axes of 90 % of the variance."""
    _, label, z = plain
    n, projected = axes(z, 0.90)
    x = projected[:, :n]
    cluster = two_clusters(x)
    accuracy = max((cluster == label).mean(), (cluster != label).mean())
    counts = np.array([[((cluster == c) & (label == y)).sum() for y in (0, 1)] for c in (0, 1)])
    pairs = lambda v: (v * (v - 1) / 2).sum()
    rows, columns = pairs(counts.sum(axis=1)), pairs(counts.sum(axis=0))
    expected = rows * columns / (len(x) * (len(x) - 1) / 2)
    rand = (pairs(counts) - expected) / ((rows + columns) / 2 - expected)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own = np.array([d[i, cluster == cluster[i]].sum() / ((cluster == cluster[i]).sum() - 1) for i in range(len(x))])
    other = np.array([d[i, cluster != cluster[i]].mean() for i in range(len(x))])
    found = Q.w7_cah_eval(spark, sf).first()
    assert (found.accuracy, found.ari, found.silhouette) == pytest.approx((accuracy, rand, ((other - own) / np.maximum(own, other)).mean()))


def test_image_of_many_tiles(spark, sf):
    """K10 and K20 at the reference's size: images of 128 x 128 made of the table's, with objects of 300 pixels or more."""
    from scanloom.functions import pixels as K
    from scanloom.jobs import features as J

    small = Q.images8(spark, sf).orderBy("image_id").limit(12).collect()
    rows = [(r.image_id, 128, 128, np.kron(np.frombuffer(r.pixels, np.uint8).reshape(8, 8), np.ones((16, 16), np.uint8)).tobytes()) for r in small]
    df = spark.createDataFrame(rows, "image_id long, h int, w int, pixels binary")
    found = {r.image_id: r for r in J.features_f13(df).collect()}
    masks = {r.image_id: np.frombuffer(r.pixels, np.uint8).reshape(128, 128) > 0 for r in J.stage_planes(df, ("chan_vese",)).collect()}
    assert len(found) >= 6
    for r in rows:
        mask = masks[r[0]]
        if (own := found.get(r[0])) is None:
            continue
        assert mask.sum() >= 16 and own.area_ratio == pytest.approx(mask.mean())
        # one region: all its pixels are reached from one of them, over corners too
        todo, seen = [tuple(np.argwhere(mask)[0])], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in seen or not (0 <= y < 128 and 0 <= x < 128) or not mask[y, x]:
                continue
            seen.add((y, x))
            todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        assert len(seen) == mask.sum() and mask.sum() >= 300
        image = K.preprocess(np.frombuffer(r[3], np.uint8).reshape(1, 128, 128), "symmetric")[0]
        low, high = np.percentile(image[mask], (1, 99))
        values = np.clip(image[mask], low, high)
        assert (own["mean"], own["std"]) == pytest.approx((values.mean(), values.std()))
