"""Trees, spanning trees and small clusters whose work is done in rounds on Spark, against plain versions of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import features, held, hierarchy, kmeans, spatial
from scanloom.sources.tables import LoopTables, checkpointed

POINT = "id long, size long, center array<double>"


def table(spark, x):
    return spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(x)], POINT).repartition(4)


@pytest.fixture(scope="module")
def x():
    """150 points in three dimensions, a fifth of which lie at two places."""
    random = np.random.default_rng(8)
    x = np.concatenate([random.normal(m, 1.0, (40, 3)) for m in (0, 4, 9)] + [np.tile([2.0, 2.0, 2.0], (19, 1)), np.tile([7.0, 1.0, 0.0], (11, 1))])
    return x[random.permutation(len(x))]


def rows(merges, n):
    """Height and the two sets of points of each merge: merges of one height may have any order."""
    points, out = {i: frozenset([i]) for i in range(n)}, []
    for nth, r in enumerate(merges.orderBy("step").collect()):
        left, right = points.pop(r.left_id), points.pop(r.right_id)
        assert (r.new_id, r.size_left, r.size_right) == (n + nth, len(left), len(right))
        points[r.new_id] = left | right
        out.append((round(r.height, 9), *sorted((left, right), key=min)))
    assert len(points) == 1 and [o[0] for o in out] == sorted(o[0] for o in out)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 16)


def test_ward_in_rounds(spark, x, small_blocks):
    """Rounds over k-d blocks to the end give the merges of the one-by-one rule, points of one place included."""
    few, many = (set(rows(hierarchy.ward(table(spark, x), few=n), len(x))) for n in (6, 1000))
    assert few == many


@pytest.mark.parametrize("ways", [{"MOST_VALUES": 0}, {"AT_HOME": 0}, {}])
def test_ward_by_tables_and_arrays(spark, x, small_blocks, monkeypatch, ways):
    """Rounds on tables, on arrays by jobs, and on arrays at the driver give the merges of the one-by-one rule."""
    expected = set(rows(hierarchy.ward(table(spark, x), few=1000), len(x)))
    for name, value in {"BLOCK": 16, **ways}.items():
        monkeypatch.setattr(held, name, value)
    assert set(rows(hierarchy.ward(table(spark, x), few=6), len(x))) == expected


def test_visits_are_no_rows(spark, monkeypatch):
    """In ten dimensions most blocks are visited, so a tree of 5,000 points must not make a row of each visit."""
    def refused(*_):
        raise AssertionError("visits as rows")

    monkeypatch.setattr(spatial, "_search", refused)
    x = np.random.default_rng(3).normal(size=(5000, 10))
    merges = hierarchy.ward(table(spark, x), few=64)
    sums = merges.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("height") ** 2) / 2).alias("spread")).first()
    assert sums.n == 4999 and sums.spread == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_two_clusters_of_many_points(spark, monkeypatch):
    """What w7_cah_eval asks of a tree: the cut that leaves two clusters, here two groups far apart."""
    monkeypatch.setattr(spatial, "_search", None)
    random = np.random.default_rng(4)
    x = random.permutation(np.concatenate([random.normal(0, 1, (1500, 9)), random.normal(4, 1, (1000, 9))]))
    cut = hierarchy.cut_tree(hierarchy.ward(table(spark, x)), len(x), 2).orderBy("id").collect()
    labels = np.array([r.cluster for r in cut])
    assert [r.id for r in cut] == list(range(2500)) and np.ptp(labels[x.mean(axis=1) > 2]) == np.ptp(labels[x.mean(axis=1) < 2]) == 0 < np.ptp(labels)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_other_owners(spark, monkeypatch, k):
    """Lists of the nearest, by leaves and by jobs, equal brute force; points far from zero and points of one place included."""
    monkeypatch.setattr(held, "BLOCK", 16)
    random = np.random.default_rng(5)
    x = np.concatenate([random.normal(0, 1, (150, 3)), random.integers(0, 3, (50, 3))]) + 1e4
    own, size = random.integers(0, 20, 200), random.integers(1, 5, 200).astype(float)
    for ward in (False, True):
        h = held.Held(np.arange(200), size, x, own)
        d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        d = np.sqrt(2 * size[:, None] * size[None] / (size[:, None] + size[None]) * d2) if ward else np.sqrt(d2)
        d[own[:, None] == own[None]] = np.inf
        expected = np.argsort(d, axis=1, kind="stable")[:, :k]
        for home in (0, held.AT_HOME):
            monkeypatch.setattr(held, "AT_HOME", home)
            other, found = held.search(spark, h, np.arange(200), k, ward)
            assert (h.ids[other] == expected[h.ids]).all() and np.allclose(found, np.take_along_axis(d, expected, axis=1)[h.ids])
    bounded, found = held.search(spark, h, np.arange(200), k, True, np.full(200, 0.5))
    assert ((bounded < 0) == (np.take_along_axis(d, expected, axis=1)[h.ids] > 0.5)).all() and (found[bounded < 0] == np.inf).all()


@pytest.mark.parametrize("home", [0, 1 << 24])
@pytest.mark.parametrize("method", ["average", "complete"])
def test_linkage_keeps_no_pairs(spark, x, monkeypatch, method, home):
    """Pairs are measured when they are asked for: rounds by jobs or at the driver, to the end or to a matrix, give the
    merges of the one-by-one rule, and no table of pairs is made."""
    monkeypatch.setattr(held, "AT_HOME", home)
    monkeypatch.setattr(hierarchy, "_all_pairs", None)
    distinct = np.unique(x, axis=0)
    d = np.sqrt(((distinct[:, None] - distinct[None]) ** 2).sum(axis=2))
    n, points = len(distinct), {i: frozenset([i]) for i in range(len(distinct))}
    expected = set()
    for i, j, height, _, _, new in hierarchy._finish(list(range(n)), [1] * n, d.copy(), method, n):
        points[new] = points[i] | points[j]
        expected.add((round(height, 9), *sorted((points[i], points[j]), key=min)))
    for few in (3, 40) if home else (60,):
        assert set(rows(hierarchy.linkage(table(spark, distinct), method, few), n)) == expected
    assert [r[0] for r in rows(hierarchy.linkage(table(spark, x), method, n), len(x)) if r[0] == 0] == [0.0] * (len(x) - n)


def prim(x):
    d, inside, best, to, total = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.zeros(len(x), bool), np.full(len(x), np.inf), np.zeros(len(x), int), []
    best[0] = 0
    for _ in range(len(x)):
        i = int(np.where(inside, np.inf, best).argmin())
        inside[i] = True
        total.append(best[i])
        nearer = d[i] < best
        best, to = np.where(nearer, d[i], best), np.where(nearer, i, to)
    return sorted(total[1:])


@pytest.mark.parametrize("few", [512, 4])
def test_spanning_tree(spark, x, small_blocks, few):
    edges = hierarchy.spanning_tree(table(spark, x), few).collect()
    assert np.allclose(sorted(e.d for e in edges), prim(x)) and len(edges) == len(x) - 1
    parts = {i: i for i in range(len(x))}

    def root(i):
        while parts[i] != i:
            i = parts[i]
        return i

    for e in edges:
        assert e.i < e.j and root(e.i) != root(e.j)  # no circle
        parts[root(e.i)] = root(e.j)


@pytest.mark.parametrize("home", [0, 1 << 24])
def test_spanning_edges(spark, monkeypatch, home):
    """Points at random, in two groups far apart, with many equal distances and along a growing path, without a row for each
    visit: the edges of the greedy rule, in the order of lengths and ids."""
    monkeypatch.setattr(held, "AT_HOME", home)
    monkeypatch.setattr(held, "BLOCK", 16)
    monkeypatch.setattr(spatial, "_search", None)
    random = np.random.default_rng(6)
    many = random.normal(size=(160, 3))
    kinds = [many, many + np.repeat([0, 50], 80)[:, None], random.permutation(np.unique(random.integers(0, 5, (150, 3)).astype(float), axis=0)), np.cumsum(np.arange(40.0))[:, None], many[:1]]
    for x in kinds[1:3] if home == 0 else kinds:
        i, j = np.triu_indices(len(x), 1)
        d, roots, expected = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)), np.arange(len(x)), []
        for e in np.lexsort((j, i, d)):
            if roots[i[e]] != roots[j[e]]:
                roots[roots == roots[j[e]]] = roots[i[e]]
                expected.append((i[e], j[e]))
        low, high, apart = held.spanning_edges(spark, np.arange(len(x)), x)
        assert sorted(zip(low, high)) == sorted(expected) and np.allclose(apart, np.sqrt(((x[low] - x[high]) ** 2).sum(axis=1)))


@pytest.mark.parametrize("method", ["single", "average"])
def test_linkage_of_what_is_too_much_to_be_held(spark, x, small_blocks, monkeypatch, method):
    some = np.unique(x, axis=0)[:40]
    expected = rows(hierarchy.linkage(table(spark, some), method), 40)
    monkeypatch.setattr(held, "MOST_VALUES", 0)
    assert set(rows(hierarchy.linkage(table(spark, some), method, 16), 40)) == set(expected)


def test_single_linkage_in_rounds(spark, x, small_blocks):
    few, many = (rows(hierarchy.linkage(table(spark, x), "single", n), len(x)) for n in (8, 1000))
    assert {r for r in few if r[0] > 0} == {r for r in many if r[0] > 0}
    assert np.allclose([r[0] for r in few], prim(x))


def test_edges_that_grow_along_a_path(spark):
    """Only one pair is mutual at a time; the rest is sorted on the driver."""
    x = np.cumsum(np.arange(60.0))[:, None]
    assert [r[0] for r in rows(hierarchy.linkage(table(spark, x), "single", 4), 60)] == list(map(float, range(1, 60)))


def visits(spark, n, kept):
    random = np.random.default_rng(1)
    placed = checkpointed(spatial.in_blocks(table(spark, random.random((n, 2))).withColumn("own", F.col("id")), n))
    before, seen = spatial._search, []

    def counted(met, ward):
        seen.append(met.filter("asks").select("block", "center").distinct().count())
        return before(met, ward)

    spatial._search = counted
    try:
        found = spatial.nearest_others(placed, placed, 2, kept, ward=True).collect()
    finally:
        spatial._search = before
    return found, seen[1]


def test_blocks_that_are_visited(spark, monkeypatch):
    """A search equals brute force, and four times the points have about four times the visits, not sixteen."""
    monkeypatch.setattr(spatial, "BLOCK", 32)
    with LoopTables(spark) as kept:
        found, few = visits(spark, 500, kept)
        x = np.random.default_rng(1).random((500, 2))
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        assert {r.id: r.other for r in found} == dict(enumerate(d.argmin(axis=1).tolist()))
        many = visits(spark, 2000, kept)[1]
    assert many < 6 * few


def test_rounds_carry_no_estimates(spark):
    """Twelve rounds of joins: the optimizer's size of the state stays that of its files."""
    with LoopTables(spark) as kept:
        state = kept.put("state", spark.range(50).withColumn("v", F.col("id")))
        digits = []
        for _ in range(12):
            other = state.select("id", F.col("v").alias("w"))
            state = kept.put("state", state.join(other, "id").join(other.withColumnRenamed("w", "u"), "id").select("id", (F.col("v") + F.col("w") - F.col("u")).alias("v")))
            digits.append(len(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        assert max(digits) < 8 and state.filter("v != id").count() == 0


def test_small_clusters(spark):
    """In one read nearly as good as K-Means with all its rounds."""
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_linenumber", *[((F.col(c) - m) / s).alias(c) for c, m, s in (("l_quantity", 25, 14), ("l_extendedprice", 38000, 23000), ("l_discount", 0.05, 0.03), ("l_tax", 0.04, 0.026))]).repartition(20).cache()
    columns = df.columns[2:]
    centers = features.small_clusters(df, columns, 100)
    run = kmeans.kmeans(df.withColumn("id", F.xxhash64("l_orderkey", "l_linenumber")), "id", columns, 100, max_iter=20)
    own, plain = (kmeans.final_inertia(df, columns, [kmeans.Run((), c)])[0].inertia for c in (centers, run.centers))
    assert len(centers) == 100 and own < 1.1 * plain
    found = features.clustering_features(df, columns, 400).toPandas()
    assert found["n"].sum() == df.count() and len(found) <= 400
    assert np.allclose(np.stack(found["sums"]).sum(axis=0), list(df.agg(*[F.sum(c) for c in columns]).first()))


def test_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None), (4, float("nan")), (5, 2.0)], "id long, a double")
    assert sorted(features.small_clusters(df, ["a"], 4)[:, 0]) == [1.0, 2.0]
    assert features.small_clusters(df.filter("id = 3"), ["a"], 4).shape == (0, 1)
    assert features.condensed(np.ones(5, np.int64), np.ones((5, 1)), np.ones(5), 2)[0].tolist() == [5]


def test_skipped_distances(spark):
    """Bounds give the rounds, labels and centers of plain Lloyd, with most distances left out."""
    random = np.random.default_rng(2)
    x = np.concatenate([random.normal(m, 0.5, (120, 3)) for m in range(0, 24, 3)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double").cache()
    start = x[random.choice(len(x), 16, replace=False)]
    plain = kmeans.lloyd(df, ["a", "b", "c"], [kmeans.Run((), start.copy())], max_iter=40)[0]
    own, skipped = kmeans.lloyd_bounded(df, ["a", "b", "c"], kmeans.Run((), start.copy()), max_iter=40)
    assert np.allclose(own.centers, plain.centers) and np.allclose(own.history, plain.history)
    assert skipped > 0.5, skipped


def test_many_runs_at_once(spark):
    """Two hundred runs go as one tensor: their sums equal plain ones."""
    random = np.random.default_rng(4)
    x = random.normal(0, 1, (400, 10))
    columns = [f"f{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], ", ".join(f"{c} double" for c in columns)).cache()
    starts = [x[random.choice(400, k, replace=False)] for k in (2, 3, 5, 8) for _ in range(50)]
    runs = kmeans.lloyd(df, columns, [kmeans.Run((i,), s.copy()) for i, s in enumerate(starts)], max_iter=3)
    for run, centers in zip(runs[::23], starts[::23]):
        for _ in range(3):
            near = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            centers = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        assert np.allclose(run.centers, centers)
        assert run.history[-1] == pytest.approx(((x - centers[near]) ** 2).sum())
