"""Agreement of clusters or predictions with true labels. Rows are counted once; all else comes from the counts."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8


def contingency(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """(cluster, label, n): the only shuffle that the other measures need."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, k: int, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(label, pred, n) for all k x k pairs, zeros included."""
    spark = df.sparkSession
    grid = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("label"), (F.col("id") % k).cast("int").alias("pred"))
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def normalised_confusion(matrix: DataFrame) -> DataFrame:
    """matrix with share = n / (row sum + 1e-8)."""
    return matrix.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("label")) + EPSILON))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of each class."""
    rows = matrix.groupBy("label").agg(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("row"))
    columns = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("column"))
    counts = rows.join(columns, "label").select("label", "tp", (F.col("column") - F.col("tp")).alias("fp"), (F.col("row") - F.col("tp")).alias("fn"))
    rates = counts.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)})
    return rates.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON))


def accuracy(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def mark_correct(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """df with a boolean `correct`, to split right from wrong rows."""
    return df.withColumn("correct", F.col(predicted) == F.col(label))


def _matrix(counts: DataFrame) -> tuple[np.ndarray, int]:
    rows = counts.collect()  # k x k
    size = max([-1, *(r["cluster"] for r in rows), *(r["label"] for r in rows)]) + 1
    matrix = np.zeros((size, size), np.int64)
    for r in rows:
        matrix[r["cluster"], r["label"]] += r["n"]
    return matrix, int(matrix.sum())


def align_clusters(counts: DataFrame, k: int) -> tuple[list[int], float]:
    """The permutation (class of each cluster) of most agreement, the lexicographically first of equal ones, and its
    accuracy; without any agreement the identity and 0. All k! are tried, on k x k counts: for k up to 6."""
    if k > 6:
        raise ValueError("use align_clusters_assignment for more than 6 clusters")
    rows = counts.collect()
    matrix, total = np.zeros((k, k), np.int64), sum(r["n"] for r in rows)
    for r in rows:
        if 0 <= r["cluster"] < k and 0 <= r["label"] < k:
            matrix[r["cluster"], r["label"]] += r["n"]
    best, hits = list(range(k)), 0
    for order in permutations(range(k)):
        if (n := int(matrix[range(k), order].sum())) > hits:
            best, hits = list(order), n
    return best, hits / total if total else 0.0


def assignment(gain: np.ndarray) -> list[int]:
    """The column of each row, all different, of the largest total gain: shortest augmenting paths with potentials."""
    n = len(gain)
    cost = gain.max(initial=0) - gain.astype(float)
    row_of = np.full(n, -1)
    u, v = np.zeros(n), np.zeros(n)
    for row in range(n):
        least, before, used = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        current, column = row, -1
        while True:
            if column >= 0:
                used[column] = True
                current = row_of[column]
            slack = np.where(used, np.inf, cost[current] - u[current] - v)
            better = slack < least
            least[better & ~used] = slack[better & ~used]
            before[better & ~used] = column
            step_to = int(np.where(used, np.inf, least).argmin())
            delta = least[step_to]
            u[row] += delta
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            column = step_to
            if row_of[column] < 0:
                break
        while column >= 0:
            previous = before[column]
            row_of[column] = row if previous < 0 else row_of[previous]
            column = previous
    columns = np.empty(n, int)
    columns[row_of] = np.arange(n)
    return columns.tolist()


def align_clusters_assignment(counts: DataFrame) -> tuple[list[int], float]:
    """Optimal one-to-one map of clusters to classes, of any number, and its accuracy."""
    matrix, total = _matrix(counts)
    if not total:
        return [], 0.0
    order = assignment(matrix)
    return order, float(matrix[range(len(order)), order].sum()) / total


def map_clusters(df: DataFrame, order: list[int], cluster: str = "cluster", predicted: str = "pred") -> DataFrame:
    """df with the class that its cluster is mapped to; the map has one entry per cluster and is a literal."""
    return df.withColumn(predicted, F.element_at(F.array(*[F.lit(int(c)) for c in order]), F.col(cluster).cast("int") + 1))


def adjusted_rand(counts: DataFrame) -> DataFrame:
    """The adjusted Rand index, one row."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = counts.agg(F.sum(pairs("n")).alias("together"), F.sum("n").alias("total"))
    rows = counts.groupBy("cluster").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("in_clusters"))
    columns = counts.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("in_labels"))
    one = cells.join(rows).join(columns)  # one row each
    expected = F.col("in_clusters") * F.col("in_labels") / pairs("total")
    spread = (F.col("in_clusters") + F.col("in_labels")) / 2 - expected
    return one.select(F.when(spread == 0, 1.0).otherwise((F.col("together") - expected) / spread).alias("ari"))


def dominant_class(counts: DataFrame) -> DataFrame:
    """(cluster, dominant): the class of most rows, the last by name of equal ones. counts has names in `label`."""
    return counts.groupBy("cluster").agg(F.coalesce(F.max_by("label", F.struct("n", "label")), F.lit("indetermine")).alias("dominant"))


def purity(counts: DataFrame) -> DataFrame:
    best = counts.groupBy("cluster").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return best.agg((F.sum("best") / F.sum("size")).alias("purity"))


def cluster_cards(counts: DataFrame, classes: DataFrame, keep_zeros: bool = False) -> DataFrame:
    """One row per cluster: cluster_id, label (counted from 1), count, mapped_class, distribution in class order.

    counts has class names in `label`; classes is (class_id, class_name)."""
    clusters = counts.select("cluster").distinct()
    full = clusters.join(F.broadcast(classes)).join(counts.withColumnRenamed("label", "class_name"), ["cluster", "class_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    entry = F.struct("class_id", F.col("class_name").alias("name"), F.col("n").alias("count"))
    cards = full.groupBy("cluster").agg(F.sum("n").alias("count"), F.max_by("class_name", F.struct("n", "class_name")).alias("mapped_class"), F.sort_array(F.collect_list(F.when(F.lit(keep_zeros) | (F.col("n") > 0), entry))).alias("distribution"))
    label = F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string"))
    return cards.select(F.col("cluster").alias("cluster_id"), label.alias("label"), "count", "mapped_class", F.transform("distribution", lambda d: d.dropFields("class_id")).alias("distribution"))


def cluster_class_precision(counts: DataFrame, order: list[int]) -> DataFrame:
    """(cluster, assigned, correct, total, pct) of each cluster of the map; an empty cluster has 0."""
    spark = counts.sparkSession
    assigned = spark.createDataFrame(list(enumerate(order)), "cluster int, assigned int")
    found = assigned.join(counts, "cluster", "left").groupBy("cluster", "assigned").agg(F.coalesce(F.sum(F.when(F.col("label") == F.col("assigned"), F.col("n"))), F.lit(0)).alias("correct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return found.withColumn("pct", F.when(F.col("total") == 0, 0.0).otherwise(100 * F.col("correct") / F.col("total")))


def roc_curve(df: DataFrame, score: str, positive: Column, n: int = 200) -> DataFrame:
    """(threshold, fpr, tpr) at n thresholds from 0 to 1; a row is called positive if its score is below the threshold,
    so the score must be the chance of the negative class. One pass: each row counts at the first threshold above it."""
    spark = df.sparkSession
    thresholds = [i / (n - 1) for i in range(n)]
    # array positions: the number of thresholds that are not above the score
    level = F.least(F.greatest(F.floor(F.col(score) * (n - 1)).cast("int") - 1, F.lit(0)), F.lit(n - 1))
    steps = F.array(*[F.lit(t) for t in thresholds])
    first = level + F.size(F.filter(F.slice(steps, level + 1, 4), lambda t: t <= F.col(score)))
    counts = df.select(F.when(F.col(score) < 0, 0).when(F.col(score) >= 1, n).otherwise(first).alias("i"), positive.cast("int").alias("p")).groupBy("i").agg(F.sum("p").alias("tp"), F.sum(1 - F.col("p")).alias("fp"))
    grid = spark.createDataFrame([(i, t) for i, t in enumerate([*thresholds, float("inf")])], "i int, threshold double")
    running = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = grid.join(counts, "i", "left").fillna(0, ["tp", "fp"])  # n + 1 rows
    rate = lambda c: F.sum(c).over(running) / (F.sum(c).over(whole) + EPSILON)
    return filled.select("i", "threshold", rate("fp").alias("fpr"), rate("tp").alias("tpr")).filter(F.col("i") < n).drop("i")


def auc(curve: DataFrame) -> DataFrame:
    """Area under a curve by trapezoids, in the order of (fpr, tpr)."""
    order = Window.orderBy("fpr", "tpr")
    steps = curve.select("fpr", "tpr", F.lag("fpr").over(order).alias("x"), F.lag("tpr").over(order).alias("y"))
    return steps.agg(F.coalesce(F.sum((F.col("fpr") - F.col("x")) * (F.col("tpr") + F.col("y")) / 2), F.lit(0.0)).alias("auc"))


def evaluate_models(predictions: DataFrame) -> DataFrame:
    """predictions: model, label, pred (0 or 1). Accuracy, and precision, recall and F1 of class 0; the best are flagged."""
    hit = lambda c: F.count_if(c)
    zero, said = F.col("label") == 0, F.col("pred") == 0
    counts = predictions.groupBy("model").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), hit(zero & said).alias("tp"), hit(~zero & said).alias("fp"), hit(zero & ~said).alias("fn"))
    rates = counts.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)})
    rates = rates.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON))
    return rates.select("model", "accuracy", "precision", "recall", "f1").withColumn("best", F.col("accuracy") == F.max("accuracy").over(Window.partitionBy()))


#: Rows of a block of the exact silhouette, and the most rows that it takes.
BLOCK, MOST_ROWS = 2048, 500_000


def silhouette_squared(df: DataFrame, id_column: str, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(id, cluster, silhouette) with squared Euclidean distances, for any number of rows: a row's mean squared distance to
    a cluster follows from the cluster's mean and mean squared norm, one row for each cluster (k of them, broadcast)."""
    square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x)
    points = df.select(F.col(id_column).alias("id"), F.col(cluster).alias("c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    sums = points.groupBy(F.col("c").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.avg(square("x")).alias("squares"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(columns))])
    clusters = sums.select("o", "n", "squares", F.array(*[f"m{i}" for i in range(len(columns))]).alias("m"))
    dot = F.aggregate(F.zip_with("x", "m", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = points.join(F.broadcast(clusters)).select("id", "c", "o", "n", F.greatest(square("x") - 2 * dot + F.col("squares"), F.lit(0.0)).alias("d"))
    own = F.col("o") == F.col("c")
    means = rows.groupBy("id", "c").agg(F.max(F.when(own, F.col("n"))).alias("own"), F.max(F.when(own & (F.col("n") > 1), F.col("d") * F.col("n") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    return means.select(F.col("id").alias(id_column), F.col("c").alias(cluster), _silhouette_of().alias("silhouette"))


def _silhouette_of() -> Column:
    """(b - a) / max(a, b) of the columns own, a and b; 0 for a row alone, without another cluster, or with no distance."""
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return F.when((F.col("own") == 1) | F.col("b").isNull(), 0.0).otherwise(value)


def silhouette(df: DataFrame, id_column: str, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(id, cluster, silhouette) with Euclidean distances. Blocks of rows meet in pairs; a block pair sums each row's
    distances by the other rows' cluster, so what is shuffled grows with rows x blocks x clusters, not with pairs. Each
    row is copied once a block, so more than MOST_ROWS are refused: `silhouette_squared` needs no pairs."""
    n = df.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows: all pairs of more than {MOST_ROWS} are too many; use silhouette_squared")
    blocks = -(-max(n, 1) // BLOCK)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    points = df.select(F.col(id_column).cast("long").alias("id"), F.col(cluster).cast("int").alias("c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # columns of its own for either side, as a plan that holds the same ones on both may lose some
    left = points.select("id", "c", "x", block.alias("a"), every.alias("b"))
    right = points.select(F.col("c").alias("o"), F.col("x").alias("y"), block.alias("b"), every.alias("a"))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "c": [], "o": [], "d": []}).astype({"id": "int64", "c": "int32", "o": "int32", "d": "float64"})
        x, y = np.stack(left["x"].to_numpy()), np.stack(right["y"].to_numpy())
        out = []
        for o, at in right.groupby("o").indices.items():
            d = np.concatenate([np.sqrt(((x[i : i + 64, None, :] - y[None, at, :]) ** 2).sum(axis=2)).sum(axis=1) for i in range(0, len(x), 64)])
            out.append(pd.DataFrame({"id": left["id"], "c": left["c"], "o": o, "d": d}))
        return pd.concat(out).astype({"o": "int32", "c": "int32"})

    summed = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(sums, "id long, c int, o int, d double").groupBy("id", "c", "o").agg(F.sum("d").alias("d"))
    sizes = points.groupBy(F.col("c").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    means = summed.join(sizes, "o").groupBy("id", "c").agg(
        F.max(F.when(F.col("o") == F.col("c"), F.col("n"))).alias("own"),
        F.max(F.when((F.col("o") == F.col("c")) & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("o") != F.col("c"), F.col("d") / F.col("n"))).alias("b"),
    )
    return means.select(F.col("id").alias(id_column), F.col("c").alias(cluster), _silhouette_of().alias("silhouette"))
