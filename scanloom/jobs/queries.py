"""The registered queries of the image analytics: each runs an operator over a whole given table.

`embeddings` serves as feature matrix with true classes, and, stretched to grey levels, as images of 8 x 8 pixels;
`documents` stands for files in class folders, `pages` for paths, `labels` for a binary target, `conversations` for logs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import expressions as X
from scanloom.jobs import features as J
from scanloom.operators import cohort, evaluate, hierarchy, kmeans, scale, supervised
from scanloom.operators.numbering import numbered, percentiles
from scanloom.sources.images import read_images, to_gray, with_path_parts, write_pngs
from scanloom.sources.tables import checkpointed, cluster_summary, remove_folder, shared_folder
from scanloom.streaming import score

FEATURES = [f"f{i}" for i in range(10)]
#: Digits that queries and their SQL are rounded to.
DIGITS = 5
#: Heights at which parts of a tree are counted.
PART_HEIGHTS = (1.0, 1.4, 1.7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (0 to 3) and the first ten components as columns."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(FEATURES)])


def images8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, h, w, pixels: each vector stretched to 0..255, as 8 x 8 grey levels."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    low, high = F.array_min("e"), F.array_max("e")
    level = F.transform("e", lambda x: F.when(F.col("high") > F.col("low"), F.floor(255 * (x - F.col("low")) / (F.col("high") - F.col("low")))).otherwise(0).cast("long"))
    packed = F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", e.alias("e")).withColumns({"low": low, "high": high}).withColumn("v", level)
    return rows.select("image_id", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), packed.alias("pixels"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: split by id, class by language, name from id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "Testing").otherwise("Training").alias("split"), F.concat(F.lit("class_"), F.coalesce("lang", F.lit("none"))).alias("class_name"), F.format_string("Img_%08d.png", "doc_id").alias("file_name"), F.coalesce("n_chars", F.lit(0)).alias("score"))


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def first_centers(df: DataFrame, k: int, id_column: str = "vec_id") -> np.ndarray:
    """The rows of the k least ids."""
    return np.array([[r[c] for c in FEATURES] for r in df.orderBy(id_column).limit(k).collect()])


def scaled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = matrix(spark, sf_dir)
    return scale.apply_zscore(df, scale.fit_zscore(df, FEATURES))


def clustered(spark: SparkSession, sf_dir: str, rounds: int = 150) -> tuple[DataFrame, kmeans.Run, DataFrame]:
    """Scaled rows, the run from the first four rows until its centers rest, and the rows with their cluster."""
    df = checkpointed(scaled_matrix(spark, sf_dir))
    run = kmeans.kmeans_from(df, FEATURES, first_centers(df, 4), max_iter=rounds)
    return df, run, kmeans.predict(df, FEATURES, run.centers)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = clustered(spark, sf_dir)
    order, _ = evaluate.align_clusters(evaluate.contingency(rows), 4)
    return evaluate.map_clusters(rows, order)


# --- flagship -----------------------------------------------------------------------------------------------------------


def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, cluster from given centers, align clusters with classes: the normalised confusion matrix with the accuracy."""
    rows = aligned(spark, sf_dir)
    cells = evaluate.normalised_confusion(evaluate.confusion_matrix(rows, 4))
    return rounded(cells.join(evaluate.accuracy(rows)), "share", "accuracy")  # one row


# --- cohort -------------------------------------------------------------------------------------------------------------


def a1_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(0, "class_en"), (1, "class_de"), (2, "class_none"), (3, "class_missing")], "class_id int, class_name string")
    return cohort.class_counts(files(spark, sf_dir), classes)


def a2_binary_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.binary_class_counts(files(spark, sf_dir).withColumn("class_name", F.when(F.col("class_name") == "class_fr", "No_Tumor").otherwise("glioma_tumor")))


def a3_split_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.split_class_counts(files(spark, sf_dir))


def p1_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("class_name", F.when(F.col("class_name") == "class_fr", "x_no_tumor").otherwise(F.col("class_name")))
    return cohort.binary_label(rows).select("doc_id", "binary")


def p2_resolve_class_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.concat(F.upper("source"), F.lit("_scans")).alias("dir")).distinct()
    expected = spark.createDataFrame([("src1",), ("src19",), ("src7_scans_extra",), ("absent",)], "class_name string")
    return cohort.resolve_class_dirs(found, expected)


def p5_only_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return cohort.only_class(rows, rows.select("class_name").distinct(), "class_de").select("doc_id", "class_name")


def wd_first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.first_per_class(files(spark, sf_dir), "class_name", "file_name", 8).select("class_name", "file_name", "nth")


def t1_select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.select_best(files(spark, sf_dir).select("doc_id", "class_name", "score"), "class_name", "doc_id", "score", 50).select("doc_id", "class_name", "score", "kept", "nth")


def r2_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.stratified_split(files(spark, sf_dir).select("doc_id", "class_name"), "class_name", "doc_id")


def r3_unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return cohort.unselected(rows, cohort.first_per_class(rows, "class_name", "file_name", 8), "doc_id").select("doc_id")


def s7_accepted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".jpg", ".webp", ".gif", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return cohort.accepted_uploads(table(spark, sf_dir, "pages").select("page_id", F.concat("url", kinds).alias("path")))


def s1_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = files(spark, sf_dir).select("doc_id", F.concat_ws("/", F.lit("file:/data"), "split", "class_name", F.concat(F.lit("a%20b_"), "file_name")).alias("origin"))
    return with_path_parts(paths, "origin").select("doc_id", "split", "class_name", "file_name")


# --- scaling ------------------------------------------------------------------------------------------------------------


def a4_fit_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scale.fit_zscore(matrix(spark, sf_dir), FEATURES), "mu", "sigma")


def a5_apply_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = matrix(spark, sf_dir)
    return rounded(scale.apply_zscore(df, scale.fit_zscore(df, FEATURES), scale.EPSILON).select("vec_id", *FEATURES), *FEATURES)


def a4_lineitem_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scale.fit_zscore(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "mu", "sigma", digits=4)


def a6_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scale.class_profile(matrix(spark, sf_dir), "label", FEATURES), "value")


def a20_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scale.covariance(matrix(spark, sf_dir), FEATURES), "cov")


def x11_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(percentiles(matrix(spark, sf_dir), "label", "f0", {f"p{p}": p / 100 for p in (1, 82, 99)}), "p1", "p82", "p99")


def m1_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected, shares = scale.pca(scaled_matrix(spark, sf_dir), FEATURES, 3)
    return rounded(projected.select("vec_id", "label", "pc1", "pc2", "pc3").withColumns({f"explained{i + 1}": F.lit(s) for i, s in enumerate(shares)}), "pc1", "pc2", "pc3")


def m2_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected, n = scale.pca_variance(scaled_matrix(spark, sf_dir), FEATURES)
    return projected.select("vec_id", F.lit(n).alias("axes"), "pc1")


def m3_project_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, run, _ = clustered(spark, sf_dir)
    return scale.project_centers(kmeans.center_table(df, run), FEATURES, df)


# --- clustering ---------------------------------------------------------------------------------------------------------


def m5_kmeans_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, run, rows = clustered(spark, sf_dir, 1)
    return rounded(rows.select("vec_id", "cluster", "d2"), "d2", digits=4)


def m5_kmeans_three_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = clustered(spark, sf_dir, 3)
    return rounded(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in FEATURES]), *FEATURES, digits=4)


def m6_kmeans_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = checkpointed(scaled_matrix(spark, sf_dir))
    return kmeans.predict(df, FEATURES, kmeans.kmeans_multi(df, "vec_id", FEATURES, 2).centers).select("vec_id", "cluster", "d2")


def m8_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.elbow(checkpointed(scaled_matrix(spark, sf_dir)), "vec_id", FEATURES, n_init=3)


def m9_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, run, _ = clustered(spark, sf_dir)
    return rounded(kmeans.history_table(df, run), "inertia", digits=3)


def a21_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = clustered(spark, sf_dir)
    return rounded(rows.agg(F.sum("d2").alias("inertia")), "inertia", digits=3)


def x9_cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, run, rows = clustered(spark, sf_dir)
    d2 = kmeans.squared_distances(FEATURES, run.centers)
    scored = rows.withColumn("s", X.inverse_distance_scores(F.transform(d2, lambda x: F.sqrt(x)))).withColumn("pseudo", X.pseudo_probability(d2))
    return rounded(scored.select("vec_id", *[F.col("s")[i].alias(f"s{i}") for i in range(4)], "pseudo"), "s0", "s1", "s2", "s3", "pseudo", digits=4)


def tree_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Small clusters of the whole table, Ward's tree over them, and the rows with their small cluster."""
    df = checkpointed(scaled_matrix(spark, sf_dir))
    merges, own = hierarchy.ward_large(df, "vec_id", FEATURES)
    return df, merges, own


def w1_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = checkpointed(hierarchy.numbered_points(scaled_matrix(spark, sf_dir), "vec_id", FEATURES))
    return hierarchy.ward(points)


def w2_average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.linkage(checkpointed(hierarchy.numbered_points(scaled_matrix(spark, sf_dir), "vec_id", FEATURES)), "average")


def w4_cut_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, merges, own = tree_points(spark, sf_dir)
    merges = checkpointed(merges)
    k = hierarchy.choose_cluster_count(merges).first()["k"]
    n = merges.count() + 1
    cut = hierarchy.cut_tree(merges, n, k)
    return own.join(F.broadcast(cut), F.col("micro") == F.col("id")).select("vec_id", "cluster", F.lit(k).alias("k"))  # n <= 2,000


def w5_cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = checkpointed(tree_points(spark, sf_dir)[1])
    return hierarchy.choose_cluster_count(merges).join(hierarchy.cut_height(merges))  # one row each


def w7_cah_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, reduce to 90 % of the variance, Ward, two clusters: aligned accuracy, adjusted Rand index, silhouette."""
    df = matrix(spark, sf_dir).withColumn("label", F.col("label") % 2)
    reduced, n = scale.pca_variance(scale.apply_zscore(df, scale.fit_zscore(df, FEATURES)), FEATURES)
    axes = [f"pc{i + 1}" for i in range(n)]
    reduced = checkpointed(reduced)
    points = checkpointed(hierarchy.numbered_points(reduced, "vec_id", axes))
    cut = hierarchy.cut_tree(hierarchy.ward(points), points.count(), 2)
    rows = checkpointed(points.select("id", F.col("key").alias("vec_id")).join(cut, "id").join(reduced, "vec_id"))
    counts = checkpointed(evaluate.contingency(rows))
    _, share = evaluate.align_clusters_assignment(counts)
    mean = evaluate.silhouette(rows, "vec_id", axes).agg(F.avg("silhouette").alias("silhouette"))
    return evaluate.adjusted_rand(counts).join(mean).withColumn("accuracy", F.lit(share))  # one row each


def w1_ward_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward's tree with rounds on Spark until 64 clusters are left. Half the squared heights add up to all squared distances
    from the mean."""
    points = checkpointed(hierarchy.numbered_points(scaled_matrix(spark, sf_dir), "vec_id", FEATURES))
    sums = hierarchy.ward(points, 64).agg(F.count(F.lit(1)).alias("merges"), (F.sum(F.col("height") * F.col("height")) / 2).alias("spread"), F.max(F.col("size_left") + F.col("size_right")).alias("points"))
    return rounded(sums, "spread", digits=4)


def w2_single_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage of all rows: how many parts are left at some heights."""
    points = checkpointed(hierarchy.numbered_points(scaled_matrix(spark, sf_dir), "vec_id", FEATURES))
    merges = hierarchy.linkage(points, "single", 64)
    below = [F.count(F.when(F.col("height") <= t, 1)).alias(f"h{i}") for i, t in enumerate(PART_HEIGHTS)]
    sums = merges.agg((F.count(F.lit(1)) + 1).alias("n"), *below)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("height"), (F.col("n") - F.col(f"h{i}")).alias("parts")) for i, t in enumerate(PART_HEIGHTS)])).alias("x")).select("x.*")


def a13_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best one-to-one map of clusters to classes, by the assignment for any number of them."""
    order, share = evaluate.align_clusters_assignment(evaluate.contingency(clustered(spark, sf_dir)[2]))
    return rounded(spark.createDataFrame([(len(order), share)], "clusters int, accuracy double"), "accuracy")


def m3_center_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers on all axes: their squared distances from the mean stay what they are."""
    df, run, _ = clustered(spark, sf_dir)
    projected = scale.project_centers(kmeans.center_table(df, run), FEATURES, df, len(FEATURES))
    norm = sum((F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") for i in range(len(FEATURES))), F.lit(0.0))
    return rounded(projected.select("cluster", norm.alias("square")), "square", digits=4)


# --- evaluation ---------------------------------------------------------------------------------------------------------


def named_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = clustered(spark, sf_dir)
    return evaluate.contingency(rows.withColumn("label", F.concat(F.lit("class"), F.col("label"))))


def a7_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(aligned(spark, sf_dir), 4)


def a9_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_metrics(evaluate.confusion_matrix(aligned(spark, sf_dir), 4)), "precision", "recall", "f1")


def a11_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.contingency(clustered(spark, sf_dir)[2])


def a12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered(spark, sf_dir)[2]
    _, share = evaluate.align_clusters(evaluate.contingency(rows), 4)
    return rounded(rows.agg(F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.lit(share)), "accuracy")


def a14_adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.adjusted_rand(evaluate.contingency(clustered(spark, sf_dir)[2])), "ari")


def a15_dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dominant_class(named_counts(spark, sf_dir))


def a16_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.purity(named_counts(spark, sf_dir)), "purity")


def a17_cluster_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(i, f"class{i}") for i in range(4)], "class_id int, class_name string")
    cards = evaluate.cluster_cards(named_counts(spark, sf_dir), classes)
    return cards.select("cluster_id", "label", "count", "mapped_class", F.array_join(F.transform("distribution", lambda d: F.concat_ws("=", d["name"], d["count"].cast("string"))), ",").alias("distribution"))


def s6_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(i, f"class{i}") for i in range(4)], "class_id int, class_name string")
    return cluster_summary(evaluate.cluster_cards(named_counts(spark, sf_dir), classes), "largest gap").select("cluster_count", "purity_percent", "decision_method")


def a18_cluster_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.contingency(clustered(spark, sf_dir)[2])
    return rounded(evaluate.cluster_class_precision(counts, [0, 1, 2, 3]), "pct")


def a19_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.silhouette(matrix(spark, sf_dir), "vec_id", FEATURES, "label"), "silhouette")


def a19_silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.silhouette_squared(matrix(spark, sf_dir), "vec_id", FEATURES, "label"), "silhouette")


def m14_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1) from their length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return table(spark, sf_dir, "labels").filter("toxic is not null").join(d, "doc_id").select("doc_id", "toxic", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


def m14_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.roc_curve(m14_scores(spark, sf_dir), "score", F.col("toxic") == 1), "threshold", "fpr", "tpr")


def m14_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.auc(evaluate.roc_curve(m14_scores(spark, sf_dir), "score", F.col("toxic") == 1)), "auc")


def m13_evaluate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = m14_scores(spark, sf_dir)
    models = [(n, scores.select(F.lit(n).alias("model"), F.col("toxic").alias("label"), (F.col("score") >= t).cast("int").alias("pred"))) for n, t in (("low", 0.2), ("middle", 0.5), ("high", 0.8))]
    return rounded(evaluate.evaluate_models(models[0][1].unionByName(models[1][1]).unionByName(models[2][1])), "accuracy", "precision", "recall", "f1")


# --- learners -----------------------------------------------------------------------------------------------------------


def learners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = matrix(spark, sf_dir).withColumn("label", F.col("label") % 2)
    rows = checkpointed(cohort.stratified_split(df, "label", "vec_id"))
    train = rows.filter("split = 'train'")
    scaler = scale.fit_zscore(train, FEATURES)
    return scale.apply_zscore(train, scaler), scale.apply_zscore(rows.filter("split = 'test'"), scaler, scale.EPSILON)


def m10_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = learners(spark, sf_dir)
    return supervised.probabilities(supervised.random_forest(train, FEATURES), test, FEATURES).select("vec_id", "label", "p1", "pred")


def m11_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = learners(spark, sf_dir)
    return supervised.probabilities(supervised.logistic_regression(train, FEATURES), test, FEATURES).select("vec_id", "label", "p1", "pred")


def m12_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = learners(spark, sf_dir)
    return supervised.FourierSVM(FEATURES).fit(train).transform(test).select("vec_id", "label", "p1", "pred")


def m12_svm_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel machine by landmarks, beside that by random cosines."""
    train, test = learners(spark, sf_dir)
    return supervised.NystromSVM(FEATURES).fit(train).transform(test).select("vec_id", "label", "p1", "pred")


def m15_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = learners(spark, sf_dir)
    return supervised.feature_importance(supervised.random_forest(train, FEATURES), FEATURES, spark)


# --- images -------------------------------------------------------------------------------------------------------------


def plane(stage: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return J.pixel_table(J.stage_planes(images8(spark, sf_dir), (stage,)))

    return query


def kernel(job: Callable[..., DataFrame], *names: str, digits: int = DIGITS) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = job(images8(spark, sf_dir))
        return rounded(found.select("image_id", *(names or found.columns[1:])), *(names or found.columns[1:]), digits=digits)

    return query


def png_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the table as files: written as PNG to the shared folder, a folder for each class, and read by Spark's
    image source."""
    planes = images8(spark, sf_dir).select(F.lit("Training").alias("split"), F.format_string("class_%d", F.coalesce("label", F.lit(-1))).alias("class_name"), F.format_string("vec_%012d.png", "image_id").alias("file_name"), "h", "w", "pixels")
    root = f"{shared_folder(spark)}/png-{uuid.uuid4().hex}"
    write_pngs(planes, root)
    classes = spark.createDataFrame([(i, f"class_{i}") for i in range(10)], "class_id int, class_name string")
    gray = checkpointed(to_gray(read_images(spark, root, classes, drop_invalid=False), 8))
    remove_folder(spark, root)
    return gray.withColumn("image_id", F.regexp_extract("file_name", "([0-9]+)", 1).cast("long"))


def s2_png_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pixel_table(png_images(spark, sf_dir))


def s3_png_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and split of each file, from its path."""
    return png_images(spark, sf_dir).select("image_id", "split", "class_name", "label")


def k21_png_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display features of every image that lies in the folder."""
    found = J.features_d10(png_images(spark, sf_dir))
    return rounded(found, *found.columns[1:], digits=6)


def log_lines(spark: SparkSession, sf_dir: str, more: Column) -> DataFrame:
    """The lines of each turn's whole text and of what is put behind it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("conv_id", "turn", (F.col("at") + 1).alias("line_no"), "line")


def x1_log_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" Accuracy globale : "), F.col("turn").cast("string"), F.lit(".5%"))).otherwise(" ACCURACY= 71.25%")
    return log_lines(spark, sf_dir, more).select("conv_id", "turn", "line_no", X.accuracy_of_line("line").alias("accuracy"))


def x2_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat(F.lit("\n  Classe "), "role", F.lit("\n\n \n... "), "role", F.lit("\nConvergence "), F.col("turn").cast("string"), F.lit("\n"))
    return X.report_lines(log_lines(spark, sf_dir, more), "line", "line_no", ("conv_id", "turn")).select("conv_id", "turn", "line_no", "report")


# --- single expressions and tables ------------------------------------------------------------------------------------------


def p6_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mark_correct(aligned(spark, sf_dir)).select("vec_id", "label", "pred", "correct")


def p7_constant_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of one value: its deviation counts as 1, so it becomes 0 and not a fraction of zero."""
    df = matrix(spark, sf_dir).withColumn("same", F.lit(3.5))
    scaler = scale.fit_zscore(df, ["same"])
    rows = scale.apply_zscore(df, scaler).join(F.broadcast(scaler))  # one row
    mean = F.lit(scale.fit_zscore(df, ["f0"]).first()["mu"])
    return rounded(rows.select("vec_id", (F.col("f0") - mean).alias("f0_centered"), "same", "mu", "sigma"), "f0_centered")


def x3_four_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("vec_id", X.four_decimals("f0").alias("text"))


def x5_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", X.half_even(F.col("label") + F.lit(0.5)).alias("whole"))


def x7_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix(spark, sf_dir).select("vec_id", X.clip(F.col("f0"), -0.5, 0.5).alias("f0")), "f0")


def x8_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = matrix(spark, sf_dir)
    here, there = F.array(*FEATURES), F.array(*[F.lit(float(x)) for x in first_centers(df, 1)[0]])
    return rounded(df.select("vec_id", X.squared_distance(here, there).alias("squared"), X.euclidean(here, there).alias("euclidean")), "squared", "euclidean")


def t2_probability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, run, rows = clustered(spark, sf_dir)
    distances = F.transform(kmeans.squared_distances(FEATURES, run.centers), lambda x: F.sqrt(x))
    found = rows.select("vec_id", F.posexplode(X.probability_table([f"class{i}" for i in range(4)], distances)).alias("at", "x"))
    return found.select("vec_id", (F.col("at") + 1).alias("place"), "x.class_name", F.round("x.value", 4).alias("value"), "x.percent", "x.distance")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose heights are the first components, sorted: stands for the merges of a tree."""
    return numbered(matrix(spark, sf_dir), ["f0", "vec_id"], "step").select((F.col("step") + 1).alias("step"), F.col("f0").alias("height"))


def t4_top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.top_gaps(heights(spark, sf_dir)), "height", "gap")


def t5_last_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.last_merges(heights(spark, sf_dir)), "height")


def w4_cut_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree as deep as the logarithm of the table's rows, cut where seven clusters are left."""
    n = table(spark, sf_dir, "embeddings").count()
    merges = spark.range(n - 1).select((F.col("id") + 1).cast("int").alias("step"), (F.col("id") * 2).alias("left_id"), (F.col("id") * 2 + 1).alias("right_id"), (F.col("id") + n).alias("new_id"))
    return hierarchy.cut_tree(merges, n, 7)


def w5_gap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.choose_cluster_count(heights(spark, sf_dir))


def w6_cut_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.cut_height(heights(spark, sf_dir)), "line")


def m1_axis_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All axes together hold the columns' variance, and no two of them vary together."""
    projected, shares = scale.pca(scaled_matrix(spark, sf_dir), FEATURES, len(FEATURES))
    axes = [f"pc{i + 1}" for i in range(len(FEATURES))]
    both = scale.covariance(projected, axes)
    sums = both.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("variance"), F.max(F.when(F.col("a") != F.col("b"), F.abs("cov"))).alias("largest_covariance"))
    return rounded(sums.select(F.lit(len(axes)).alias("axes"), "variance", F.lit(float(sum(shares))).alias("explained"), "largest_covariance"), "variance", "explained", "largest_covariance", digits=4)


def x12_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the preview's colours, with the pixels above 127 in red."""
    rgb = J.overlays(images8(spark, sf_dir), mask=lambda x: x > 127)
    rows = rgb.select("image_id", F.explode(F.sequence(F.lit(0), F.octet_length("rgb") - 1)).alias("i"), F.hex("rgb").alias("text"))
    value = F.conv(F.substring("text", F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("long")
    of = lambda channel: F.sum(F.when(F.col("i") % 3 == channel, value))
    return rows.groupBy("image_id").agg(of(0).alias("red"), of(1).alias("green"), of(2).alias("blue"))


def x13_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.boxes(J.stage_planes(images8(spark, sf_dir), ("final",)))


def st2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaler, clusters and a forest, saved in the shared folder and loaded again, score every row of the table."""
    df = matrix(spark, sf_dir).withColumn("label", F.col("label") % 2)
    scaler = scale.fit_zscore(df, FEATURES)
    rows = checkpointed(scale.apply_zscore(df, scaler))
    run = kmeans.kmeans_from(rows, FEATURES, first_centers(rows, 2))
    folder = f"{shared_folder(spark)}/scorer-{uuid.uuid4().hex}"
    score.save_scorer(folder, scaler, kmeans.center_table(rows, run), ["tumor", "no_tumor"], supervised.random_forest(rows, FEATURES))
    scored = score.scored_features(df, score.load_scorer(spark, folder), tuple(FEATURES))
    return scored.select("vec_id", "cluster_id", "predicted_class", "classifier_pred", "confidence", "diagnosis")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "cluster_report": cluster_report,
        "a1_class_counts": a1_class_counts,
        "a2_binary_class_counts": a2_binary_class_counts,
        "a3_split_class_counts": a3_split_class_counts,
        "p1_binary_label": p1_binary_label,
        "p2_resolve_class_dirs": p2_resolve_class_dirs,
        "p5_only_class": p5_only_class,
        "wd_first_per_class": wd_first_per_class,
        "t1_select_best": t1_select_best,
        "r2_stratified_split": r2_stratified_split,
        "r3_unselected": r3_unselected,
        "s1_path_parts": s1_path_parts,
        "s6_cluster_summary": s6_cluster_summary,
        "s7_accepted_uploads": s7_accepted_uploads,
        "a4_fit_zscore": a4_fit_zscore,
        "a4_lineitem_zscore": a4_lineitem_zscore,
        "a5_apply_zscore": a5_apply_zscore,
        "a6_class_profile": a6_class_profile,
        "a20_covariance": a20_covariance,
        "x11_percentiles": x11_percentiles,
        "m1_pca": m1_pca,
        "m2_pca_variance": m2_pca_variance,
        "m3_project_centers": m3_project_centers,
        "m5_kmeans_given": m5_kmeans_given,
        "m5_kmeans_three_rounds": m5_kmeans_three_rounds,
        "m6_kmeans_multi": m6_kmeans_multi,
        "m8_elbow": m8_elbow,
        "m9_convergence": m9_convergence,
        "a21_inertia": a21_inertia,
        "x9_cluster_scores": x9_cluster_scores,
        "w1_ward": w1_ward,
        "w1_ward_rounds": w1_ward_rounds,
        "w2_average_linkage": w2_average_linkage,
        "w2_single_parts": w2_single_parts,
        "a13_assignment": a13_assignment,
        "m3_center_norms": m3_center_norms,
        "w4_cut_tree": w4_cut_tree,
        "w5_cluster_count": w5_cluster_count,
        "w7_cah_eval": w7_cah_eval,
        "a7_confusion": a7_confusion,
        "a9_class_metrics": a9_class_metrics,
        "a11_contingency": a11_contingency,
        "a12_align": a12_align,
        "a14_adjusted_rand": a14_adjusted_rand,
        "a15_dominant_class": a15_dominant_class,
        "a16_purity": a16_purity,
        "a17_cluster_cards": a17_cluster_cards,
        "a18_cluster_precision": a18_cluster_precision,
        "a19_silhouette": a19_silhouette,
        "a19_silhouette_squared": a19_silhouette_squared,
        "m13_evaluate_models": m13_evaluate_models,
        "m14_roc": m14_roc,
        "m14_auc": m14_auc,
        "m10_random_forest": m10_random_forest,
        "m11_logistic_regression": m11_logistic_regression,
        "m12_svm": m12_svm,
        "m12_svm_landmarks": m12_svm_landmarks,
        "m15_feature_importance": m15_feature_importance,
        "k1_blur": plane("blurred"),
        "k1_symmetric_blur": plane("symmetric_blur"),
        "k2_equalize": plane("only_equalized"),
        "k6_erode": plane("only_eroded"),
        "k6_dilate": plane("only_dilated"),
        "k7_largest_component": plane("only_component"),
        "k8_segment": plane("final"),
        "k3_normalize": plane("normalized"),
        "k14_region_measures": kernel(J.region_measures, digits=6),
        "k22_raw": plane("raw"),
        "k22_equalized": plane("equalized"),
        "k22_binary": plane("binary"),
        "k22_eroded": plane("eroded"),
        "k22_component": plane("component"),
        "k9_quality": kernel(J.quality, "quality"),
        "k5_thresholds": kernel(J.thresholds),
        "k10_chan_vese": plane("chan_vese"),
        "k11_brain_mask": plane("brain"),
        "k15_lbp_codes": plane("lbp"),
        "k16_texture": kernel(J.texture, digits=6),
        "k18_features_d10": kernel(J.features_d10, digits=6),
        "k19_features_f10": kernel(J.features_f10, digits=6),
        "s2_png_levels": s2_png_levels,
        "s3_png_classes": s3_png_classes,
        "k21_png_features": k21_png_features,
        "k20_features_f13": kernel(lambda df: J.features_f13(df, least=2), digits=4),
        "x1_log_accuracy": x1_log_accuracy,
        "x2_report_lines": x2_report_lines,
        "x3_four_decimals": x3_four_decimals,
        "x5_half_even": x5_half_even,
        "x7_clip": x7_clip,
        "x8_distances": x8_distances,
        "x12_overlay": x12_overlay,
        "x13_boxes": x13_boxes,
        "p6_correct": p6_correct,
        "p7_constant_sigma": p7_constant_sigma,
        "t2_probability_table": t2_probability_table,
        "t4_top_gaps": t4_top_gaps,
        "t5_last_merges": t5_last_merges,
        "w4_cut_balanced": w4_cut_balanced,
        "w5_gap_count": w5_gap_count,
        "w6_cut_height": w6_cut_height,
        "m1_axis_variances": m1_axis_variances,
        "st2_scored": st2_scored,
    }
