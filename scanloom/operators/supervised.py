"""Classifiers on feature columns, by Spark's own learners. Features should be z-scored; labels are 0 and 1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.features import small_clusters


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def random_forest(train: DataFrame, columns: list[str], label: str = "label", trees: int = 200, depth: int = 10, seed: int = 42):
    """Each split leaves at least 2 rows on a side: the nearest that there is to splitting only nodes of 4 or more."""
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed).fit(assembled(train, columns))


def logistic_regression(train: DataFrame, columns: list[str], label: str = "label", c: float = 1.0, max_iter: int = 1000):
    """C weighs the sum of losses against half the squared norm, so the penalty per row is 1 / (C n)."""
    n = train.count()
    return LogisticRegression(labelCol=label, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(assembled(train, columns))


def probabilities(model, df: DataFrame, columns: list[str], name: str = "pred") -> DataFrame:
    """df with p0 and p1 and the predicted class."""
    out = model.transform(assembled(df, columns))
    return out.select(*df.columns, vector_to_array("probability")[0].alias("p0"), vector_to_array("probability")[1].alias("p1"), F.col("prediction").cast("int").alias(name))


def feature_importance(model, columns: list[str], spark) -> DataFrame:
    """(feature, importance), the least important first."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "feature string, importance double").orderBy("importance", "feature")


def save_classifier(model, path: str) -> None:
    """A forest, a logistic model or a kernel machine; its kind lies beside it."""
    kind = type(model).__name__
    if kind not in LOADERS:
        raise ValueError(f"not a classifier of this library: {kind}")
    model.save(path + "/model") if isinstance(model, FourierSVM) else model.write().overwrite().save(path + "/model")
    SparkSession.getActiveSession().createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(path + "/kind")


def load_classifier(spark: SparkSession, path: str):
    return LOADERS[spark.read.parquet(path + "/kind").first()["kind"]](spark, path + "/model")


def classified(model, df: DataFrame, columns: list[str], name: str = "pred") -> DataFrame:
    """df with the class that any of the classifiers gives, and confidence, the largest chance."""
    if isinstance(model, FourierSVM):
        return model.transform(df, name).withColumn("confidence", F.greatest("p0", "p1")).drop("p0", "p1")
    out = model.transform(assembled(df, columns))
    return out.select(*df.columns, F.col("prediction").cast("int").alias(name), F.array_max(vector_to_array("probability")).alias("confidence"))


class FourierSVM:
    """A support vector machine with a Gaussian kernel, by random Fourier features: cosines of fixed random projections
    stand for the kernel, a linear machine separates them, and a logistic curve of its margin gives probabilities."""

    standardized = True

    def __init__(self, columns: list[str], n_features: int = 128, c: float = 1.0, seed: int = 42, max_iter: int = 100) -> None:
        self.columns, self.n, self.c, self.seed, self.max_iter = columns, n_features, c, seed, max_iter

    def save(self, path: str) -> None:
        """The projections as a table, the machine and the curve as Spark saves them."""
        spark = SparkSession.getActiveSession()
        rows = [(i, w.tolist(), float(b)) for i, (w, b) in enumerate(zip(self.directions, self.shifts, strict=True))]
        spark.createDataFrame(rows, "i int, direction array<double>, shift double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cosines")
        spark.createDataFrame(list(enumerate(self.columns)), "i int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        self.machine.write().overwrite().save(f"{path}/machine")
        self.curve.write().overwrite().save(f"{path}/curve")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FourierSVM:
        rows = spark.read.parquet(f"{path}/cosines").orderBy("i").collect()  # one for each cosine
        found = cls([r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("i").collect()], len(rows))
        found.directions, found.shifts = np.array([r["direction"] for r in rows]), np.array([r["shift"] for r in rows])
        found.machine, found.curve = LinearSVCModel.load(f"{path}/machine"), LogisticRegressionModel.load(f"{path}/curve")
        return found

    def _mapped(self, df: DataFrame) -> DataFrame:
        terms: list[Column] = []
        for w, b in zip(self.directions, self.shifts, strict=True):
            dot = sum((F.col(c) * F.lit(float(x)) for c, x in zip(self.columns, w, strict=True)), F.lit(float(b)))
            terms.append(F.cos(dot) * F.lit(float(np.sqrt(2 / self.n))))
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("features", array_to_vector(F.array(*terms)))

    def _prepare(self, train: DataFrame, gamma: float) -> None:
        random = np.random.default_rng(self.seed)
        self.directions, self.shifts = random.normal(scale=np.sqrt(2 * gamma), size=(self.n, len(self.columns))), random.uniform(0, 2 * np.pi, self.n)

    def fit(self, train: DataFrame, label: str = "label") -> FourierSVM:
        """gamma is 1 / (columns x variance of all values)."""
        d = len(self.columns)
        moments = train.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(self.columns)], *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(self.columns)], F.count(F.lit(1)).alias("n")).first()
        cells = max(1, moments["n"] * d)
        mean = sum(moments[f"s{i}"] or 0 for i in range(d)) / cells
        variance = sum(moments[f"q{i}"] or 0 for i in range(d)) / cells - mean**2
        gamma = 1 / (d * variance) if variance > 0 else 1.0
        self._prepare(train, gamma)
        mapped = self._mapped(train).select("features", F.col(label).alias("label")).cache()
        self.machine = LinearSVC(labelCol="label", regParam=1 / (self.c * max(1, moments["n"])), maxIter=self.max_iter, standardization=self.standardized).fit(mapped)
        margins = assembled(self.machine.transform(mapped).select(vector_to_array("rawPrediction")[1].alias("margin"), "label"), ["margin"])
        self.curve = LogisticRegression(labelCol="label").fit(margins)
        mapped.unpersist()
        return self

    def transform(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """df with p0, p1 and the machine's class."""
        out = self.machine.transform(self._mapped(df)).withColumn("margin", vector_to_array("rawPrediction")[1]).withColumnRenamed("prediction", "side").drop("features", "rawPrediction")
        out = self.curve.transform(assembled(out, ["margin"]))
        return out.select(*df.columns, vector_to_array("probability")[0].alias("p0"), vector_to_array("probability")[1].alias("p1"), F.col("side").cast("int").alias(name))


class NystromSVM(FourierSVM):
    """The same machine with features by the Nystrom method: the kernel with `n_features` landmarks, times the inverse root
    of the kernel between the landmarks, so products of features are the kernel itself as far as landmarks span it.
    Landmarks are centers of small clusters, found in one read. Landmarks and the root are broadcast, n x (n + d) numbers,
    and features are made of Arrow batches."""

    standardized = False

    def _prepare(self, train: DataFrame, gamma: float) -> None:
        self.gamma, self.landmarks = gamma, small_clusters(train, self.columns, self.n, self.seed)
        values, vectors = np.linalg.eigh(self._kernel(self.landmarks))
        kept = values > 1e-10 * max(1e-300, values.max(initial=0.0))
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ self.landmarks.T + (self.landmarks**2).sum(axis=1), 0))

    def _mapped(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        shared = df.sparkSession.sparkContext.broadcast((self.gamma, self.landmarks, self.root))

        @F.pandas_udf("array<double>")
        def features(*columns: pd.Series) -> pd.Series:
            gamma, landmarks, root = shared.value
            x = np.column_stack([c.to_numpy(float) for c in columns])
            near = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ landmarks.T + (landmarks**2).sum(axis=1), 0)
            return pd.Series(list(np.exp(-gamma * near) @ root))

        return df.withColumn("features", array_to_vector(features(*[F.col(c).cast("double") for c in self.columns])))

    def kernel_error(self, df: DataFrame, rows: int = 200) -> float:
        """The mean difference of the features' products from the kernel, over all pairs of the first few rows by a hash."""
        some = df.select(*[F.col(c).cast("double") for c in self.columns]).orderBy(F.xxhash64(*self.columns)).limit(rows).toPandas().to_numpy()
        features = self._kernel(some) @ self.root
        exact = np.exp(-self.gamma * np.maximum((some**2).sum(axis=1)[:, None] - 2 * some @ some.T + (some**2).sum(axis=1), 0))
        return float(np.abs(features @ features.T - exact).mean())

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(i, w.tolist(), r.tolist()) for i, (w, r) in enumerate(zip(self.landmarks, self.root, strict=True))]
        spark.createDataFrame(rows, "i int, landmark array<double>, root array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/landmarks")
        spark.createDataFrame([(i, c, float(self.gamma)) for i, c in enumerate(self.columns)], "i int, name string, gamma double").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        self.machine.write().overwrite().save(f"{path}/machine")
        self.curve.write().overwrite().save(f"{path}/curve")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NystromSVM:
        rows, columns = spark.read.parquet(f"{path}/landmarks").orderBy("i").collect(), spark.read.parquet(f"{path}/columns").orderBy("i").collect()
        found = cls([r["name"] for r in columns], len(rows))
        found.gamma, found.landmarks, found.root = columns[0]["gamma"], np.array([r["landmark"] for r in rows]), np.array([r["root"] for r in rows])
        found.machine, found.curve = LinearSVCModel.load(f"{path}/machine"), LogisticRegressionModel.load(f"{path}/curve")
        return found


LOADERS = {
    "RandomForestClassificationModel": lambda spark, path: RandomForestClassificationModel.load(path),
    "LogisticRegressionModel": lambda spark, path: LogisticRegressionModel.load(path),
    "FourierSVM": FourierSVM.load,
    "NystromSVM": NystromSVM.load,
}
