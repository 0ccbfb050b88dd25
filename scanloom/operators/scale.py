"""Scaling and projection of feature columns: z-scores, class profiles, covariance, principal components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What keeps a division by a spread of zero finite when new rows are scaled.
EPSILON = 1e-8


def fit_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mu, sigma): mean and population deviation of each column in one pass; a deviation of zero becomes 1."""
    row = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sigma_{c}"))])
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"mu_{c}").alias("mu"), F.when(F.col(f"sigma_{c}") == 0, 1.0).otherwise(F.col(f"sigma_{c}")).alias("sigma")) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def apply_zscore(df: DataFrame, scaler: DataFrame, eps: float = 0.0) -> DataFrame:
    """df with the scaler's features as z-scores. eps: 0 for the rows the scaler was fitted on, EPSILON for new ones.

    The scaler has one row per feature column, so it becomes literals of the projection and no join is needed."""
    values = {r["feature"]: (r["mu"], r["sigma"]) for r in scaler.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(mu)) / (F.lit(sigma) + F.lit(eps)) for c, (mu, sigma) in values.items()})


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov): population covariance of each pair of columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    both = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov")) for a, b, i in both])).alias("x")).select("x.*")


def class_profile(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, feature, value): z-scored features, stretched by one minimum and maximum over all cells, averaged per class."""
    scaled = apply_zscore(df, fit_zscore(df, columns))
    ends = scaled.agg(F.min(F.least(*columns)).alias("low"), F.max(F.greatest(*columns)).alias("high")) if len(columns) > 1 else scaled.agg(F.min(columns[0]).alias("low"), F.max(columns[0]).alias("high"))
    means = scaled.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])  # the stretch is linear, so means may be stretched
    one = means.join(F.broadcast(ends))  # one row
    stretched = lambda c: (F.col(c) - F.col("low")) / (F.col("high") - F.col("low") + EPSILON)
    return one.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), stretched(c).alias("value")) for c in columns])).alias("x")).select(label, "x.*")


def principal_axes(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, axes as columns, explained shares), by falling variance; an axis's largest loading is positive."""
    cells = {(r["a"], r["b"]): r["cov"] for r in covariance(df, columns).collect()}
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    values, axes = np.linalg.eigh(np.array([[cells[a, b] for b in columns] for a in columns]))
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(columns))] < 0, -1, 1)
    return np.array([means[c] for c in columns]), axes, values / max(values.sum(), 1e-300)


def _projections(columns: list[str], means: np.ndarray, axes: np.ndarray, n: int) -> dict[str, Column]:
    return {f"pc{k + 1}": reduce(lambda a, b: a + b, [(F.col(c) - F.lit(float(means[i]))) * F.lit(float(axes[i, k])) for i, c in enumerate(columns)]) for k in range(n)}


def pca(df: DataFrame, columns: list[str], n: int = 2) -> tuple[DataFrame, list[float]]:
    """df with pc1..pcn beside it, and the explained shares in per cent. The d x d covariance is all that leaves Spark."""
    means, axes, shares = principal_axes(df, columns)
    return df.withColumns(_projections(columns, means, axes, n)), (100 * shares[:n]).tolist()


def pca_variance(df: DataFrame, columns: list[str], share: float = 0.90) -> tuple[DataFrame, int]:
    """Projection on the fewest axes that explain at least this share together, and their number."""
    means, axes, shares = principal_axes(df, columns)
    n = min(int(np.searchsorted(np.cumsum(shares), share - 1e-12)) + 1, len(columns))
    return df.withColumns(_projections(columns, means, axes, n)), n


def project_centers(centers: DataFrame, columns: list[str], fitted: DataFrame, n: int = 2) -> DataFrame:
    """centers (cluster, center array) on the axes of the fitted rows: (cluster, pc1..pcn)."""
    means, axes, _ = principal_axes(fitted, columns)
    wide = centers.select("cluster", *[F.col("center")[i].alias(c) for i, c in enumerate(columns)])
    return wide.select("cluster", *[v.alias(k) for k, v in _projections(columns, means, axes, n).items()])
