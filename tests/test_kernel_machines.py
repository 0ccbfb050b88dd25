"""Kernel machines against an exact solver of the dual on few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import supervised


def exact_decisions(x, y, held_out, c, gamma, rounds=4000):
    """Signs of the exact machine: the dual by sequential minimal optimisation, always the pair that is most wrong."""
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    k, a = kernel(x, x), np.zeros(len(x))
    gradient = -np.ones(len(x))
    for _ in range(rounds):
        up, down = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        score = -y * gradient
        i, j = np.where(up, score, -np.inf).argmax(), np.where(down, score, np.inf).argmin()
        if score[i] - score[j] < 1e-6:
            break
        step = (score[i] - score[j]) / max(1e-12, k[i, i] + k[j, j] - 2 * k[i, j])
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        gradient += y * step * (k[:, i] - k[:, j])
    free = (a > 1e-8) & (a < c - 1e-8)
    bias = np.mean(y[free] - k[free] @ (a * y)) if free.any() else 0.0
    return np.sign(kernel(held_out, x) @ (a * y) + bias)


@pytest.fixture(scope="module")
def rings(spark):
    random = np.random.default_rng(6)
    angle, radius = random.uniform(0, 2 * np.pi, 700), np.concatenate([random.normal(1, 0.25, 350), random.normal(2, 0.25, 350)])
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    rows = [(i, i % 2, int(r > 1.5 if i % 10 else r <= 1.5), *map(float, p)) for i, (r, p) in enumerate(zip(radius, x))]
    return spark.createDataFrame(rows, "id long, half int, label int, a double, b double").cache()


def test_landmarks_against_the_dual(spark, rings, tmp_path):
    train, test = rings.filter("half = 0"), rings.filter("half = 1").orderBy("id")
    machine = supervised.NystromSVM(["a", "b"], n_features=60).fit(train)
    assert machine.kernel_error(rings) < 0.01
    known, asked = train.toPandas(), test.toPandas()
    exact = exact_decisions(known[["a", "b"]].to_numpy(), known["label"].to_numpy() * 2 - 1, asked[["a", "b"]].to_numpy(), 1.0, machine.gamma)
    found = machine.transform(test).orderBy("id").toPandas()
    assert (found["pred"].to_numpy() * 2 - 1 == exact).mean() >= 0.95
    assert found["p1"].between(0, 1).all() and ((found["p1"] > 0.5) == (found["pred"] == 1)).mean() > 0.95
    supervised.save_classifier(machine, str(tmp_path / "machine"))
    again = supervised.load_classifier(spark, str(tmp_path / "machine")).transform(test).orderBy("id").toPandas()
    assert np.allclose(again["p1"], found["p1"])
    few = supervised.NystromSVM(["a", "b"], n_features=4).fit(train)
    assert few.kernel_error(rings) > machine.kernel_error(rings)


def test_equal_rows(spark):
    """One place for all rows has one landmark."""
    df = spark.range(20).select(F.lit(1.0).alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    machine = supervised.NystromSVM(["a"], n_features=8).fit(df)
    assert machine.landmarks.shape == (1, 1) and machine.transform(df).count() == 20
