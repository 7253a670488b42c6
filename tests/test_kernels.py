"""Kernel machines: the map against the kernel, shapes that no plane can part, exact shares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import kernels, metrics, models
from millrace.sources.models import load_model, save_model


def rings(spark, n=600, seed=0):
    """Three rings around one centre."""
    rng = np.random.default_rng(seed)
    ring = rng.integers(0, 3, n)
    angle, r = rng.uniform(0, 2 * np.pi, n), 1 + 2 * ring + rng.normal(0, 0.15, n)
    rows = [(int(i), float(5 + a * np.cos(t)), float(a * np.sin(t)), "abc"[k], int(k == 1)) for i, (t, a, k) in enumerate(zip(angle, r, ring))]
    return spark.createDataFrame(rows, "id long, x double, y double, ring string, middle int")


def test_map_is_near_the_kernel(spark):
    df = rings(spark, 60)
    phi = kernels.fourier_map(df, ["x", "y"], gamma=0.3, size=4_000, seed=5)
    x = np.array([(r.x, r.y) for r in df.orderBy("id").collect()])
    z = phi(x)
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.12 and np.abs(z @ z.T - exact).mean() < 0.02
    small = kernels.fourier_map(df, ["x", "y"], gamma=0.3, size=7, seed=5)
    native = [r.z for r in df.orderBy("id").select(small.column().alias("z")).collect()]
    assert np.allclose(native, small(x))
    scale = kernels.fourier_map(df, ["x", "y"], size=2_000)
    assert abs(scale.weights.var() - 2 / (2 * x.var())) < 0.2 * 2 / (2 * x.var())


@pytest.mark.parametrize("label", ["ring", "middle"])
def test_rings_are_told_apart(spark, label):
    df = rings(spark)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    right = {}
    for name, options in (("SupportVectorMachines", {"gamma": 0.5, "C": 10.0, "rounds": 25, "size": 128}), ("LinearSupportVectorMachines", {"maxIter": 10})):
        scored = models.score(models.train(train, models.Algorithm(name, "classification", options), label, ["x", "y"]), test, label)
        right[name] = metrics.classification_scores(scored, label).first()["accuracy"]
    assert right["SupportVectorMachines"] > 0.95 and right["LinearSupportVectorMachines"] < 0.8


def test_regression_follows_a_wave(spark):
    df = spark.range(400).select("id", (F.col("id") / 40).alias("x")).withColumn("y", 1000 + 300 * F.sin("x"))
    model = models.train(df.where("id % 4 > 0"), models.Algorithm("SupportVectorRegression", "regression", {"gamma": 1.0, "C": 50.0, "epsilon": 3.0, "rounds": 30, "size": 64}), "y", ["x"])
    scored = models.score(model, df.where("id % 4 = 0"), "y", "regression")
    assert metrics.regression_scores(scored, "y").first()["r2"] > 0.99


def test_minimise_finds_the_least(monkeypatch):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a, b = a @ a.T + np.eye(30), rng.normal(size=30)
    found = kernels.minimise(lambda x: (x @ a @ x / 2 - b @ x, a @ x - b), np.zeros(30), rounds=300, tolerance=1e-9)
    assert np.allclose(found, np.linalg.solve(a, b), atol=1e-3)


def test_sums_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(kernels, "DIRECT_PARTS", 3)
    rows = spark.range(100).repartition(9).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), F.col("id").cast("double").alias("y"))
    assert kernels._summed(rows, lambda x, y: np.array([x[:, 0].sum(), x[:, 1].sum(), y.max()]), 3)[:2].tolist() == [4950.0, 100.0]


def test_one_class_follows_two_moons(spark):
    rng = np.random.default_rng(4)
    t, upper = rng.uniform(0, np.pi, 1_000), rng.random(1_000) < 0.5
    x = np.where(upper, np.cos(t), 1 - np.cos(t)) + rng.normal(0, 0.05, 1_000)
    y = np.where(upper, np.sin(t), 0.5 - np.sin(t)) + rng.normal(0, 0.05, 1_000)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    model = models.train(df, models.Algorithm("OneClassSVM", "anomaly", {"nu": 0.05, "gamma": 8.0, "rounds": 15}), None, ["x", "y"])
    outside = model.transform(df).where("predictions = -1").count()
    assert abs(outside - 50) <= 10
    odd = spark.createDataFrame([(0, -0.45, 0.1), (1, 1.45, 0.4), (2, 3.0, 3.0), (3, 0.0, 1.0), (4, 1.0, -0.5), (5, None, 0.0)], "id long, x double, y double")
    got = {r.id: r.predictions for r in model.transform(odd).collect()}
    # the hollows of both moons and places far off are outside, the moons themselves inside
    assert got == {0: -1, 1: -1, 2: -1, 3: 1, 4: 1, 5: -1}


def test_saved_and_odd_input(spark, tmp_path):
    df = rings(spark, 120)
    odd = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 5.0, 0.0)], "id long, x double, y double")
    for i, (algorithm, label) in enumerate((
        (models.Algorithm("SupportVectorMachines", "classification", {"rounds": 3, "size": 16}), "ring"),
        (models.Algorithm("SupportVectorRegression", "regression", {"rounds": 3, "size": 16}), "x"),
        (models.Algorithm("OneClassSVM", "anomaly", {"nu": 0.2, "rounds": 2, "size": 16}), None),
    )):
        model = models.train(df, algorithm, label, ["x", "y"])
        save_model(model, f"{tmp_path}/{i}")
        one, two = (m.transform(df).orderBy("id").select("predictions").collect() for m in (model, load_model(f"{tmp_path}/{i}")))
        assert one == two
        missing = {r.id: r.predictions for r in model.transform(odd).collect()}
        assert missing[1] == missing[2] == (None if label else -1) and missing[3] is not None
    with pytest.raises(ValueError, match="unknown option"):
        models.train(df, models.Algorithm("SupportVectorMachines", "classification", {"degree": 3}), "ring", ["x", "y"])
    with pytest.raises(ValueError, match="no row"):
        models.train(df.where("false"), models.Algorithm("SupportVectorRegression", "regression"), "x", ["y"])


def test_rows_read_in_one_piece_are_dealt_out(spark, monkeypatch):
    """A table small in bytes comes in one piece: its cosines are not one task's work, and scores are made once per step."""
    df = rings(spark, 400).coalesce(1)
    parts = [len(p) for p in kernels._rows(df, ["x", "y"]).rdd.glom().collect()]
    assert len(parts) >= 8 and max(parts) < 100 and sum(parts) == 400
    read, real = [], kernels.exact_quantiles
    monkeypatch.setattr(kernels, "exact_quantiles", lambda scored, *a, **b: (read.append(scored._jdf.queryExecution().optimizedPlan().toString()), real(scored, *a, **b))[1])
    model = kernels.train_one_class_machine(df, ["x", "y"], nu=0.1, gamma=0.5, rounds=2)
    assert len(read) == 3 and not any("Python" in plan or "Arrow" in plan for plan in read)
    assert abs(model.transform(df).where("predictions = -1").count() - 40) <= 1
