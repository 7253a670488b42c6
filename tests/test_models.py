import numpy as np
import pytest
from conftest import rows
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from millrace.operators import anomaly, explain, models, ridge, search
from millrace.operators.scale import fit_scaler
from millrace.plans import QUERIES
from millrace.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(0)
    centre = {"a": (0, 0), "b": (6, 0), "c": (0, 6)}
    data = [(i, k, float(rng.normal(centre[k][0])), float(rng.normal(centre[k][1])), float(rng.normal())) for i, k in enumerate("abc" * 60)]
    return spark.createDataFrame(data, "id long, kind string, x double, y double, noise double").persist()


@pytest.mark.parametrize("name, options", [
    ("LogisticRegression", {}), ("SupportVectorMachines", {"rounds": 8, "size": 64}), ("SupportVectorMachines", {"kernel": "linear", "maxIter": 10}), ("GaussianNaiveBayes", {}),
    ("RandomForest", {"numTrees": 5}), ("GradientBoosting", {"maxIter": 2}), ("AdaBoost", {"n_estimators": 6}),
])
def test_classifiers(groups, name, options):
    model = models.train(groups, models.Algorithm(name, "classification", options), "kind", ["x", "y"])
    scored = models.score(model, groups, "kind")
    assert scored.columns == [*groups.columns, "predictions", "results"]
    assert models.score_table(scored, "kind", "classification").first()["accuracy"] > 0.85


@pytest.mark.parametrize("name, options, least", [
    ("LinearRegression", {}, 0.999), ("RobustLinearRegression", {}, 0.99), ("BayesianRidgeRegression", {}, 0.999),
    ("RandomForest", {"numTrees": 5}, 0.7), ("GradientBoosting", {"maxIter": 5}, 0.7), ("AdaBoost", {"n_estimators": 5}, 0.7),
])
def test_regressors(groups, name, options, least):
    df = groups.withColumn("target", 3 * F.col("x") - 2 * F.col("y") + 1)
    model = models.train(df, models.Algorithm(name, "regression", options), "target", ["x", "y"])
    assert models.score_table(models.score(model, df, "target", "regression"), "target", "regression").first()["r2"] > least


def test_bayesian_ridge_recovers_weights(groups):
    df = groups.withColumn("target", 3 * F.col("x") - 2 * F.col("y") + 1 + 0.1 * F.col("noise"))
    fit = ridge.train_bayesian_ridge(df, "target", ["x", "y", "noise"])
    assert np.allclose([fit.coefficients["x"], fit.coefficients["y"], fit.coefficients["noise"], fit.intercept], [3, -2, 0.1, 1], atol=1e-3)


def test_clustering_and_saving(groups, tmp_path):
    model = models.train(groups, models.Algorithm.from_json('{"name": "KMeans", "type": "clustering", "input_variables": {"k": 3}}'), None, ["x", "y"])
    save_model(model, str(tmp_path / "m"))
    scored = models.score(load_model(str(tmp_path / "m")), groups, "kind", "clustering")
    assert models.score_table(scored, "kind", "clustering").first()["v_measure"] > 0.8
    with pytest.raises(ValueError):
        models.train(groups, models.Algorithm("Nope", "classification"), "kind")


def test_isolation_forest(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(6)]
    df = spark.createDataFrame(data, "id long, x double, y double")
    forest = anomaly.train_isolation_forest(df, "id", ["x", "y"], trees=40, sample=64, contamination=0.01)
    far = forest.transform(df).where("predictions = -1")
    assert far.where("id >= 1000").count() == 6 and far.count() <= 8
    again = anomaly.train_isolation_forest(df, "id", ["x", "y"], trees=40, sample=64, contamination=0.01)
    assert all(np.array_equal(a, b) for a, b in zip(forest.trees, again.trees))
    assert np.allclose(anomaly.average_path(np.array([1, 2, 256.0])), [0, 1, 10.244770920])


def test_one_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 100).cast("double").alias("x"))
    assert anomaly.train_one_class(df, ["x"], 0.1).transform(df).where("predictions = -1").count() in range(80, 121)


def test_search(groups):
    base = models.Algorithm("LogisticRegression", "classification")
    candidates = search.grid(base, {"regParam": [0.0, 5.0]})
    losses = search.search(groups, candidates, "kind", "id", ["x", "y"], folds=3)
    assert losses.count() == 2 and search.best(losses, candidates).input_variables["regParam"] == 0.0
    folds = search.hash_folds(groups, "id", 3)
    assert folds.select("__fold").distinct().count() == 3


def test_permutation_importance(groups):
    base = groups.select("id", "kind", "x", "y", "noise")
    mixed = explain.shuffled(base, "id", ["x", "noise"], 1)
    assert sorted(r[0] for r in mixed.select("__perm_x").collect()) == sorted(r[0] for r in base.select("x").collect())
    model = models.train(base, models.Algorithm("GaussianNaiveBayes", "classification"), "kind", ["x", "y", "noise"])
    weights = {r["feature"]: r["weight"] for r in explain.permutation_importance(model, base, "kind", "id", ["x", "y", "noise"], 2).collect()}
    assert weights["x"] > 0.2 and weights["y"] > 0.2 and abs(weights["noise"]) < 0.05


def test_partial_dependence_of_a_linear_model(groups):
    df = groups.withColumn("target", 3 * F.col("x") + F.col("y"))
    model = models.train(df, models.Algorithm("LinearRegression", "regression"), "target", ["x", "y"])
    points = [(r["value"], r["average"]) for r in explain.partial_dependence(model.transform, df, "x", 5).orderBy("value").collect()]
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(points, points[1:])]
    assert len(points) == 5 and np.allclose(slopes, 3)
    grid = explain.partial_dependence_2d(model.transform, df, ("x", "y"), 3)
    assert grid.count() == 9


def test_drift_classifier(groups):
    moved = groups.withColumn("x", F.col("x") + 8)
    out = {r["feature"]: r for r in explain.drift_classifier(groups, moved, "id", ["x", "noise"]).collect()}
    assert out["x"]["auc"] > 0.9 and out["x"]["coefficient"] > abs(out["noise"]["coefficient"])


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, flat double")
    s = fit_scaler(df, ["x", "flat"], "standard")
    assert np.isclose(s.center["x"], 4) and np.isclose(s.width["x"], np.std([1, 2, 3, 10])) and s.width["flat"] == 1.0
    r = fit_scaler(df, ["x"], "robust")
    assert np.isclose(r.center["x"], 2.5) and np.isclose(r.width["x"], np.subtract(*np.quantile([1, 2, 3, 10], [0.75, 0.25])))
    assert s.table(spark).count() == 2
    with pytest.raises(ValueError):
        fit_scaler(df, ["x"], "nope")


def test_mean_shift(groups):
    from millrace.operators.meanshift import train_mean_shift

    model = train_mean_shift(groups, ["x", "y"], 3.0)
    near = lambda p: min(np.hypot(p[0] - c[0], p[1] - c[1]) for c in model.centers)
    assert len(model.centers) == 3 and all(near(p) < 0.7 for p in ((0, 0), (6, 0), (0, 6)))
    table = model.transform(groups).groupBy("kind", "predictions").count().collect()
    assert sum(r["count"] for r in table if r["count"] > 40) > 170
    with pytest.raises(ValueError):
        train_mean_shift(groups, ["x"], 0)


def brute_shift(x, bandwidth):
    """Every step over all pairs, from the same seeds, in plain numpy."""
    from millrace.operators.meanshift import _Grid

    cells = np.floor(x @ _Grid(x.shape[1], bandwidth).axes.T / bandwidth)
    seeds = [x[(cells == c).all(axis=1)].mean(axis=0) for c in np.unique(cells, axis=0)]
    rest = {}
    for s in seeds:
        while True:
            near = x[((x - s) ** 2).sum(axis=1) <= bandwidth**2]
            m = near.mean(axis=0)
            if ((m - s) ** 2).sum() < (1e-3 * bandwidth) ** 2:
                rest[tuple(np.round(m, 9))] = len(near)
                break
            s = m
    kept = []
    for place in sorted(rest, key=lambda p: (rest[p], *p), reverse=True):
        if all(((np.array(place) - np.array(k)) ** 2).sum() > bandwidth**2 for k in kept):
            kept.append(place)
    return kept


@pytest.mark.parametrize("width", [2, 8])
def test_mean_shift_equals_plain_numpy(spark, width):
    from millrace.operators.meanshift import train_mean_shift

    rng = np.random.default_rng(width)
    x = np.vstack([rng.normal(c, 1, (40, width)) for c in rng.normal(0, 6, (5, width))])
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    model = train_mean_shift(df, names, 3.0)
    want = np.array(brute_shift(x, 3.0))
    assert len(model.centers) == len(want) and np.allclose(model.centers, want, atol=1e-6)
    placed = np.array([r.predictions for r in model.transform(df).collect()])
    assert (placed == ((x[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert model.transform(spark.createDataFrame([(None,) * width], ", ".join(f"{n} double" for n in names))).first().predictions is None


def test_halving_goes_on_from_its_table(spark, groups, tmp_path, monkeypatch):
    base = models.Algorithm("LogisticRegression", "classification")
    candidates = search.grid(base, {"regParam": [0.0, 5.0, 20.0, 50.0]})
    folder = str(tmp_path / "rungs")
    rungs = search.successive_halving(groups, candidates, "kind", "id", ["x", "y"], folds=2, factor=2, table=folder)
    found = [(r.rung, r.share) for r in rungs.orderBy("rung").collect()]
    assert found == [(0, 0.5)] * 4 + [(1, 1.0)] * 2 and rungs.where("loss is null").count() == 0
    assert search.best_of_rungs(rungs, candidates).input_variables["regParam"] == 0.0
    calls = []
    monkeypatch.setattr(search, "cv_loss", lambda *a, **k: calls.append(1) or 0.5)
    again = search.successive_halving(groups, candidates, "kind", "id", ["x", "y"], folds=2, factor=2, table=folder)
    assert not calls and sorted(map(tuple, again.collect())) == sorted(map(tuple, rungs.collect()))
    # a spent budget ends the search after the first rung, in which every candidate has a loss
    short = search.successive_halving(groups, candidates, "kind", "id", ["x", "y"], budget_seconds=-1, factor=2)
    assert {r.rung for r in short.collect()} == {0} and short.count() == len(calls) == 4


def test_own_models_by_record_and_back(spark, tmp_path):
    from millrace.sources.models import load_model, save_model

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(9, 1, (50, 2))])
    df = spark.createDataFrame([(i, float(a), float(b), int(a > 4), float(a - b)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y int, z double")
    records = [
        (models.Algorithm("IsolationForest", "anomaly", {"n_estimators": 10, "key": "id"}), None),
        (models.Algorithm("OneClassSVM", "anomaly", {"nu": 0.1}), None),
        (models.Algorithm("MeanShift", "clustering", {"bandwidth": 3.0}), None),
        (models.Algorithm("BayesianRidgeRegression", "regression"), "z"),
        (models.Algorithm("AdaBoost", "classification", {"n_estimators": 2}), "y"),
        (models.Algorithm("LogisticRegression", "classification"), "y"),
    ]
    for i, (algorithm, label) in enumerate(records):
        model = models.train(df, algorithm, label, ["a", "b"])
        save_model(model, f"{tmp_path}/{i}")
        one, two = (m.transform(df).select("id", F.col("predictions").cast("string")).orderBy("id").collect() for m in (model, load_model(f"{tmp_path}/{i}")))
        assert one == two and len(one) == 200
    ks = models.train(df.where("y = 0"), models.Algorithm("KolmogorovSmirnov", "drift", {"p": 0.1}), None, ["a", "b"])
    spot = models.train(df.where("y = 0"), models.Algorithm("SpotDiff", "drift", {"key": "id"}), None, ["a", "b"])
    for name, model in (("ks", ks), ("spot", spot)):
        save_model(model, f"{tmp_path}/{name}")
    for one, two in ((ks, spot), tuple(load_model(f"{tmp_path}/{n}") for n in ("ks", "spot"))):
        assert {r["drift"] for r in one.transform(df.where("y = 1")).collect()} == {1}
        assert two.transform(df.where("y = 1")).first()["auc"] > 0.9


def test_forest_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (800, 2)))] + [(-1, 0.5, 0.5)] * 300
    df = spark.createDataFrame(rows, "id long, x double, y double")
    one, two = (anomaly.train_isolation_forest(d, "id", ["x", "y"], trees=12, sample=32) for d in (df.coalesce(1), df.repartition(7).orderBy(F.desc("x"))))
    assert all(np.array_equal(a, b) for a, b in zip(one.trees, two.trees)) and len(one.trees) == 12


def test_permutation_over_slices(spark, monkeypatch):
    monkeypatch.setattr(explain, "SLICE_ROWS", 50)
    df = spark.range(1000).select("id", F.col("id").alias("x"))
    out = [(r["x"], r["__perm_x"]) for r in explain.shuffled(df, "id", ["x"], 3).collect()]
    assert sorted(b for _, b in out) == list(range(1000)) and all(a != b for a, b in out)
    # one cycle through all rows: nothing is exchanged only inside a slice
    follow, at, steps = dict(out), 0, 1
    while (at := follow[at]) != 0:
        steps += 1
    assert steps == 1000


def test_ridge_far_from_zero(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 300) + 1e8
    df = spark.createDataFrame([(float(v), float(3 * (v - 1e8) + 5)) for v in x], "x double, y double")
    fit = models.train(df, models.Algorithm("BayesianRidgeRegression", "regression"), "y", ["x"])
    assert abs(fit.coefficients["x"] - 3) < 1e-3


def test_prices_fall_into_ten_clusters(spark, tmp_path):
    """``summarize_kmeans`` clusters the prices themselves, ten to a histogram."""
    made = spark.range(600).selectExpr("id as o_orderkey", "case when id % 3 = 0 then 'F' else 'O' end as o_orderstatus", "cast(id % 10 * 500 + id % 7 as double) as o_totalprice")
    made.write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(QUERIES["summarize_kmeans"](spark, str(tmp_path))) == [("F", 200, 10, 1.0), ("O", 400, 10, 1.0)]


@pytest.mark.parametrize("name, options", [("AdaBoost", {"n_estimators": 2}), ("XGBoost", {"n_estimators": 2, "max_depth": 2}), ("CatBoost", {"iterations": 2, "depth": 2}), ("LinearRegression", {})])
def test_a_table_in_one_piece_is_trained_in_all_tasks(spark, monkeypatch, name, options):
    """Small files are read in a piece or two; a pass over the rows is to be shared by the tasks all the same."""
    from millrace.operators import boosting, gradient

    seen = []

    def sizes(df):
        seen.append([n for n in df.rdd.glom().map(len).collect() if n])
        return df

    for module in (boosting, gradient):
        monkeypatch.setattr(module, "materialize", lambda df, kept=module.materialize: sizes(kept(df)))
    fit = LinearRegression.fit
    monkeypatch.setattr(LinearRegression, "fit", lambda self, df: fit(self, sizes(df)))
    df = spark.range(800).selectExpr("cast(id as double) as x", "cast(id * 3 % 17 as double) as z", "cast(id % 50 as double) as y").coalesce(1)
    models.train(df, models.Algorithm(name, "regression", options), "y", ["x", "z"])
    assert seen and all(len(s) >= 8 and max(s) <= 200 for s in seen)
