"""Gradient boosting against plain numpy, and against what a weaker model would reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import gradient, metrics, models, ordered_targets
from millrace.sources.models import load_model, save_model


def plain_tree(x, g, h, cuts, depth, reg, least):
    """Leaf value per row of one greedy tree, by trying every cut on every node."""
    out = np.zeros(len(g))

    def grow(rows, level):
        best = (1e-12, None)
        if level < depth:
            for f, places in enumerate(cuts):
                v = x[rows, f]
                for c in places:
                    for side in (True, False):
                        left = np.where(np.isnan(v), side, v <= c)
                        a, b = rows[left], rows[~left]
                        if not len(a) or not len(b) or h[a].sum() < least or h[b].sum() < least:
                            continue
                        s = lambda r: g[r].sum() ** 2 / (h[r].sum() + reg)
                        gain = (s(a) + s(b) - s(rows)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
        if best[1] is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + reg)
        else:
            grow(best[1][0], level + 1)
            grow(best[1][1], level + 1)

    grow(np.arange(len(g)), 0)
    return out


def sample(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    z = np.where(np.isnan(x), 0.7, x)
    y = np.round(z[:, 0] * 2 + (z[:, 1] > 0.3) * 3 - z[:, 2] * z[:, 0] + rng.normal(size=n) * 0.1, 3)
    rows = [(int(i), *[None if np.isnan(v) else float(v) for v in r], float(t), ["low", "mid", "top"][int(t > 0) + int(t > 2)]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, kind string"), x, y


def test_rounds_equal_plain_numpy(spark):
    df, x, y = sample(spark)
    model = models.train(df, models.Algorithm("XGBoost", "regression", {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.5, "max_bin": 200}), "y", ["a", "b", "c"])
    cuts = gradient.quantile_cuts(df, ["a", "b", "c"], 200)
    m = np.full(len(y), y.mean())
    for _ in range(6):
        m += 0.5 * plain_tree(x, m - y, np.ones(len(y)), cuts, 3, 1.0, 1.0)
    got = [r.predictions for r in model.transform(df).orderBy("id").collect()]
    assert np.allclose(got, m, atol=1e-6)


def test_softmax_equals_plain_numpy(spark):
    df, x, y = sample(spark, 200, 3)
    model = models.train(df, models.Algorithm("XGBoost", "classification", {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.5, "max_bin": 200, "min_child_weight": 0.5}), "kind", ["a", "b", "c"])
    cuts = gradient.quantile_cuts(df, ["a", "b", "c"], 200)
    place = (y > 0).astype(int) + (y > 2)
    m = np.zeros((len(y), 3))
    for _ in range(3):
        p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        m = m + 0.5 * np.stack([plain_tree(x, p[:, k] - (place == k), 2 * p[:, k] * (1 - p[:, k]), cuts, 2, 1.0, 0.5) for k in range(3)], axis=1)
    got = [r.predictions for r in model.transform(df).orderBy("id").collect()]
    assert got == [["low", "mid", "top"][k] for k in m.argmax(1)]


def test_symmetric_levels_share_a_split():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=(4, 3, 6)), rng.random((4, 3, 6)) + 0.1
    for a in (g, h):  # every feature adds up to the same rows
        a[:, 1:, 0] += (a[:, :1].sum(2) - a[:, 1:].sum(2))
    gain, choice = gradient.best_splits(g, h, 1.0, 0.0, 0.0, True)
    assert len(set(gain)) == 1 and len({tuple(c) for c in choice}) == 1
    alone, _ = gradient.best_splits(g, h, 1.0, 0.0, 0.0, False)
    assert (alone >= -1e-9).all() and alone.sum() >= gain[0] - 1e-9


def shops(spark, n=3000, levels=300, seed=5):
    """A target that hangs on a category of many values, next to a weak number."""
    rng = np.random.default_rng(seed)
    effect = rng.normal(size=levels) * 3
    c = (rng.random(n) ** 2 * levels).astype(int)
    x = rng.normal(size=n)
    y = effect[c] + 0.5 * x + rng.normal(size=n) * 0.5
    return spark.createDataFrame([(int(i), f"shop{k}", float(a), float(t)) for i, (k, a, t) in enumerate(zip(c, x, y))], "id long, shop string, x double, y double")


def r2(model, test):
    scored = models.score(model, test, "y", "regression")
    return metrics.regression_scores(scored, "y").first()["r2"]


def test_ordered_targets_beat_one_hot(spark):
    df = shops(spark)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    options = {"iterations": 12, "depth": 4, "learning_rate": 0.4}
    coded = models.train(train, models.Algorithm("CatBoost", "regression", options | {"key": "id"}), "y", ["shop", "x"])
    # one column for each of the 40 most frequent shops
    top = [r.shop for r in train.groupBy("shop").count().orderBy(F.desc("count"), "shop").limit(40).collect()]
    wide = df.withColumns({f"h{i}": (F.col("shop") == s).cast("double") for i, s in enumerate(top)})
    plain = models.train(wide.where("id % 4 > 0"), models.Algorithm("XGBoost", "regression", {"n_estimators": 12, "max_depth": 4, "learning_rate": 0.4}), "y", ["x", *[f"h{i}" for i in range(40)]])
    good, weak = r2(coded, test), r2(plain, wide.where("id % 4 = 0"))
    assert good > 0.8 and good > weak + 0.1
    # an unknown and a missing shop have the prior
    fresh = coded.transform(spark.createDataFrame([(1, "nowhere", 0.0), (2, None, 0.0)], "id long, shop string, x double"))
    assert len({r.predictions for r in fresh.collect()}) == 1


def test_no_row_sees_its_own_target(spark):
    """A target without any structure: ordered codes are no help, while plain means of small categories leak it."""
    noise = spark.range(600).select("id", F.concat(F.lit("c"), F.floor(F.col("id") / 2)).alias("c"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("y"))
    coded = ordered_targets.ordered_codes(noise, ["id"], "c", F.col("y"), "code")
    plain = noise.join(noise.groupBy("c").agg(F.avg("y").alias("mean")), "c")
    assert abs(coded.agg(F.corr("code", "y")).first()[0]) < 0.2 < plain.agg(F.corr("mean", "y")).first()[0]


def test_codes_with_missing_values(spark):
    rows = [(1, None, 2.0), (2, None, None), (3, "a", 4.0), (4, "a", 6.0), (4, "a", 6.0), (5, "b", None)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    got = ordered_targets.ordered_codes(df, ["id"], "c", F.col("y"), "code", prior=1.0, weight=2.0, seed=3).collect()
    assert len(got) == 6 and all(r.code is not None for r in got)
    import hashlib

    order = lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest()
    for r in got:
        before = [y for i, c, y in rows if c == r.c and y is not None and order(i) < order(r.id)]
        if r.id != 4:
            assert math.isclose(r.code, (sum(before) + 2.0) / (len(before) + 2.0))


@pytest.mark.parametrize("name", ["XGBoost", "CatBoost"])
def test_saved_and_restored(spark, tmp_path, name):
    df, _, _ = sample(spark, 150, 7)
    algorithm = models.Algorithm(name, "classification", {"iterations": 3, "max_depth": 2, "seed": 4})
    model = models.train(df.withColumn("half", F.when(F.col("id") % 3 > 0, F.col("kind"))), algorithm, "kind", ["a", "b"] + ["half"] * (name == "CatBoost"))
    rows = df.withColumn("half", F.when(F.col("id") % 3 > 0, F.col("kind")))
    save_model(model, str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"))
    want = [r.predictions for r in model.transform(rows).orderBy("id").collect()]
    assert [r.predictions for r in again.transform(rows).orderBy("id").collect()] == want
    assert set(want) <= {"low", "mid", "top"} and len(set(want)) > 1
    assert model.transform(rows).columns == [*rows.columns, "predictions"]


def test_options_and_odd_tables(spark):
    assert gradient.boosting_options({"n_estimators": 3, "eta": 0.1, "random_state": 1}) == {"rounds": 3, "rate": 0.1}
    with pytest.raises(ValueError, match="unknown option"):
        gradient.boosting_options({"booster": "dart"})
    same = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (None, 5.0), (float("nan"), None)], "x double, y double")
    model = models.train(same, models.Algorithm("XGBoost", "regression", {"n_estimators": 2}), "y", ["x"])
    assert [r.predictions for r in model.transform(same).collect()] == [5.0] * 4
    empty = models.train(same.where("false"), models.Algorithm("XGBoost", "regression", {"n_estimators": 2}), "y", ["x"])
    assert [r.predictions for r in empty.transform(same).collect()] == [0.0] * 4
