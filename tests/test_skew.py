"""The paths for hot keys and large tables give the same answers as the plain ones."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import skew
from millrace.operators import alerts, encode, metrics, series, split, summary
from millrace.operators.drift import ks_drift
from millrace.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def ticks(spark):
    """One key holds most of the rows; several rows share a time."""
    base = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        (F.lit(1_700_000_000) + F.floor(F.col("id") * 37 % 20000 / 3) * 3).cast("timestamp").alias("ts"),
        ((F.col("id") * 7919) % 1000 / 7).alias("x"),
    )
    return base.persist()


def test_previous_value(ticks):
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = ticks.select("id", (F.col("x") - F.lag("x").over(w)).alias("gap"))
    for hot in (50, 10**9):
        got = series.rate_gap(ticks, ["k"], "ts", "x", ["id"], hot_rows=hot).select("id", "gap")
        assert rows(got) == rows(plain)


@pytest.fixture(scope="module")
def uneven(spark):
    """A hot key with missing times, many rows of one time and a burst within a second."""
    n = F.col("id")
    us = (
        F.when(n % 17 == 0, None)
        .when(n % 5 == 0, F.lit(1_700_000_000_000_000))
        .when(n % 3 == 0, F.lit(1_700_000_900_000_000) + n * 37 % 900)
        .otherwise(F.lit(1_699_990_000_000_000) + n * 7_919_000)
    )
    key = F.when(n % 11 == 0, "b").when(n % 13 == 0, None).otherwise("a")
    return spark.range(4000).select("id", key.alias("k"), F.timestamp_micros(us).alias("ts"), (n * 7919 % 1000 / 7).alias("x")).persist()


@pytest.mark.parametrize("hot", [7, 300])
def test_hot_keys_give_the_same_answer(uneven, hot):
    plain = 10**9

    def same(build, *columns):
        one, two = (build(h).select("id", *[F.round(c, 9).alias(c) for c in columns]) for h in (hot, plain))
        assert rows(one) == rows(two) and one.count() == 4000

    same(lambda h: series.series_index(uneven, ["k"], "ts", ["id"], hot_rows=h), "iteration")
    same(lambda h: series.rate_gap(uneven, ["k"], "ts", "x", ["id"], hot_rows=h), "gap")
    same(lambda h: series.window_average(uneven, ["k"], "ts", "x", 10, hot_rows=h), "window_avg")
    for period in (1, 600):
        one, two = (sorted(r["id"] for r in alerts.cooldown(uneven, ["k"], "ts", period, ["id"], hot_rows=h).collect()) for h in (hot, plain))
        assert one == two
        events = [(str(r["k"]), r["us"], r["id"]) for r in uneven.select("k", F.unix_micros("ts").alias("us"), "id").collect() if r["us"] is not None]
        assert one == _walk(events, period * 1_000_000)


def test_slices_are_bounded_by_rows(uneven):
    sliced, hot = skew.time_slices(uneven, ["k"], "ts", hot_rows=400)
    times = sliced.where("__slice >= 0").groupBy("k", "__slice", "ts").count()
    sizes = times.groupBy("k", "__slice").agg((F.sum("count") - F.max("count")).alias("others")).collect()
    assert hot and len(sizes) > 10
    assert max(r["others"] for r in sizes) <= 200  # besides the rows of one time


def test_no_hot_key_reads_the_source_once(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    for out in (series.rate_gap(events, ["user_id"], "ts", "value", ["event_id"]), series.series_index(events, ["user_id"], "ts"), series.window_average(events, ["user_id"], "ts", "value"), series.ordered_features(events, "user_id", "ts", "value")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= 2


def test_hot_keys_are_found(ticks):
    assert [r["k"] for r in skew.hot_keys(ticks, ["k"], 500).collect()] == ["hot"]


def test_index(ticks):
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = ticks.select("id", (F.row_number().over(w) - 1).cast("long").alias("iteration"))
    got = series.series_index(ticks, ["k"], "ts", ["id"], hot_rows=100).select("id", "iteration")
    assert rows(got) == rows(plain)


def test_window_average(ticks):
    us = F.unix_micros("ts")
    w = Window.partitionBy("k").orderBy(us).rangeBetween(-10_000_000, 0)
    plain = ticks.select("id", F.round(F.avg("x").over(w), 9).alias("a"))
    got = series.window_average(ticks, ["k"], "ts", "x", 10, hot_rows=100)
    assert rows(got.select("id", F.round("window_avg", 9).alias("a"))) == rows(plain)


def test_series_features_do_not_depend_on_blocks(ticks):
    names = ["k", "length", "number_peaks_2"]
    a = series.ordered_features(ticks, "k", "ts", "x", ["id"])
    b = series.ordered_features(ticks, "k", "ts", "x", ["id"], block=40, hot_rows=100)
    assert rows(a.select(names)) == rows(b.select(names))
    for c in ("abs_energy", "absolute_sum_of_changes", "autocorrelation_lag_2", "autocorrelation_lag_3"):
        x, y = (dict((r["k"], r[c]) for r in d.select("k", c).collect()) for d in (a, b))
        assert x.keys() == y.keys() and all(np.isclose(x[k], y[k]) for k in x)


def test_series_features_edge_cases(spark):
    df = spark.createDataFrame([("flat", i, 2.0) for i in range(5)] + [("one", 0, 1.0)], "k string, t int, x double")
    out = {r["k"]: r for r in series.ordered_features(df.withColumn("t", F.col("t").cast("timestamp")), "k", "t", "x").collect()}
    assert out["flat"]["autocorrelation_lag_2"] is None and out["flat"]["number_peaks_2"] == 0
    assert out["one"]["absolute_sum_of_changes"] == 0.0 and out["one"]["length"] == 1


def _walk(events, period):
    last, fired = {}, []
    for key, us, ident in sorted(events):
        if key not in last or us > last[key] + period:
            last[key] = us
            fired.append(ident)
    return sorted(fired)


@pytest.mark.parametrize("hot", [100, 10**9])
@pytest.mark.parametrize("period", [5, 120, 4000])
def test_cooldown(ticks, hot, period):
    events = [(r["k"], r["us"], r["id"]) for r in ticks.select("k", F.unix_micros("ts").alias("us"), "id").collect()]
    got = alerts.cooldown(ticks, ["k"], "ts", period, ["id"], hot_rows=hot)
    assert sorted(r["id"] for r in got.collect()) == _walk(events, period * 1_000_000)


@pytest.mark.parametrize("small", [0, 10**9])
def test_exact_quantiles(spark, ticks, small):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    tied = ticks.withColumn("y", F.floor(F.col("x") / 40))
    got = {(r["k"], r["column"]): r["q"] for r in exact_quantiles(tied, ["k"], ["x", "y"], probs, small_rows=small).collect()}
    table = tied.select("k", "x", "y").toPandas()
    for (k, c), q in got.items():
        assert np.allclose(q, np.quantile(table.loc[table.k == k, c].astype(float), probs))
    assert len(got) == 8


@pytest.mark.parametrize("small", [0, 10**9])
def test_running_sums(ticks, small):
    per = ticks.groupBy("k", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    got = skew.running_sums(per, ["k"], "x", ["n"], descending=True, small_rows=small)
    assert rows(got.select("k", "x", "cum_n")) == rows(per.select("k", "x", F.sum("n").over(w).alias("cum_n")))


def test_numbering(spark, ticks):
    for small in (0, 10**9):
        got = encode.label_codes(ticks.select(F.concat(F.lit("v"), F.col("id")).alias("v")), "v", small_rows=small)
        values = [r["value"] for r in got.orderBy("code").collect()]
        assert values == sorted(f"v{i}" for i in range(3000))
        assert [r["code"] for r in got.orderBy("code").collect()] == list(range(3000))


def test_split_is_exact_and_complete(ticks):
    for share in (0.0, 0.37, 0.5, 1.0):
        train, test = split.split_train_test(ticks, "id", share, seed=4)
        assert test.count() == -(-3000 * (1000 - int(share * 1000)) // 1000)
        assert train.count() + test.count() == 3000
        assert train.join(test, "id").isEmpty()
    parts = split.split_stratified(ticks, "id", "k", (0.5, 0.25, 0.25), toy_rows=300)
    sizes = {(r["k"], r["part"]): r["count"] for r in parts.groupBy("k", "part").count().collect()}
    assert sizes["hot", "train"] == 37 and sizes["hot", "validation"] == 19 and sizes["hot", "test"] == 19
    nested = {r["part"]: r["count"] for r in split.split_nested(ticks, "id", 0.2, 0.25).groupBy("part").count().collect()}
    assert nested == {"test": 600, "validation": 600, "train": 1800}
    with pytest.raises(ValueError):
        split.split_train_test(ticks, "id", 1.5)


def test_histograms(spark):
    x = [0.0, 0.1, 0.1, 0.25, 0.3, 0.7, 0.9, 1.0, 1.0]
    df = spark.createDataFrame([("a", v) for v in x] + [("flat", 3.0)] * 4 + [("flat", None)], "k string, x double")
    out = summary.group_histogram(df, ["k"], "x", 10)
    got = {k: [r["n"] for r in out.where(F.col("k") == k).orderBy("bin").collect()] for k in ("a", "flat")}
    assert got["a"] == np.histogram(x, 10)[0].tolist()
    assert got["flat"] == np.histogram([3.0] * 4, 10)[0].tolist()
    total = out.groupBy("k").agg(F.sum("fraction").alias("s")).collect()
    assert all(np.isclose(r["s"], 1.0) for r in total)


def test_summary_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("a", 10.0, 0), ("b", 5.0, 1)], "k string, x double, y int")
    out = {r["k"]: r for r in summary.summarize(df, "k", "y").collect()}
    assert np.isclose(out["a"]["x_skew"], 0.675, atol=1e-2) and out["a"]["x_median"] == 2.0 and out["a"]["y"] == 0
    assert out["b"]["x_kurtosis"] is None and out["b"]["x_bin5"] == 1.0


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 400).round(1), rng.normal(0.3, 1, 300).round(1)
    frame = lambda v: spark.createDataFrame([(float(i),) for i in v], "x double")
    got = ks_drift(frame(a), frame(b)).first()
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert np.isclose(got["statistic"], want) and got["drift"] == 1


def test_adjusted_mutual_information(spark):
    import math

    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 3, 60).tolist(), rng.integers(0, 4, 60).tolist()
    df = spark.createDataFrame(list(zip(u, v)), "label int, predictions int")
    n = 60
    a, b = [u.count(i) for i in range(3)], [v.count(j) for j in range(4)]
    emi = 0.0
    for ai in a:
        for bj in b:
            for nij in range(max(1, ai + bj - n), min(ai, bj) + 1):
                p = math.comb(bj, nij) * math.comb(n - bj, ai - nij) / math.comb(n, ai)
                emi += nij / n * math.log(n * nij / (ai * bj)) * p
    h = lambda c: -sum(x / n * math.log(x / n) for x in c if x)
    mi = metrics.clustering_scores(df, "label").first()["mutual_info"]
    want = (mi - emi) / ((h(a) + h(b)) / 2 - emi)
    assert np.isclose(metrics.adjusted_mutual_info(df, "label").first()[0], want, atol=1e-9)
    same = spark.createDataFrame([(i, i) for i in range(3)] * 4, "label int, predictions int")
    assert np.isclose(metrics.adjusted_mutual_info(same, "label").first()[0], 1.0)


def test_exit_tables_put_together():
    """Composed tables say what walking the slices one after another does."""
    import numpy as np

    from millrace.operators.alerts import _after, _exits, composed, firing_times

    rng = np.random.default_rng(0)
    for _ in range(200):
        times = np.sort(rng.choice(2_000, rng.integers(1, 200), replace=False))
        period = int(rng.integers(1, 60))
        cuts = [0, *np.sort(rng.choice(np.arange(1, 2_000), 5, replace=False)), 2_000]
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            own = times[(times >= a) & (times < b)]
            parts.append(_exits(own, int(a), period) if len(own) else (own, own))
        entry, ends = composed(parts, period)
        for last in rng.integers(-200, 0, 10):
            fired = firing_times(times, period, int(last))
            assert _after(entry, ends, np.array([last]), period)[0] == (fired[-1] if len(fired) else last)


def test_value_slices_are_even_on_a_skewed_tail(spark):
    from pyspark.sql import functions as F

    from millrace.skew import value_slices

    df = spark.range(40_000).select(F.pow(F.lit(1.002), F.col("id") / 2).alias("v"))
    sizes = [r[0] for r in value_slices(df, [], "v").groupBy("__slice").count().select("count").collect()]
    assert max(sizes) < 40_000 / 200


def test_sliding_means_take_each_row_a_few_times():
    """Windows of thousands of rows, nulls and an infinite value: as summed row by row, in work that follows the rows."""
    import time

    import pyarrow as pa
    from millrace.operators.series import _sliding_means

    us, x = [None, None, 0, 0, 5, 9, 10, 20], [1.0, 3.0, 2.0, None, 4.0, float("inf"), 6.0, None]
    assert _sliding_means(pa.array(us, pa.int64()), pa.array(x), 9).to_pylist() == [2.0, 2.0, 2.0, 2.0, 3.0, float("inf"), float("inf"), None]
    n, begun = 400_000, time.process_time()
    got = _sliding_means(pa.array(range(n), pa.int64()), pa.array([1.0] * n), 100_000).to_pylist()
    assert got[0] == got[-1] == 1.0 and time.process_time() - begun < 20
