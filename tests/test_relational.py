import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import joins, project, sets
from millrace.operators.encode import dummy, one_hot
from millrace.operators.metrics import confusion_matrix
from millrace.operators.predicate import query
from millrace.operators.project import target_class_hits
from millrace.operators.summary import chart_heatmap, counts_by_value, group_histogram, summarize
from millrace.sources.files import infer_types
from millrace.sources.sql import run_sql

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a"), (2, NAN, "b"), (3, INF, " "), (4, -INF, ""), (5, None, None), (6, 7.0, "a")], "id int, x double, s string"
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("x > 5", [3, 6]),  # NaN is not above 5
        ("x == x", [1, 3, 4, 6]),  # missing equals nothing
        ("x != 1", [2, 3, 4, 5, 6]),  # but it differs from everything
        ("not x > 5", [1, 2, 4, 5]),
        ("~(s == 'a')", [2, 3, 4, 5]),
        ("s in ['a', 'b']", [1, 2, 6]),
        ("s not in ('a', 'b')", [3, 4, 5]),
        ("0 < x <= 7", [1, 6]),
        ("`x` > 0 & s == 'a' | id == 5", [1, 5, 6]),
        ("id % 2 == 0 and -id < -3", [4, 6]),
        ("s == 'a & b'", []),
    ],
)
def test_predicates(odd, text, expected):
    assert ids(query(odd, text)) == expected


def test_predicate_errors(odd):
    with pytest.raises(ValueError):
        query(odd, "nope > 1")
    with pytest.raises(ValueError):
        query(odd, "id in x")
    with pytest.raises(ValueError):
        query(odd, "__import__('os')")


def test_predicate_reaches_the_scan(spark, data, capsys):
    query(spark.read.parquet(f"{data}/orders.parquet"), "o_totalprice > 1000 and o_orderstatus == 'F'").select("o_orderkey").explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "Python" not in plan


def test_missing_values(odd):
    assert ids(project.drop_nans(odd)) == [1, 6]
    zero = {r["id"]: (r["x"], r["s"]) for r in project.fill_nans(odd).collect()}
    assert zero[2][0] == zero[3][0] == zero[4][0] == zero[5][0] == 0.0 and zero[5][1] == "0"
    filled = {r["id"]: r["x"] for r in project.fill_nans(odd, {"x": 9.0}).collect()}
    assert filled[2] == filled[3] == filled[5] == 9.0 and filled[1] == 1.0
    assert {r["id"]: r["s"] for r in project.blank_to_null(odd).collect()} == {1: "a", 2: "b", 3: None, 4: "", 5: None, 6: "a"}


def test_columns(odd):
    assert project.filter_columns(odd, "s, zzz, id").columns == ["s", "id"]
    assert project.drop_columns(odd, "s").columns == ["id", "x"]
    with pytest.raises(ValueError):
        project.drop_columns(odd, "s, zzz")
    with pytest.raises(ValueError):
        project.rename_columns(odd, "a, b")
    assert project.rename_one(odd, 1, "value").columns == ["id", "value", "s"]
    assert project.with_label(odd, F.lit(1)).columns[-1] == "LABEL"
    assert project.when_enabled(odd, project.drop_nans, enabled=False) is odd


def test_small_row_operators(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (-1, 2)], "label int, predictions int")
    marks = [r["results"] for r in project.mark_correct(df, "label").collect()]
    assert marks == ["✅", "❌", "❌", "❌"]
    flags = spark.createDataFrame([(-1,), (1,), (0,), (7,)], "predictions int")
    assert [r[0] for r in project.remap_anomaly(flags).collect()] == [1, 0, 0, 7]
    rounded = project.round_for_display(spark.createDataFrame([(0.125, 2), (0.375, 3)], "x double, n int"), 2)
    assert [r["x"] for r in rounded.collect()] == [0.12, 0.38]
    hits = project.target_class_hits(spark.createDataFrame([(2.9,), (-0.5,), (3.0,)], "predictions double"), "2", regression=True)
    assert [r["hit"] for r in hits.collect()] == [1, 0, 0]


def test_merge(spark):
    a = spark.createDataFrame([(1, "a", 10), (None, "n", 20), (3, "c", 30), (3, "d", 31)], "k int, v string, only int")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z"), (3, "w")], "k int, v string")
    out = joins.merge(a, b, "k")
    assert out.columns == ["k", "v_x", "only", "v_y"]
    assert rows(out) == rows(
        spark.createDataFrame(
            [(1, "a", 10, "x"), (None, "n", 20, "y"), (3, "c", 30, "w"), (3, "d", 31, "w"), (4, None, None, "z")],
            "k int, v_x string, only int, v_y string",
        )
    )
    assert [r["k"] for r in joins.merge_sorted(a, b, "k").collect()] == [1, 3, 3, 4, None]


def test_upsert_and_lookup(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, "C", 1)], "k int, v string, at int")
    assert joins.duplicate_keys(changes, "k").count() == 1
    newest = joins.last_write(changes, "k", ["at"])
    assert rows(joins.upsert(target, newest, "k")) == [(1, "a"), (2, "BB"), (3, "C")]
    found = joins.lookup(target, "k", spark.createDataFrame([(1, "one")], "id int, name string"), "id", "name")
    assert rows(found.select("k")) == [("one",), (None,)]
    assert rows(joins.lookup_map(target, "k", {2: "two"}).select("k")) == [("two",), (None,)]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(2.5, 1)], "w double, k int")
    out = sets.append(a, b)
    assert out.columns == ["k", "v", "w"] and out.count() == 3
    assert sets.preview(a, 0)[1] == 2 and sets.preview(a)[1] is None
    assert sets.distinct_values(spark.createDataFrame([(None,), (1,), (1,)], "k int"), "k").count() == 2
    assert [r[0] for r in sets.sorted_classes(spark.createDataFrame([(10,), (9,)], "k int"), "k").collect()] == ["10", "9"]


def test_scenario_ranges():
    assert joins.shock_range(0, 0.1, 0.05) == [0.0, 0.05, 0.1]
    assert math.isclose(sum(joins.shock_range(0, 1, 0.1)), 5.5)


def test_align_by_id(spark):
    a = spark.createDataFrame([("s", 1)], "id string, x int")
    b = spark.createDataFrame([("s", 2), ("t", 3)], "id string, y int")
    assert rows(joins.align_by_id([a, b], "id")) == [("s", 1, 2), ("t", None, 3)]


def test_arithmetic_follows_ieee(spark):
    rows = [(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 0.0), (3, -7.0, 3.0), (4, 7.0, -3.0), (5, None, 2.0), (6, 7.5, 2.0), (7, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double").withColumn("n", F.col("a").try_cast("int")).withColumn("m", F.col("b").try_cast("int"))
    table = df.toPandas()
    for text in ("a / b > 1", "a / b < -1", "a % b == 0", "a % b > 0", "a % b < 0", "a // b == -3", "a // b == 3", "a ** 2 > 48", "+a > 5", "a / b != 0", "-a ** 2 == -49"):
        want = table.query(text).id.tolist()
        assert ids(query(df, text)) == want, text
    assert ids(query(df, "a in [b * 3.75, 1]")) == [0, 2, 6]
    assert ids(query(df, "n / m > 1 or n % m == 2")) == [0, 3, 6]


def test_predictions_that_are_no_numbers(spark):
    df = spark.createDataFrame([(0, 3.7), (1, float("nan")), (2, 1e300), (3, None), (4, 3.0)], "id int, predictions double")
    assert [r["hit"] for r in target_class_hits(df, 3, regression=True).orderBy("id").collect()] == [1, 0, 0, 0, 1]


def test_sql_leaves_views_as_they_were(spark):
    spark.range(3).createOrReplaceTempView("mine")
    out = run_sql(spark, "select count(*) as n from mine join other using (id)", {"mine": spark.range(5), "other": spark.range(4)})
    assert out.first()["n"] == 4 and spark.table("mine").count() == 3
    assert not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("mine")


def test_codes_stay_text(spark):
    df = spark.createDataFrame([("12D", "1.5", "7", "1e3", "nan"), ("7F", "-2", "8", ".5", "inf")], "a string, b string, c string, d string, e string")
    assert [t for _, t in infer_types(df).dtypes] == ["string", "double", "bigint", "double", "double"]


def test_nan_is_missing_in_summaries(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", float("nan")), ("k", 2.0)], "k string, x double")
    out = summarize(df, "k").first()
    assert out["x_max"] == 2.0 and out["x_mean"] == 1.5 and out["x_median"] == 1.5
    assert sum(r["n"] for r in group_histogram(df, ["k"], "x", 4).collect()) == 2


def test_many_values_as_columns(spark):
    df = spark.range(2001).select(F.format_string("v%05d", "id").alias("v"), F.lit("r").alias("r"), "id")
    counts = counts_by_value(df, ["r"], ["v"])
    assert counts.count() == 2001 and counts.where("n != 1").isEmpty()
    assert len(one_hot(df, "v").columns) == 2003 and len(dummy(df, "v").columns) == 2002
    assert len(chart_heatmap(df, "r", "v").columns) == 2002
    small = df.where("id < 3").withColumn("predictions", F.col("v"))
    assert len(confusion_matrix(small, "v").columns) == 4


def test_a_lost_bracket_is_widened(spark, monkeypatch):
    from millrace import quantiles

    df = spark.range(20_000).select(F.exp(F.col("id") / 500).alias("x"))
    tight = quantiles.exact_quantiles(df, [], ["x"], [0.25, 0.5], small_rows=0, accuracy=10**7).first()["q"]
    assert np.allclose(tight, np.quantile(np.exp(np.arange(20_000) / 500), [0.25, 0.5]))
