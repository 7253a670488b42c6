"""Scripts of users, called by name in SQL."""

import pytest
from conftest import rows

from millrace.sources.scripts import register_script
from millrace.sources.sql import run_sql


def scripts():
    """Classes of a script of their own, as a notebook would have them."""

    class Runs:
        """Lengths of runs of rising values."""

        def __init__(self, least=1):
            self.least, self.last, self.n, self.key = least, None, 0, None

        def row(self, key, value):
            out = []
            if self.last is not None and not value > self.last:
                out, self.n = list(self.end()), 0
            self.key, self.last, self.n = key, value, self.n + 1
            return out

        def end(self):
            return [(self.key, self.n)] if self.n >= self.least else []

    class Doubled:
        def row(self, value):
            return None if value is None else [(value * 2,), (value * 2,)]

    return Runs, Doubled


def test_partitions_in_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 2), ("b", 2, 1), ("b", 1, 0), (None, 1, 1)], "k string, t int, v int").repartition(3)
    register_script(spark, "runs", scripts()[0], ["k", "v"], "k string, n int", ["k"], ["t"])
    assert rows(run_sql(spark, "select * from runs(table(df))", {"df": df})) == rows(spark.createDataFrame([("a", 2), ("a", 1), ("b", 2), (None, 1)], "k string, n int"))
    assert rows(run_sql(spark, "select k from runs(table(df), least => 2) where n = 2", {"df": df})) == rows(spark.createDataFrame([("a",), ("b",)], "k string"))
    assert run_sql(spark, "select * from runs(table(df))", {"df": df.where("false")}).count() == 0
    with pytest.raises(Exception, match="lacks"):
        run_sql(spark, "select * from runs(table(df))", {"df": df.drop("t")})


def test_rows_to_rows(spark):
    register_script(spark, "doubled", scripts()[1], ["v"], "w int")
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert sorted(r.w for r in run_sql(spark, "select * from doubled(table(df))", {"df": df}).collect()) == [2, 2, 6, 6]
    with pytest.raises(Exception, match="table"):
        spark.sql("select * from doubled(3)").collect()
