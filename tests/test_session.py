import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.columns import fresh_name, name_list, require


def test_pin_tells_small_from_large(spark):
    table, small = session.pin(spark.range(10), 30)
    assert small and table.count() == 10
    table, small = session.pin(spark.range(10).withColumn("x", F.rand(1)), 3)
    assert not small
    assert table.collect() == table.collect()  # written out, so drawn once


def test_small_checks(spark):
    assert session.at_most(spark.range(5), 5) and not session.at_most(spark.range(6), 5)
    assert session.scratch_folder(spark, "a") != session.scratch_folder(spark, "a")
    assert session.spread(spark.range(5), ["id"]).rdd.getNumPartitions() == 8


def test_names(spark):
    df = spark.range(1)
    assert name_list(" a , b") == ["a", "b"] and fresh_name(df, "id") == "_id"
    with pytest.raises(ValueError):
        name_list("")
    with pytest.raises(ValueError):
        require(df, ["zz"])


def test_pin_is_bounded_by_bytes(spark):
    wide = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000)).withColumn("a", F.array("id", "id"))
    assert session.pin(wide, 30)[1] and not session.pin(wide, 30, max_bytes=5_000)[1]


def test_scratch_is_removed(spark):
    folder = session.scratch_folder(spark, "gone")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    session._remove_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_package_reaches_workers_of_another_folder(tmp_path):
    """A query with Python in its tasks runs from any working folder."""
    root = str(Path(session.__file__).resolve().parents[1])
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from millrace.session import local_session\n"
        "print('rows', e.queries()['cooldown_alerts'](local_session(2), '/root/testdata/sf0.001').count() > 0)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows True" in out.stdout, out.stderr[-2000:]
