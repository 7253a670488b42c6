"""Streams in several batches, with a restart, agree with the batch operators on the same rows."""

import os
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import alerts, series
from millrace.streaming import cleanup, ordered, run, sources, stateful
from millrace.streaming.exchange import start_exchange


@pytest.fixture()
def dropped(spark, tmp_path):
    """Five files of ticks in time order, and the whole table."""
    table = spark.range(500).select(
        "id", F.concat(F.lit("k"), F.col("id") % 3).alias("key"),
        (F.lit(1_700_000_000) + F.col("id") * 20).cast("timestamp").alias("ts"), ((F.col("id") * 37) % 211).cast("double").alias("rate"),
    )
    folder = tmp_path / "in"
    for i in range(5):
        part = table.where(F.floor(F.col("id") / 100) == i).coalesce(1)
        part.write.mode("append").parquet(str(folder))
        now = time.time() - 1000 + i * 10
        for name in os.listdir(folder):
            path = folder / name
            if name.endswith(".parquet") and not (folder / f"{name}.seen").exists():
                os.utime(path, (now, now))
                (folder / f"{name}.seen").touch()
    return str(folder), table


def source(spark, folder, table, per_batch=1, **options):
    return sources.record_stream(spark, folder, table.schema, pattern="*.parquet", files_per_batch=per_batch, **options)


@pytest.mark.parametrize("per_batch", [1, 2])
def test_gaps(spark, dropped, per_batch):
    folder, table = dropped
    got = run.drain(spark, stateful.gap_stream(source(spark, folder, table, per_batch), ["key"], "ts", "rate", ["id"]))
    want = series.rate_gap(table, ["key"], "ts", "rate", ["id"])
    assert rows(got.select("id", "gap")) == rows(want.select("id", "gap"))


def test_cooldown(spark, dropped):
    folder, table = dropped
    got = run.drain(spark, stateful.cooldown_stream(source(spark, folder, table), ["key"], "ts", 300, ["id"]))
    assert rows(got.select("id")) == rows(alerts.cooldown(table, ["key"], "ts", 300, ["id"]).select("id"))


def test_hop_average(spark, dropped):
    folder, table = dropped
    got = run.drain(spark, stateful.hop_average(source(spark, folder, table), ["key"], "ts", "rate", "10 minutes", "5 minutes", "1 minute"))
    want = table.groupBy("key", F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.avg("rate").alias("average"))
    closed = table.agg(F.max("ts")).first()[0].timestamp() - 60
    want = want.where(F.col("w.end").cast("long") <= closed).select("key", "w.start", "w.end", "average")
    assert rows(got) == rows(want)


def test_fanout_survives_a_restart(spark, dropped, tmp_path):
    folder, table = dropped
    places = [str(tmp_path / n) for n in ("rate", "gap", "alert")]
    for _again in range(2):  # the second start finds nothing new and writes nothing twice
        start_exchange(source(spark, folder, table), *places, str(tmp_path / "progress"), ties=["id"]).awaitTermination()
    rate, gap, alert = (spark.read.parquet(p) for p in places)
    want = series.rate_gap(table, ["key"], "ts", "rate", ["id"])
    assert rate.count() == 500 and gap.count() == 497
    assert alert.count() == series.gap_alerts(want).count()


def test_new_files_once(spark, tmp_path):
    drop, seen, progress = tmp_path / "drop", str(tmp_path / "seen"), str(tmp_path / "progress")
    (drop / "sub").mkdir(parents=True)
    (drop / "a.csv").write_text("1\n")
    (drop / "sub" / "b.csv").write_text("22\n")
    (drop / "c.tmp").write_text("3\n")

    def look():
        run.start_table(sources.new_files(spark, str(drop), r".*\.csv"), seen, progress).awaitTermination()
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(seen).collect())

    assert look() == ["a.csv", "b.csv"]
    (drop / "d.csv").write_text("4\n")
    assert look() == ["a.csv", "b.csv", "d.csv"]


def test_payloads_and_triggers(spark):
    df = spark.createDataFrame([('{"key":"a","ts":"2024-01-01T00:00:00","rate":1.5}',), ("{",), ('{"key":"b"}',)], "value string")
    assert [(r["key"], r["rate"]) for r in sources.extract_rate(df).collect()] == [("a", 1.5)]
    assert run.trigger(None) == {"availableNow": True}
    assert run.trigger(0) == {"processingTime": "0 seconds"} and run.trigger(1.5) == {"processingTime": "90 seconds"}


@pytest.fixture()
def shuffled(spark, dropped, tmp_path):
    """The same ticks in four files; a row may come up to an hour after newer ones."""
    _, table = dropped
    late = F.col("ts").cast("long") + F.pmod(F.xxhash64("id"), F.lit(3600))
    numbered = table.withColumn("file", F.ntile(4).over(Window.orderBy(late)))
    folder = tmp_path / "shuffled"
    for i in range(1, 5):
        numbered.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield str(folder), table
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_late_rows_leave_in_order(spark, shuffled):
    folder, table = shuffled
    stream, close = ordered.closable(source(spark, folder, table), "ts")
    got = run.drain(spark, ordered.ordered_gaps(stream, ["key"], "ts", "rate", ["id"], "1 hour"), close=close)
    want = series.rate_gap(table, ["key"], "ts", "rate", ["id"])
    assert rows(got.select("id", "gap")) == rows(want.select("id", "gap"))
    # order of arrival gives other gaps
    plain = run.drain(spark, stateful.gap_stream(source(spark, folder, table), ["key"], "ts", "rate", ["id"]))
    assert rows(plain.select("id", "gap")) != rows(want.select("id", "gap"))


def test_rows_wait_until_the_stream_is_closed(spark, shuffled):
    folder, table = shuffled
    stream, _ = ordered.closable(source(spark, folder, table), "ts")
    got = run.drain(spark, ordered.ordered_gaps(stream, ["key"], "ts", "rate", ["id"], "1 hour"))
    newest = table.agg(F.max("ts")).first()[0]
    stretch = 3600 / ordered.STRETCHES
    left = table.join(got.select("id"), "id", "left_anti").agg(F.min("ts"), F.count("id")).first()
    assert left[1] > 0 and (newest - left[0]).total_seconds() <= 3600 + stretch
    want = series.rate_gap(table, ["key"], "ts", "rate", ["id"]).join(got.select("id"), "id")
    assert rows(got.select("id", "gap")) == rows(want.select("id", "gap"))


def test_late_rows_under_a_cooldown(spark, shuffled):
    folder, table = shuffled
    stream, close = ordered.closable(source(spark, folder, table), "ts")
    got = run.drain(spark, ordered.ordered_cooldown(stream, ["key"], "ts", 300, ["id"], "1 hour"), close=close)
    assert rows(got.select("id")) == rows(alerts.cooldown(table, ["key"], "ts", 300, ["id"]).select("id"))


def test_open_windows_come_out_at_the_end(spark, shuffled):
    folder, table = shuffled
    stream, close = ordered.closable(source(spark, folder, table), "ts")
    got = run.drain(spark, stateful.hop_average(stream, ["key"], "ts", "rate", "10 minutes", "5 minutes", "1 hour"), close=close)
    want = table.groupBy("key", F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.avg("rate").alias("average"))
    assert rows(got) == rows(want.select("key", "w.start", "w.end", "average"))


def test_state_in_order_without_spark():
    """A stretch's rows are packed in parts and read as one table, nulls included."""
    a, b = pd.DataFrame({"x": [1.5, None], "s": ["é", None]}), pd.DataFrame({"x": [2.5], "s": ["z"]})
    got = ordered._unpacked(ordered._packed(a) + ordered._packed(b))
    assert got["x"].tolist()[0::2] == [1.5, 2.5] and got["s"].tolist() == ["é", None, "z"]


def test_a_late_batch_of_many_files_loses_no_row(spark, tmp_path):
    """Events written by several tasks: each batch of the late stream then has several files."""
    from millrace.plans import QUERIES

    made = spark.range(0, 400, 1, 4).selectExpr("id as event_id", "id % 7 as user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, pmod(xxhash64(id), 2592000)) as ts", "cast(id as double) as value")
    made.write.parquet(f"{tmp_path}/events.parquet")
    late, stored = (QUERIES[name](spark, str(tmp_path)) for name in ("stream_gap_late", "rate_gap"))
    assert late.count() == 400 and rows(late.select("event_id", "gap")) == rows(stored.select("event_id", "gap"))


class Kept:
    """A state that lives in this process and counts the calls made of it."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        Kept.calls += 1
        one = {"get": lambda: self.held[0], "update": lambda v: self.held.update({0: v}), "exists": lambda: 0 in self.held, "clear": self.held.clear}
        many = {"keys": lambda: list(self.held), "getValue": self.held.get, "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": self.held.pop}
        return (one | many)[name]


def test_many_keys_share_the_calls_of_their_lot(monkeypatch):
    """Two hundred keys of a lot, their rows in ten stretches: the calls follow the stretches, and each key keeps its own memory."""
    states, timers, found = {}, [], {}
    handle = SimpleNamespace(getValueState=lambda n, _: states.setdefault(n, Kept()), getMapState=lambda n, *_: states.setdefault(n, Kept()), registerTimer=timers.append)
    monkeypatch.setattr(ordered, "in_order", lambda df, keys, ts, ties, step, *_: found.setdefault("step", step))
    ordered.ordered_gaps(SimpleNamespace(schema=T.StructType([])), ["key"], "ts", "x")
    work = ordered.InOrder(found["step"], ["id", "x", "__us", "__key"], ["__us", "id"], ["id", "gap"], 1000)
    work.init(handle)
    rows = pd.DataFrame({"id": range(2000), "x": [float(i * i) for i in range(2000)], "__us": [i // 200 * 1_000_000 for i in range(2000)], "__key": [str(i % 200) for i in range(2000)]})
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)
    Kept.calls = 0
    list(work.handleInputRows((0,), iter([rows.iloc[::-1].iloc[:1200].copy(), rows.iloc[::-1].iloc[1200:].copy()]), None))
    got = [r for ms in (3000, 10_000) for part in work.handleExpiredTimer((0,), clock(ms), clock(ms)) for r in part.itertuples(index=False)]
    assert Kept.calls < 60 and len(timers) == 2 and not states["waiting"].held
    gaps = dict(got)
    assert len(gaps) == 2000 and all(np.isnan(gaps[i]) if i < 200 else gaps[i] == i * i - (i - 200) ** 2 for i in range(2000))


def test_files_go_after_their_batch_is_committed(spark, dropped, tmp_path):
    folder, table = dropped
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")
    left = lambda: sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    every = left()

    def write(batch, number):
        if number == 2 and fails:
            raise ValueError("no room")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def start():
        stream = source(spark, folder, table).writeStream.foreachBatch(write).option("checkpointLocation", progress)
        return stream.trigger(availableNow=True).start()

    fails = True
    with pytest.raises(Exception, match="no room"):
        cleanup.delete_while_running(start(), spark, progress)
    assert len(every) == 5 and len(left()) == 3 and set(left()) < set(every)
    fails = False
    assert cleanup.delete_while_running(start(), spark, progress) >= 3
    assert left() == [] and spark.read.parquet(out).select("id").distinct().count() == 500 == spark.read.parquet(out).count()
    assert cleanup.committed_files(spark, str(tmp_path / "nowhere")) == ([], -1)


def test_drained_files_go(spark, dropped, tmp_path):
    folder, table = dropped
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    assert cleanup.drain_and_delete(spark, source(spark, folder, table, 2), out, progress) == 5
    assert not [f for f in os.listdir(folder) if f.endswith(".parquet")] and spark.read.parquet(out).count() == 500
