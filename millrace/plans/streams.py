"""Streams over the event file, drained to a table."""

from pyspark.sql import functions as F

from millrace.operators import alerts
from millrace.plans.aggregates import rounded
from millrace.plans.ordered import COOLDOWN_SQL, METRIC_SQL, _GAP, _RULES, metric_events
from millrace.plans.registry import query
from millrace.session import scratch_folder
from millrace.sources.files import export_by_value
from millrace.streaming import cleanup, ordered, run, sources, stateful
from millrace.streaming.exchange import start_exchange


def _stream(t, *columns):
    stream = sources.record_stream(t.spark, t.folder, t.events.schema, pattern="events.parquet")
    return stream.select(*columns) if columns else stream


def _late(t, *columns, batches=4):
    """Events that arrive in batches, each row up to two days after newer ones: the stream, what brings each batch, and what closes it.

    A batch may take many files; it is brought whole before the stream goes on, as rows of its other files may be older than two days.
    """
    events = t.events.select(*columns).withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(172_800_000_000))
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    batch = F.floor((arrival - first) * batches / (last - first + 1))
    folder = scratch_folder(t.spark, "late")
    events.limit(0).write.parquet(folder)
    feeds = [lambda number=number: events.where(batch == number).write.mode("append").parquet(folder) for number in range(batches)]
    stream, close = ordered.closable(sources.record_stream(t.spark, folder, events.schema), "ts")
    return stream, feeds, close


@query("stream_gap_late", _GAP)
def _(t):
    """Rows that come out of order wait until the watermark has passed them."""
    stream, feeds, close = _late(t, "event_id", "user_id", "ts", "value")
    gaps = ordered.ordered_gaps(stream, ["user_id"], "ts", "value", ["event_id"], "2 days")
    return rounded(run.drain(t.spark, gaps, "late-gap", close, feeds), 6, "gap").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_cooldown_late", COOLDOWN_SQL)
def _(t):
    stream, feeds, close = _late(t, "event_id", "user_id", "ts", "value")
    fired = ordered.ordered_cooldown(stream.where((F.col("value") > 10) | (F.col("ts") >= ordered.END)).drop("value"), ["user_id"], "ts", 86_400, ["event_id"], "2 days")
    return run.drain(t.spark, fired, "late-cooldown", close, feeds).select("user_id", "event_id")


@query("stream_gap", _GAP)
def _(t):
    gaps = stateful.gap_stream(_stream(t, "event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", ["event_id"])
    return rounded(run.drain(t.spark, gaps, "gap"), 6, "gap")


@query(
    "stream_fanout",
    f"""with g as ({_GAP.replace('round(value - lag(value) over (partition by user_id order by ts, event_id), 6)', 'value - lag(value) over (partition by user_id order by ts, event_id)')}) select 'rate' as output, count(*) as n, round(sum(value), 4) as total from g
        union all select 'gap', count(*), round(sum(gap), 4) from g where gap is not null
        union all select 'alert', count(*), round(sum(gap), 4) from g where abs(gap) > 50""",
)
def _(t):
    ticks = _stream(t).select("event_id", F.col("user_id").cast("string").alias("key"), "ts", F.col("value").alias("rate"))
    places = {name: scratch_folder(t.spark, name) for name in ("rate", "gap", "alert", "progress")}
    start_exchange(ticks, places["rate"], places["gap"], places["alert"], places["progress"], ties=["event_id"]).awaitTermination()

    def total(name, column):
        return t.spark.read.parquet(places[name]).agg(
            F.lit(name).alias("output"), F.count("*").alias("n"), F.round(F.sum(column), 4).alias("total")
        )

    return total("rate", "rate").union(total("gap", "gap")).union(total("alert", "gap"))


@query("stream_rate", "select cast(user_id as varchar) as key, ts, value as rate from events where event_id % 9 <> 0")
def _(t):
    payload = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("value").alias("rate")))
    )
    rates = sources.extract_rate(_stream(t).select(payload.alias("value")))
    return run.drain(t.spark, rates, "rate").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_rules", METRIC_SQL)
def _(t):
    fired = alerts.metric_rules(metric_events(_stream(t)), rules=_RULES).select("event_id", "url", "rule", "observed")
    return rounded(run.drain(t.spark, fired, "rules"), 6, "observed")


@query("stream_cooldown", COOLDOWN_SQL)
def _(t):
    busy = _stream(t, "user_id", "event_id", "ts", "value").where("value > 10").withColumn("ts", F.col("ts").cast("timestamp"))
    fired = stateful.cooldown_stream(busy.drop("value"), ["user_id"], "ts", 86_400, ["event_id"])
    return run.drain(t.spark, fired, "cooldown").select("user_id", "event_id")


@query(
    "stream_hop_average",
    """with w as (select event_type, ts, value, unnest(generate_series(0, 2)) as k from events),
       s as (select event_type, value, time_bucket(interval 10 minutes, ts) - k * interval 10 minutes as start from w)
       select event_type, strftime(start, '%Y-%m-%d %H:%M:%S') as start, round(avg(value), 6) as average from s
       where start + interval 30 minutes <= (select max(ts) - interval 10 minutes from events) group by all""",
)
def _(t):
    """Windows the watermark has closed by the end of the input."""
    means = stateful.hop_average(
        _stream(t, "event_type", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "ts", "value", "30 minutes", "10 minutes"
    )
    out = run.drain(t.spark, means, "hops")
    return rounded(out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "average"), 6, "average")


@query(
    "stream_hop_average_closed",
    """with w as (select event_type, ts, value, unnest(generate_series(0, 2)) as k from events),
       s as (select event_type, value, time_bucket(interval 10 minutes, ts) - k * interval 10 minutes as start from w)
       select event_type, strftime(start, '%Y-%m-%d %H:%M:%S') as start, round(avg(value), 6) as average from s group by all""",
)
def _(t):
    """Every window: those still open at the end of the input come out when the stream is closed."""
    stream, feeds, close = _late(t, "event_id", "event_type", "ts", "value")
    means = stateful.hop_average(stream, ["event_type"], "ts", "value", "30 minutes", "10 minutes", "2 days")
    out = run.drain(t.spark, means, "late-hops", close, feeds)
    return rounded(out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "average"), 6, "average")


@query("stream_new_files", "select 'lang=' || lang as folder from documents group by 1")
def _(t):
    """Folders in which files arrived; a second look finds nothing new."""
    folder = scratch_folder(t.spark, "arrivals")
    export_by_value(t.documents.select("doc_id", "lang"), "lang", folder)
    seen, progress = scratch_folder(t.spark, "seen"), scratch_folder(t.spark, "seen-progress")
    for _again in range(2):
        run.start_table(sources.new_files(t.spark, folder, r"part-.*\.csv"), seen, progress).awaitTermination()
    found = t.spark.read.parquet(seen)
    once = found.groupBy("path").agg(F.count("*").alias("n")).where("n = 1")
    return once.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


@query("stream_delete_after", "select 4 as deleted, 0 as left_over, count(*) as n, count(distinct event_id) as ids from events")
def _(t):
    """Files of events go once their batch is committed, those of the last batch as well."""
    folder = scratch_folder(t.spark, "drop")
    t.events.repartition(4, "event_id").write.parquet(folder)
    out, progress = scratch_folder(t.spark, "read"), scratch_folder(t.spark, "read-progress")
    stream = sources.record_stream(t.spark, folder, t.events.schema, pattern="part-*", files_per_batch=3)
    deleted = cleanup.drain_and_delete(t.spark, stream, out, progress)
    left = [n for n in cleanup._names(t.spark, folder) if n.startswith("part-")]
    rows = t.spark.read.schema(t.events.schema).parquet(out)
    return rows.agg(F.lit(deleted).alias("deleted"), F.lit(len(left)).alias("left_over"), F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
