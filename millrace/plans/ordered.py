"""Time-ordered queries on events."""

from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import alerts, series, wavelets
from millrace.plans.aggregates import rounded
from millrace.plans.registry import query

#: Keys with more rows than this are cut in slices; low enough that the sample tables exercise it.
HOT = 60

_GAP = "select event_id, user_id, ts, value, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as gap from events"


def _events(t, *columns):
    return t.events.select(*(columns or ("event_id", "user_id", "ts", "value")))


@query("rate_gap", _GAP)
def _(t):
    return rounded(series.rate_gap(_events(t), ["user_id"], "ts", "value", ["event_id"]), 6, "gap")


@query("rate_gap_hot", _GAP)
def _(t):
    return rounded(series.rate_gap(_events(t), ["user_id"], "ts", "value", ["event_id"], hot_rows=HOT), 6, "gap")


@query("gap_alerts", f"select * from ({_GAP}) where abs(gap) > 50")
def _(t):
    gaps = rounded(series.rate_gap(_events(t), ["user_id"], "ts", "value", ["event_id"]), 6, "gap")
    return series.gap_alerts(gaps)


@query("series_index", "select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as iteration from events")
def _(t):
    return series.series_index(_events(t, "event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"], hot_rows=HOT)


_WINDOW = """select event_id, event_type, ts, value, round(avg(value) over (partition by event_type order by ts range between interval 30 minutes preceding and current row), 6) as window_avg from events"""


@query("window_avg_time", _WINDOW)
def _(t):
    df = _events(t, "event_id", "event_type", "ts", "value")
    return rounded(series.window_average(df, ["event_type"], "ts", "value", 1800, hot_rows=HOT), 6, "window_avg")


@query("window_avg_alerts", f"select * from ({_WINDOW}) where window_avg * 2 > 70")
def _(t):
    df = _events(t, "event_id", "event_type", "ts", "value")
    return rounded(series.average_alerts(df, ["event_type"], "ts", "value", 70.0, 1800, scale=2.0), 6, "window_avg")


@query(
    "ts_features_minimal",
    """select user_id, count(*) as length, round(sum(value), 4) as sum_values, round(avg(value), 6) as mean, round(stddev_pop(value), 5) as standard_deviation,
              round(var_pop(value), 4) as variance, round(sqrt(avg(value * value)), 5) as root_mean_square, min(value) as minimum, max(value) as maximum,
              max(abs(value)) as absolute_maximum, round(quantile_cont(value, 0.5), 6) as median from events group by 1""",
)
def _(t):
    out = rounded(series.minimal_features(t.events, "user_id", "value"), 4, "sum_values", "variance")
    return rounded(rounded(out, 5, "standard_deviation", "root_mean_square"), 6, "mean", "median")


_ORDERED = """
  with s as (select user_id, value as x, avg(value) over (partition by user_id) as mu, count(*) over (partition by user_id) as n,
               lag(value, 1) over w as p1, lag(value, 2) over w as p2, lead(value, 1) over w as f1, lead(value, 2) over w as f2, lead(value, 3) over w as f3
             from events window w as (partition by user_id order by ts, event_id))"""


def _ordered(t):
    return series.time_series_features(t.events, "user_id", "ts", "value", ["event_id"], all_features=True, block=50, hot_rows=HOT)


@query(
    "ts_abs_changes",
    _ORDERED + " select user_id, max(n) as length, round(coalesce(sum(abs(x - p1)), 0), 6) as absolute_sum_of_changes, round(sum(x * x), 6) as abs_energy from s group by 1",
)
def _(t):
    out = _ordered(t).select("user_id", "length", "absolute_sum_of_changes", "abs_energy")
    return rounded(out, 6, "absolute_sum_of_changes", "abs_energy")


@query(
    "ts_peaks",
    _ORDERED + " select user_id, count(*) filter (x > p1 and x > p2 and x > f1 and x > f2) as number_peaks_2 from s group by 1",
)
def _(t):
    return _ordered(t).select("user_id", "number_peaks_2")


@query(
    "ts_autocorr",
    _ORDERED
    + """ select user_id, round(case when max(n) > 2 and var_pop(x) > 1e-12 then sum((x - mu) * (f2 - mu)) / ((max(n) - 2) * var_pop(x)) end, 6) as autocorrelation_lag_2,
                 round(case when max(n) > 3 and var_pop(x) > 1e-12 then sum((x - mu) * (f3 - mu)) / ((max(n) - 3) * var_pop(x)) end, 6) as autocorrelation_lag_3 from s group by 1""",
)
def _(t):
    out = _ordered(t).select("user_id", "autocorrelation_lag_2", "autocorrelation_lag_3")
    return rounded(out, 6, "autocorrelation_lag_2", "autocorrelation_lag_3")


_RICKER = "2 / (sqrt(3 * w) * power(pi(), 0.25)) * (1 - z * z) * exp(-z * z / 2)"


@query(
    "ts_wavelet_peaks",
    f"""with e as (
      select user_id, value as x, row_number() over (partition by user_id order by ts, event_id) - 1 as p, count(*) over (partition by user_id) as n from events
    ), k as (
      select n, w, j, {_RICKER} as h from (
        select n, w, m, j, (j - (m - 1) / 2) / w as z from (
          select n, w, m, unnest(range(m)) as j from (select distinct n, w, least(10 * w, n) as m from e, (values (1), (2), (3)) widths(w))))
    ), waves as (
      select a.user_id, a.n, a.p, k.w, sum(b.x * k.h) as wave from e a join k on k.n = a.n
      join e b on b.user_id = a.user_id and b.p = a.p + (least(10 * k.w, a.n) - 1) // 2 - k.j group by all
    ), peaks as (
      select * from (select *, lag(wave) over s as before, lead(wave) over s as after from waves window s as (partition by user_id, w order by p))
      where wave > before and wave > after
    ), first as (select user_id, n, p, min(w) as w, abs(arg_min(wave, w)) as s from peaks group by all),
    loud as (
      select f.user_id, f.p, f.w from first f join waves v on v.user_id = f.user_id and v.w = 1
        and v.p >= f.p - ceil(f.n / 20)::bigint // 2 and v.p < f.p + ceil(f.n / 20)::bigint // 2 + ceil(f.n / 20)::bigint % 2
      group by f.user_id, f.p, f.w, f.s having f.s >= abs(quantile_cont(v.wave, 0.1))
    )
    select user_id, count(*) filter (w <= 2) as number_cwt_peaks_2, count(*) filter (w <= 3) as number_cwt_peaks_3
    from (select distinct user_id from events) left join loud using (user_id) group by user_id""",
)
def _(t):
    return wavelets.wavelet_peaks(t.events, "user_id", "ts", "value", ["event_id"])


# --- rules ----------------------------------------------------------------------------------

_RULES = (
    ("busy", "cpu", None, 100.0, ">", 70.0),
    ("share", "used", "total", 100.0, ">", 80.0),
    ("low_disk", "disk", None, 1 / 1024, "<", 0.01),
    ("down", "up", None, 1.0, "=", 0.0),
)


def metric_events(df):
    """Every event read as a report of a node: the user is the node, the metrics come from the value."""
    metrics = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("cpu", "used", "total", "disk", "up")]),
        F.array(
            F.col("value") / 500, F.col("value"), F.when(F.col("event_id") % 3 == 0, 100.0).otherwise(400.0),
            F.col("value") * 2, F.when(F.col("event_type") == "error", 0.0).otherwise(1.0),
        ),
    )
    return df.select("event_id", "ts", F.col("user_id").cast("string").alias("url"), metrics.alias("metrics"))


METRIC_SQL = """
  with m as (select event_id, cast(user_id as varchar) as url, value / 500 as cpu, value as used, case when event_id % 3 = 0 then 100.0 else 400.0 end as total,
                    value * 2 as disk, case when event_type = 'error' then 0.0 else 1.0 end as up from events)
  select event_id, url, 'busy' as rule, round(cpu * 100, 6) as observed from m where cpu * 100 > 70
  union all select event_id, url, 'share', round(used / total * 100, 6) from m where used / total * 100 > 80
  union all select event_id, url, 'low_disk', round(disk / 1024, 6) from m where disk / 1024 < 0.01
  union all select event_id, url, 'down', round(up, 6) from m where up = 0"""


@query("metric_rules", METRIC_SQL)
def _(t):
    out = alerts.metric_rules(metric_events(t.events), rules=_RULES)
    return rounded(out.select("event_id", "url", "rule", "observed"), 6, "observed")


@query("metric_rules_one_host", f"select event_id, rule, observed from ({METRIC_SQL}) where url = '8'")
def _(t):
    out = alerts.metric_rules(metric_events(t.events), rules=_RULES, url="url", urls=["8"])
    return rounded(out.select("event_id", "rule", "observed"), 6, "observed")


COOLDOWN_SQL = """
  with recursive e as (select user_id, event_id, ts, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events where value > 10),
  walk as (
    select user_id, event_id, rn, us as last, true as fired from e where rn = 1
    union all
    select e.user_id, e.event_id, e.rn, case when e.us > w.last + 86400000000 then e.us else w.last end, e.us > w.last + 86400000000
    from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
  select user_id, event_id from walk where fired"""


def _firings(t, hot_rows):
    df = t.events.where("value > 10").select("user_id", "event_id", "ts")
    return alerts.cooldown(df, ["user_id"], "ts", 86_400, ["event_id"], hot_rows=hot_rows).select("user_id", "event_id")


@query("cooldown_alerts", COOLDOWN_SQL)
def _(t):
    return _firings(t, 1_000_000)


@query("cooldown_alerts_hot", COOLDOWN_SQL.replace("user_id, event_id, ts, epoch_us(ts)", "event_type as user_id, event_id, ts, epoch_us(ts)").replace("partition by user_id", "partition by event_type").replace("86400000000", "7200000000"))
def _(t):
    df = t.events.where("value > 10").select(F.col("event_type").alias("user_id"), "event_id", "ts")
    return alerts.cooldown(df, ["user_id"], "ts", 7_200, ["event_id"], hot_rows=HOT).select("user_id", "event_id")


# --- calendars ------------------------------------------------------------------------------

_DAYS = "select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as date) as day from orders"
_DOW = "extract(dow from day)"


def _order_days(t):
    bounds = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return dates.days_between(bounds, "a", "b")


_CALENDARS = {
    "every_monday": f"{_DOW} = 1",
    "monday_wednesday_friday": f"{_DOW} in (1, 3, 5)",
    "week_days": f"{_DOW} between 1 and 5",
    "weekend": f"{_DOW} in (0, 6)",
    "first_of_month": "extract(day from day) = 1",
    "last_of_month": "day = last_day(day)",
    "new_year": "extract(doy from day) = 1",
}


@query(
    "calendar_days",
    f"with d as ({_DAYS}), o as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1) "
    + " union all ".join(
        f"select '{rule}' as rule, strftime(d.day, '%Y-%m-%d') as day, coalesce(n, 0) as orders from d left join o using (day) where {cond.replace('day)', 'd.day)') if rule == 'last_of_month' else cond}"
        for rule, cond in _CALENDARS.items()
    ).replace("day = last_day(d.day)", "d.day = last_day(d.day)"),
)
def _(t):
    """Orders placed on the days of each calendar."""
    days = _order_days(t)
    every = [dates.apply_calendar(days, rule).withColumn("rule", F.lit(rule)) for rule in _CALENDARS]
    stacked = every[0]
    for c in every[1:]:
        stacked = stacked.unionByName(c)
    counts = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return stacked.join(counts, "day", "left").na.fill(0, ["orders"]).withColumn("day", F.col("day").cast("string"))


@query(
    "calendar_minus_holidays",
    f"""with d as ({_DAYS}), off as (select distinct cast(o_orderdate as date) as day from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')
        select strftime(day, '%Y-%m-%d') as day from d where {_DOW} between 1 and 5 and day not in (select day from off)
        union select strftime(l_shipdate, '%Y-%m-%d') from lineitem where l_discount = 0.1 and l_quantity = 50""",
)
def _(t):
    off = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day"))
    extra = t.lineitem.where("l_discount = 0.1D and l_quantity = 50").select(F.to_date("l_shipdate").alias("day"))
    return dates.apply_calendar(_order_days(t), "week_days", off, extra).select(F.col("day").cast("string"))
