"""Metric threshold rules and cool-down."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col
from millrace.session import materialize, spread
from millrace.skew import HOT_ROWS, join_back, micros, time_slices

#: Slices of a hot key whose exit tables are put together in one group.
SUPER = 32

RULE_SCHEMA = "rule string, metric string, denominator string, scale double, op string, threshold double"

#: Fixed values: (rule, metric, denominator, scale, comparison, default limit).
RULES = (
    ("core_usage", "cpu.core", None, 100.0, ">", 70.0),
    ("combined_usage", "cpu.combined", None, 100.0, ">", 70.0),
    ("user_process_usage", "cpu.used", "cpu.total", 100.0, ">", 70.0),
    ("disk_write_speed", "disk.writes", None, 1.0, "<", 1000.0),
    ("free_disk_space", "disk.free", None, 1 / 1024, "<", 1024.0),
    ("used_disk_percent", "disk.used", None, 100.0, ">", 80.0),
    ("host_down", "up", None, 1.0, "=", 0.0),
    ("host_up", "up", None, 1.0, "=", 1.0),
    ("free_memory", "mem.free", None, 1 / 1024 / 1024, "<", 512.0),
    ("memory_usage", "mem.used", "mem.total", 100.0, ">", 70.0),
    ("received_bytes", "net.in", None, 1.0, ">", 1_000_000.0),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def rule_value(metrics: Column, metric: str, denominator: str | None, scale: float) -> Column:
    """Scaled metric, or the scaled ratio of two metrics; NULL where one is not reported."""
    value = F.try_element_at(metrics, F.lit(metric))
    if denominator is not None:
        total = F.try_element_at(metrics, F.lit(denominator))
        value = F.when(total != 0, value / total)
    return value * F.lit(scale)


def metric_rules(
    df: DataFrame, metrics: str = "metrics", rules: Sequence[tuple] = RULES, url: str | None = None, urls: Sequence[str] = ()
) -> DataFrame:
    """One row per event and rule that fires, with the rule name and the compared value.

    The short rule list becomes one array expression, so the operator is a projection without a
    shuffle and runs on streams as well. ``urls`` keeps those hosts only, before anything else.
    """
    if url is not None and urls:
        df = df.where(col(url).isin(list(urls)))
    compare = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}
    hits = []
    for name, metric, denominator, scale, op, limit in rules:
        value = rule_value(col(metrics), metric, denominator, scale)
        fired = F.coalesce(compare[op](value, F.lit(float(limit))) & ~F.isnan(value), F.lit(False))
        hits.append(F.when(fired, F.struct(F.lit(name).alias("rule"), value.alias("observed"))))
    fired = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return df.withColumn("__hit", F.explode(fired)).withColumns(
        {"rule": F.col("__hit.rule"), "observed": F.col("__hit.observed")}
    ).drop("__hit")


# --- cool-down ------------------------------------------------------------------------------

def _next_allowed(times: np.ndarray, period: int) -> np.ndarray:
    """Index of the first time strictly more than ``period`` after each one."""
    return np.searchsorted(times, times + period, side="right")


def firing_times(times: np.ndarray, period: int, last: float | None) -> np.ndarray:
    """Those of the sorted times that fire, given the last firing before them."""
    nxt = _next_allowed(times, period)
    i = 0 if last is None else int(np.searchsorted(times, last + period, side="right"))
    out = []
    while i < len(times):
        out.append(i)
        i = int(nxt[i])
    return times[out]


def _exits(times: np.ndarray, slice_start: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """For each possible first firing in a slice, the slice's last firing; runs of one exit kept once."""
    nxt = _next_allowed(times, period)
    n = len(times)
    jump = np.append(np.where(nxt < n, nxt, np.arange(n)), n)
    while True:  # pointer doubling
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    # A firing before the slice blocks nothing later than slice_start + period.
    entries = int(np.searchsorted(times, slice_start + period, side="right")) + 1
    exits = times[jump[: min(entries, n)]]
    keep = np.append(exits[1:] != exits[:-1], True)  # last entry of each run
    return times[: len(exits)][keep], exits[keep]


def _after(entry: np.ndarray, ends: np.ndarray, last: np.ndarray, period: int) -> np.ndarray:
    """The last firing after a slice, given the last one before it."""
    at = np.searchsorted(entry, last + period, side="right")
    return np.where(at < len(ends), ends[np.minimum(at, len(ends) - 1)], last) if len(ends) else last


def composed(parts: Sequence[tuple[np.ndarray, np.ndarray]], period: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit tables of slices in a row as the table of them all."""
    entry, ends = np.empty(0, np.int64), np.empty(0, np.int64)
    for first, exits in reversed(parts):
        if not len(first):
            continue
        exits = _after(entry, ends, exits, period)
        later = entry > first[-1]
        entry, ends = np.append(first, entry[later]), np.append(exits, ends[later])
        keep = np.append(ends[1:] != ends[:-1], True)  # last entry of each run
        entry, ends = entry[keep], ends[keep]
    return entry, ends


def cooldown(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    period_seconds: int = 120,
    ties: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows that fire when, after a firing, a key stays silent until strictly more than the period has passed.
    Rows without a time never fire.

    Firing depends on the firing before, so an ordinary key is walked in one group. A hot key is cut
    in time slices: each slice first works out, for every firing it could open with, the firing it
    would end with. Those tables are put together for ``SUPER`` slices in a row, a walk over the few tables that result
    hands each such group its last earlier firing, and walks inside the groups do so for every slice; then
    all slices mark their firings at once.
    """
    period = period_seconds * 1_000_000
    key_fields = [df.schema[k] for k in keys]
    timed = df.where(col(ts).isNotNull()).select(*[col(k) for k in keys], micros(col(ts)).alias("__us"), col(ts).alias("__ts"))
    times = timed.groupBy(*[col(k) for k in keys], "__us").agg(F.min("__ts").alias("__ts"))
    sliced, hot = time_slices(times, keys, "__ts", hot_rows, min_seconds=32 * period_seconds)
    # no time of a slice lies before the cut that opens it
    opening = F.get("__bounds", (F.col("__slice") - 1).cast("int"))
    sliced = sliced.withColumn("__open", opening).drop("__ts", "__bounds")
    names = list(keys)

    def slice_exits(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["__us"].to_numpy(np.int64))
        number = int(pdf["__slice"].iloc[0])
        opened = pdf["__open"].iloc[0]
        entry, last = _exits(t, int(t[0]) if pd.isna(opened) else int(opened), period)
        out = pd.DataFrame({"__entry": entry, "__exit": last})
        out["__slice"] = number
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[[*names, "__slice", "__entry", "__exit"]]

    exits = (
        spread(sliced.where("__slice is not null"), [*keys, "__slice"])
        .groupBy(*[col(k) for k in keys], "__slice")
        .applyInPandas(slice_exits, T.StructType([*key_fields, *_longs("__slice", "__entry", "__exit")]))
    )

    def tables(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
        parts = pdf.sort_values(["__slice", "__entry"]).groupby("__slice", sort=True)
        return [(int(n), p["__entry"].to_numpy(np.int64), p["__exit"].to_numpy(np.int64)) for n, p in parts]

    def with_keys(out: pd.DataFrame, pdf: pd.DataFrame, *columns: str) -> pd.DataFrame:
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[[*names, *columns]]

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, ends = composed([t[1:] for t in tables(pdf)], period)
        out = pd.DataFrame({"__entry": entry, "__exit": ends}).assign(__slice=int(pdf["__super"].iloc[0]))
        return with_keys(out, pdf, "__slice", "__entry", "__exit")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """The last firing before each slice, from ``__start``, the last one before them all."""
        start = pdf["__start"].iloc[0]
        last, rows = None if pd.isna(start) else int(start), []
        for number, entry, ends in tables(pdf):
            if last is not None:
                rows.append((number, last))
                last = int(_after(entry, ends, np.array([last]), period)[0])
            elif len(ends):
                last = int(ends[0])
        return with_keys(pd.DataFrame(rows, columns=["__slice", "__carry"]).astype("int64"), pdf, "__slice", "__carry")

    none = F.lit(None).cast("long")
    by, walked = [col(k) for k in keys], T.StructType([*key_fields, *_longs("__slice", "__carry")])
    if hot:
        exits = materialize(exits.withColumn("__super", F.floor(F.col("__slice") / SUPER)))
        groups = exits.groupBy(*by, "__super").applyInPandas(together, T.StructType([*key_fields, *_longs("__slice", "__entry", "__exit")]))
        # at most SLICES / SUPER tables a key
        start = groups.withColumn("__start", none).groupBy(*by).applyInPandas(walk, walked).withColumnsRenamed({"__slice": "__super", "__carry": "__start"})
        carry = join_back(exits, start, [*keys, "__super"]).groupBy(*by, "__super").applyInPandas(walk, walked)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["__us"].to_numpy(np.int64))
        last = pdf["__carry"].iloc[0]
        fired = firing_times(t, period, None if pd.isna(last) else int(last))
        out = pd.DataFrame({"__us": fired})
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[[*names, "__us"]]

    carried = join_back(sliced, carry, [*keys, "__slice"]) if hot else sliced.withColumn("__carry", none)
    fired = (
        spread(carried, [*keys, "__slice"])
        .groupBy(*[col(k) for k in keys], "__slice")
        .applyInPandas(mark, T.StructType([*key_fields, *_longs("__us")]))
    )
    # Of several rows at one firing time the first by ties is the one that fires.
    row = F.struct(*[col(c) for c in df.columns])
    order = F.struct(*[col(t) for t in ties]) if ties else F.xxhash64(*[col(c) for c in df.columns])
    stamped = df.withColumn("__us", micros(col(ts)))
    hits = join_back(stamped, fired, [*keys, "__us"], how="left_semi")
    return hits.groupBy(*[col(k) for k in keys], "__us").agg(F.min_by(row, order).alias("__row")).select("__row.*")


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]
