"""Ordered operators on event and time-series tables. A hot series is cut in slices (see ``skew``)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col
from millrace.quantiles import exact_quantiles
from millrace.session import spread
from millrace.skew import HOT_ROWS, join_back, micros, slice_of, time_slices, with_markers, with_position, with_previous


def rate_gap(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``gap``: change since the key's previous row; NULL on its first row."""
    prev = with_previous(df, keys, ts, ties, [value], hot_rows=hot_rows)
    return prev.withColumn("gap", col(value) - col(f"__prev_{value}")).drop(f"__prev_{value}")


def gap_alerts(df: DataFrame, gap: str = "gap", threshold: float = 50.0) -> DataFrame:
    """Rows whose gap is larger than the threshold either way."""
    return df.where(F.abs(col(gap)) > threshold)


def series_index(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``iteration``: 0-based place of the row in its series; rows without a time come first."""
    placed = with_position(df, keys, ts, ties, "iteration", hot_rows)
    return placed.withColumn("iteration", F.col("iteration") - 1)


def window_average(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int = 10, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``window_avg``: mean of the key's values over the last ``seconds``, this row included.

    Rows of a hot key near the end of a slice are also given to the next slice, where they serve as
    history and are dropped again; a slice is longer than the window. Rows without a time are a window of their own.
    """
    sliced, hot = time_slices(df, keys, ts, hot_rows, min_seconds=seconds)
    us = micros(col(ts))

    kind = df.select(F.avg(col(value)).alias("a")).schema["a"].dataType
    home = F.col("__slice")
    if hot:
        reach = F.coalesce(slice_of(us + seconds * 1_000_000, F.col("__bounds")), home)
        reach = F.when(home < 0, home).otherwise(reach)
        sliced = sliced.withColumn("__in", F.explode(F.when(home.isNotNull(), F.sequence(home, reach)).otherwise(F.array(home))))
    else:
        sliced = sliced.withColumn("__in", home)
    sliced = sliced.withColumns({"__home": home, "__us": us, "__x": col(value).cast("double")}).drop("__bounds").withColumn("__slice", F.col("__in")).drop("__in")
    schema = T.StructType([*df.schema.fields, T.StructField("window_avg", T.DoubleType())])
    names = df.columns

    def averaged(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("__us", "ascending")], null_placement="at_start"))
        own = pc.fill_null(pc.equal(table.column("__home"), table.column("__slice")), True)
        x = table.column("__x").combine_chunks()
        mean = _sliding_means(table.column("__us").combine_chunks(), x, seconds * 1_000_000)
        return table.select(names).append_column("window_avg", mean).filter(own)

    groups = spread(sliced, [*keys, "__slice"]).groupBy(*[col(k) for k in keys], "__slice")
    return groups.applyInArrow(averaged, schema).withColumn("window_avg", F.col("window_avg").cast(kind))


def _sliding_means(us: pa.Array, x: pa.Array, reach: int) -> pa.Array:
    """Mean of ``x`` over the rows up to ``reach`` before each row, in sorted times; rows without a time come first, together.

    A window is put together from stretches of 1, 2, 4, ... rows, whose sums are each made once: the work grows with the rows and
    the logarithm of a window's, and nothing is subtracted, so no value leaves a trace outside its windows.
    """
    n, none = len(us), us.null_count
    times = us.slice(none).to_numpy(zero_copy_only=False)
    lo = np.concatenate([np.zeros(none, np.int64), none + np.searchsorted(times, times - reach, side="left")])
    hi = np.concatenate([np.full(none, none, np.int64), none + np.searchsorted(times, times, side="right")])
    sums, counts = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.is_valid(x).to_numpy(zero_copy_only=False))])
    total, left, size = np.zeros(n), hi - lo, 1
    with np.errstate(invalid="ignore", over="ignore"):
        while size <= (left.max() if n else 0):
            odd = (left & size) > 0
            total[odd] += sums[lo[odd]]
            lo = lo + np.where(odd, size, 0)
            sums = sums[:-size] + sums[size:] if len(sums) > size else sums
            size *= 2
        seen = counts[hi] - counts[hi - left]
        mean = total / np.maximum(seen, 1)
    return pa.array(mean, pa.float64(), mask=seen == 0)


def average_alerts(df: DataFrame, keys: Sequence[str], ts: str, value: str, limit: float = 70.0, seconds: int = 10, scale: float = 100.0, **options) -> DataFrame:
    """Rows at which the sliding mean, times ``scale``, exceeds the limit."""
    return window_average(df, keys, ts, value, seconds, **options).where(F.col("window_avg") * scale > limit)


# --- time-series features -------------------------------------------------------------------

def minimal_features(df: DataFrame, key: str, value: str) -> DataFrame:
    """Length, sum, mean, median, deviation, variance (population), root mean square, min, max, largest magnitude."""
    x = col(value).cast("double")
    basic = df.groupBy(col(key)).agg(
        F.count(x).alias("length"), F.sum(x).alias("sum_values"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("standard_deviation"), F.var_pop(x).alias("variance"),
        F.sqrt(F.avg(x * x)).alias("root_mean_square"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        F.max(F.abs(x)).alias("absolute_maximum"),
    )
    median = exact_quantiles(df, [key], [value], [0.5]).select(col(key), F.col("q")[0].alias("median"))
    return join_back(basic, median, [key])


def _in_position_blocks(
    df: DataFrame, key: str, ts: str, value: str, ties: Sequence[str], halo: int, block: int, hot_rows: int
) -> DataFrame:
    """Rows with position, series length, mean and variance, laid out in blocks that overlap by ``halo`` rows."""
    x = col(value).cast("double")
    sliced, hot = time_slices(df, [key], ts, hot_rows)
    present = sliced.where(x.isNotNull()).select(col(key), "__slice", col(ts).alias("__ts"), *[col(t).alias(f"__t_{t}") for t in ties], x.alias("x"))
    whole = Window.partitionBy(col(key))
    order = ["__ts", *[f"__t_{t}" for t in ties]]
    first = F.greatest(F.floor((F.col("pos") - halo) / block), F.lit(0))
    last = F.floor((F.col("pos") + halo) / block)
    home = F.floor(F.col("pos") / block)
    if not hot:
        place = (F.row_number().over(whole.orderBy(*order)) - 1).cast("long")
        placed = present.select(col(key), "x", place.alias("pos"), F.count("x").over(whole).alias("n"), F.avg("x").over(whole).alias("mu"))
        return placed.withColumn("home", home).withColumn("block", F.explode(F.sequence(first, last)))
    sizes = present.groupBy(col(key), "__slice").agg(F.count("x").alias("__n"), F.sum("x").alias("__s"))
    before = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    markers = sizes.select(
        col(key), "__slice",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - 1).alias("__step"),
        F.sum("__n").over(whole).alias("n"),
        (F.sum("__s").over(whole) / F.sum("__n").over(whole)).alias("mu"),
    )
    stacked = with_markers(present.withColumn("__step", F.lit(1).cast("long")), markers)
    inside = Window.partitionBy(col(key), "__slice").orderBy("__marker", *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = stacked.select(
        col(key), "x", "__marker", F.sum("__step").over(so_far).alias("pos"),
        F.first("n").over(so_far).alias("n"), F.first("mu").over(so_far).alias("mu"),
    ).where("__marker = 1").drop("__marker")
    return placed.withColumn("home", home).withColumn("block", F.explode(F.sequence(first, last)))


def ordered_features(
    df: DataFrame, key: str, ts: str, value: str, ties: Sequence[str] = (), lags: Sequence[int] = (2, 3),
    peak_support: int = 2, block: int = 1_000_000, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Length, absolute sum of changes, energy, peaks and autocorrelations per series, in time order.

    A peak is larger than ``peak_support`` neighbours on both sides. The autocorrelation at a lag is
    NULL for a flat series or one not longer than the lag.
    """
    halo = max([peak_support, 1, *lags])
    rows = _in_position_blocks(df, key, ts, value, ties, halo, block, hot_rows)
    w = Window.partitionBy(col(key), "block").orderBy("pos")
    x, d = F.col("x"), F.col("x") - F.col("mu")
    near = [f(x, i).over(w) for i in range(1, peak_support + 1) for f in (F.lag, F.lead)]
    peak = F.lit(True)
    for other in near:
        peak = peak & F.coalesce(x > other, F.lit(False))
    wide = rows.select(
        col(key), "home", "block", "n", "x", d.alias("d"),
        F.abs(x - F.lag(x, 1).over(w)).alias("change"), peak.cast("int").alias("peak"),
        *[(F.lead(x, l).over(w) - F.col("mu")).alias(f"d{l}") for l in lags],
    ).where("home = block")
    aggs = [
        F.first("n").alias("length"),
        F.coalesce(F.sum("change"), F.lit(0.0)).alias("absolute_sum_of_changes"),
        F.sum(x * x).alias("abs_energy"),
        F.sum("peak").alias(f"number_peaks_{peak_support}"),
    ]
    spread = F.sum(F.col("d") * F.col("d")) / F.first("n")
    for l in lags:
        pairs = F.first("n") - l
        aggs.append(
            F.when((spread > 1e-12) & (pairs > 0), F.sum(F.col("d") * F.col(f"d{l}")) / (pairs * spread)).alias(
                f"autocorrelation_lag_{l}"
            )
        )
    return wide.groupBy(col(key)).agg(*aggs)


def time_series_features(df: DataFrame, key: str, ts: str, value: str, ties: Sequence[str] = (), all_features: bool = False, **options) -> DataFrame:
    """The ordered set when all features are asked for, else the minimal set."""
    if all_features:
        return ordered_features(df, key, ts, value, ties, **options)
    return minimal_features(df, key, value)


def ratio_percent(used: Column, total: Column) -> Column:
    return F.when(total != 0, used / total * 100)
