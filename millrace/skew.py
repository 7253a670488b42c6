"""Ordered computations that stay parallel when one key holds a large share of the rows.

A plain window runs each key in one task. Here a *hot* key is cut into slices of its order
column, each slice runs as its own window group, and what a slice needs from the ones before it
(a count, a sum, the last row) is carried over from a table with one row per slice. Keys are counted
once beforehand; a table without hot keys is then read by the plain window alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.session import BROADCAST_ROWS, at_most, fitted, materialize, pin

#: A key is hot above this many rows ...
HOT_ROWS = 1_000_000
#: ... and above this share of all rows, so at most ``HOT_SHARE`` keys can ever be hot.
HOT_SHARE = 65_536
#: Most time slices of a hot key. A slice holds about a quarter of ``HOT_ROWS`` or ``1 / SLICES`` of its
#: key's rows, whichever is more; rows of one time stay together.
SLICES = 1_024
#: Up to this many rows one task orders a whole table as fast as slices would.
SMALL_ROWS = 50_000


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    held = one_row.select(F.struct(*[col(c) for c in one_row.columns])).scalar()
    return df.withColumns({c: held[c] for c in one_row.columns})


def join_back(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a derived table on null-safe keys, keeping one copy of the keys."""
    if not keys:  # a one-row aggregate
        return with_scalars(df, table)
    renamed = table
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & col(k).eqNullSafe(col(f"__r_{k}"))
    return df.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and more than 1/``HOT_SHARE`` of the table, with the rows of a slice.

    The second condition bounds the result at ``HOT_SHARE`` rows whatever the input.
    """
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    share = F.greatest(F.lit(hot_rows), F.floor(total / HOT_SHARE)) / 4
    return counts.where((F.col("__n") > hot_rows) & (F.col("__n") * HOT_SHARE > total)).select(
        *[col(k) for k in keys], F.least(F.lit(SLICES), F.ceil(F.col("__n") / F.greatest(share, F.lit(1)))).alias("__cuts")
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def slice_of(us: Column, bounds: Column) -> Column:
    """How many of the sorted bounds (fewer than ``SLICES``) are at or below a time or value: by bisection."""
    halves = F.expr("array(" + ", ".join(str(SLICES >> i) for i in range(SLICES.bit_length())) + ")")
    place = F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.get(bounds, at + h - 1) <= us, at + h).otherwise(at))
    return place.cast("long")


def _time_bounds(df: DataFrame, hot: DataFrame, keys: Sequence[str], ts: str, min_seconds: int) -> DataFrame:
    """``(keys, __bounds)``: the times at which a hot key is cut, at least ``min_seconds`` apart."""
    group = [col(k) for k in keys]
    points = ", ".join(f"{i / SLICES}D" for i in range(1, SLICES))
    us = join_back(df.select(*group, micros(col(ts)).alias("__us")), hot, keys, "inner")
    sketch = F.expr(f"percentile_approx(__us, array({points}), {SLICES * 20})")
    cuts = us.groupBy(*group).agg(F.first("__cuts").alias("__cuts"), sketch.alias("__all"))
    n = F.col("__cuts")
    some = F.filter("__all", lambda _, i: F.floor((i + 1) * n / SLICES) > F.floor(i * n / SLICES))
    apart = F.aggregate(
        some,
        F.array().cast("array<bigint>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.get(kept, F.size(kept) - 1) > min_seconds * 1_000_000), F.concat(kept, F.array(x))).otherwise(kept),
    )
    return cuts.select(*group, F.coalesce(apart, F.array().cast("array<bigint>")).alias("__bounds"))


def time_slices(
    df: DataFrame, keys: Sequence[str], ts: str, hot_rows: int = HOT_ROWS, min_seconds: int = 0
) -> tuple[DataFrame, bool]:
    """Add ``__slice`` and ``__bounds``, both NULL for ordinary keys; also tell whether any key is hot.

    Slices of a hot key are numbered from 0 in order of time; rows without a time are slice -1, ahead of
    all others as in any ordering. Slices hold about equal numbers of rows and span at least ``min_seconds``.
    """
    hot = fitted(hot_keys(df, keys, hot_rows))  # <= HOT_SHARE rows
    if hot.isEmpty():
        return df.withColumns({"__slice": F.lit(None).cast("long"), "__bounds": F.lit(None).cast("array<bigint>")}), False
    # all keys together have about 4 * HOT_SHARE + SLICES cuts
    bounds = F.broadcast(fitted(_time_bounds(df, hot, keys, ts, min_seconds)))
    marked = join_back(df, bounds, keys)
    us = micros(col(ts))
    number = F.when(us.isNull(), F.lit(-1).cast("long")).otherwise(slice_of(us, F.col("__bounds")))
    return marked.withColumn("__slice", F.when(F.col("__bounds").isNotNull(), number)), True


def with_markers(df: DataFrame, markers: DataFrame) -> DataFrame:
    """Stack the rows and what their slices inherit; ``__marker`` is 0 for a marker and 1 for a row.

    Ordered by ``__marker`` first, a marker opens its slice, so one window over the stacked table sees
    it: the inherited value travels in the window's own shuffle instead of a join.
    """
    return df.withColumn("__marker", F.lit(1)).unionByName(
        markers.withColumn("__marker", F.lit(0)), allowMissingColumns=True
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    values: Sequence[str],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``__prev_<v>`` for each value: that of the row before, by time and ties, within the key."""
    sliced, hot = time_slices(df, keys, ts, hot_rows)
    group = [col(k) for k in keys]
    order = [col(ts), *[col(t) for t in ties]]
    held = F.struct(*[col(v) for v in values])
    if not hot:
        before = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({f"__prev_{v}": F.lag(col(v)).over(before) for v in values})
    last = (
        sliced.where("__slice is not null")
        .groupBy(*group, "__slice")
        .agg(F.max_by(held, F.struct(*order)).alias("__last"))
    )
    # the last row of a slice opens the key's next slice that holds rows
    following = F.lead("__slice").over(Window.partitionBy(*group).orderBy("__slice"))
    markers = last.withColumn("__slice", following).where("__slice is not null")
    stacked = with_markers(sliced.withColumn("__last", held), markers)
    inside = Window.partitionBy(*group, "__slice").orderBy("__marker", *order)
    previous = stacked.withColumn("__previous", F.lag("__last").over(inside)).where("__marker = 1")
    out = previous.withColumns({f"__prev_{v}": F.col(f"__previous.`{v}`") for v in values})
    return out.drop("__previous", "__last", "__marker", "__slice", "__bounds")


def with_position(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact 1-based place of each row within ``keys``, by time and ties."""
    sliced, hot = time_slices(df, keys, ts, hot_rows)
    group, order = [col(k) for k in keys], [col(ts), *[col(t) for t in ties]]
    if not hot:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    sizes = sliced.where("__slice is not null").groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    markers = sizes.select(*group, "__slice", F.sum("__n").over(before).alias("__step")).where("__step is not null")
    stacked = with_markers(sliced.withColumn("__step", F.lit(1).cast("long")), markers)
    inside = Window.partitionBy(*group, "__slice").orderBy("__marker", *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = stacked.withColumn(out, F.sum("__step").over(inside)).where("__marker = 1")
    return placed.drop("__step", "__marker", "__slice", "__bounds")


def value_slices(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``__slice``, the value's place among the quantiles of its group.

    Equal values share a slice and slices follow value order, so slices can be ranked apart. The cuts come from
    mergeable sketches (one pass, map-side combined): of a group's rows with a value of their own a slice holds about
    ``1 / SLICES``, however the values are spread.
    """
    group = [col(k) for k in keys]
    points = ", ".join(f"{i / SLICES}D" for i in range(1, SLICES))
    sketch = F.expr(f"percentile_approx(cast(`{value}` as double), array({points}), {SLICES * 20})").alias("__bounds")
    bounds = fitted(df.groupBy(*group).agg(sketch) if keys else df.agg(sketch), BROADCAST_ROWS // SLICES)
    placed = join_back(df, bounds, keys)
    return placed.withColumn("__slice", slice_of(col(value).cast("double"), F.col("__bounds"))).drop("__bounds")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    small_rows: int = SMALL_ROWS,
    keep_slice: bool = False,
) -> DataFrame:
    """Add ``cum_<c>``: running sums of ``sums`` by ``order`` within ``keys``; ``order`` is unique per key.

    A table of at most ``small_rows`` rows is one slice; a larger one is cut by value.
    """
    group = [col(k) for k in keys]
    key = "__at"
    # read several times below: computed once and written out
    signed = materialize(df.withColumn(key, (-col(order) if descending else col(order)).cast("double")))
    if at_most(signed, small_rows):
        sliced = signed.withColumn("__slice", F.lit(0).cast("long"))
    else:
        sliced = value_slices(signed, keys, key)
    per = sliced.groupBy(*group, "__slice").agg(*[F.sum(col(c)).alias(c) for c in sums])
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    markers = per.select(*group, "__slice", *[F.sum(col(c)).over(before).alias(c) for c in sums])  # at most SLICES per key
    stacked = with_markers(sliced, markers)
    inside = Window.partitionBy(*group, "__slice").orderBy("__marker", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = stacked.withColumns({f"cum_{c}": F.sum(col(c)).over(inside) for c in sums}).where("__marker = 1")
    return summed.drop(key, "__marker", *([] if keep_slice else ["__slice"]))


def numbered(df: DataFrame, order: Sequence[Column], out: str = "number", small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add the 0-based place of each row in a total order.

    A few rows are numbered by one window. Many are range-sorted and numbered partition by
    partition, each offset by the sizes of the partitions before it.
    """
    held, small = pin(df, small_rows)
    if small:
        return fitted(held.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")))
    placed = materialize(held.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fitted(sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn(out, (F.col("__base") + inside).cast("long")).drop("__part", "__base", "__at")
