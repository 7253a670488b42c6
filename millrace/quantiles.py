"""Exact quantiles whose cost does not fall on one task, even for one large group.

A sketch brackets each wanted rank between two values. One more pass counts everything outside the
brackets and keeps distinct values, with counts, only inside them; those few are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.session import at_most, fitted
from millrace.skew import SMALL_ROWS, join_back

#: Rank error of the sketch is at most 1/ACCURACY of the group; a bracket is four times that wide.
ACCURACY = 10_000


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, value) rows; missing values are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*[col(k) for k in keys], F.explode(pairs).alias("__p"))
    return long.select(*[col(k) for k in keys], "__p.column", "__p.value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
    *,
    small_rows: int = SMALL_ROWS,
    accuracy: int = ACCURACY,
    approx: bool = False,
) -> DataFrame:
    """One row per (keys, column) with ``q``, the linearly interpolated quantiles in the order asked.

    Tables of at most ``small_rows`` rows use the built-in ``percentile``, which holds a group's
    values in one task. ``approx=True`` answers from one sketch pass instead.
    """
    long = melt(df, keys, columns)
    group = [*keys, "column"]
    by = [col(g) for g in group]
    probs = [float(p) for p in probabilities]
    wanted = F.array(*[F.lit(p) for p in probs])
    if approx:
        return long.groupBy(*by).agg(F.percentile_approx("value", wanted, F.lit(accuracy)).alias("q"))
    if at_most(df, small_rows):
        return long.groupBy(*by).agg(F.percentile("value", wanted).alias("q"))

    # brackets [lo, hi] per probability, in rising order; NULL means open-ended
    margin = 2.0 / accuracy
    rising = sorted(set(probs))
    ends = [x for p in rising for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = F.percentile_approx("value", F.array(*[F.lit(x) for x in ends]), F.lit(accuracy))
    sketched = long.groupBy(*by).agg(sketch.alias("b"))
    sides = [F.get("b", F.lit(j)).alias(f"__{'lh'[j % 2]}{j // 2}") for j in range(len(ends))]
    placed = join_back(long, fitted(sketched.select(*by, *sides)), group)

    x = F.col("value")
    inside, past = F.lit(None).cast("int"), F.lit(-1)
    for i in reversed(range(len(rising))):
        above = F.lit(True) if ends[2 * i] == 0.0 else x >= F.col(f"__l{i}")
        below = F.lit(True) if ends[2 * i + 1] == 1.0 else x <= F.col(f"__h{i}")
        inside = F.when(above & below, F.lit(i)).otherwise(inside)
    for i in range(len(rising)):
        past = F.when(x > F.col(f"__h{i}"), F.lit(i)).otherwise(past)
    cells = placed.select(*by, "value", inside.alias("__in"), past.alias("__past")).select(
        *by,
        F.coalesce("__in", "__past").alias("__bracket"),
        F.col("__in").isNull().alias("__outside"),
        F.when(F.col("__in").isNotNull(), x).alias("value"),
    )
    counts = cells.groupBy(*by, "__bracket", "__outside", "value").agg(F.count(F.lit(1)).alias("__n"))

    sizes = counts.groupBy(*by, "__bracket", "__outside").agg(F.sum("__n").alias("__m"))
    in_order = Window.partitionBy(*by).orderBy("__bracket", "__outside")
    runs = sizes.select(
        *by, "__bracket", "__outside",
        (F.sum("__m").over(in_order) - F.col("__m")).alias("__base"),
        F.sum("__m").over(Window.partitionBy(*by)).alias("__total"),
    )  # a few rows per group
    ranked = join_back(counts.where("not __outside"), runs, [*group, "__bracket", "__outside"])
    w = Window.partitionBy(*by, "__bracket").orderBy("value")
    spans = ranked.withColumn("__to", F.col("__base") + F.sum("__n").over(w)).withColumn("__from", F.col("__to") - F.col("__n"))

    def at(p: float):
        return F.lit(p) * (F.col("__total") - 1)

    def pick(rank):
        return F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__to")), F.col("value")))

    picked = fitted(spans.groupBy(*by).agg(
        F.max("__total").alias("__total"),
        *[f(F.floor(at(p)) if k == "lo" else F.ceil(at(p))).alias(f"__{k}{i}") for i, p in enumerate(probs) for k, f in (("lo", pick), ("hi", pick))],
    ))
    lost = F.lit(False)
    for i in range(len(probs)):
        lost = lost | F.col(f"__lo{i}").isNull() | F.col(f"__hi{i}").isNull()
    if not picked.where(lost).isEmpty():  # a rank fell outside its bracket: take wider ones
        return exact_quantiles(df, keys, columns, probs, small_rows=small_rows, accuracy=max(2, accuracy // 8))
    values = [
        F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at(p) - F.floor(at(p))) for i, p in enumerate(probs)
    ]
    return picked.select(*by, F.array(*values).alias("q"))


def wide_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], names: dict[str, float], **options
) -> DataFrame:
    """One row per keys with a column ``<column>_<name>`` for each named probability."""
    long = exact_quantiles(df, keys, columns, list(names.values()), **options)
    aggs = [
        F.max(F.when(F.col("column") == c, F.col("q")[i])).alias(f"{c}_{n}")
        for c in columns
        for i, n in enumerate(names)
    ]
    return long.groupBy(*[col(k) for k in keys]).agg(*aggs) if keys else long.agg(*aggs)
