"""Grouped summaries, histograms, profiles and the aggregates behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col, is_float, is_numeric, normalize_missing, numeric_columns, require
from millrace.quantiles import exact_quantiles, wide_quantiles
from millrace.session import fitted
from millrace.skew import join_back, with_scalars


def value_list(df: DataFrame, column: str) -> list:
    """Sorted distinct non-missing values that are about to become columns.

    The names of a result's columns are known on the driver, so one row per value comes there. Where values
    are too many for a column each, take the long form of the operator (``counts_by_value``, ``confusion_counts``).
    """
    return sorted(r[0] for r in df.select(col(column)).where(col(column).isNotNull()).distinct().collect())


def counts_by_value(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form of the operators that make a column of each value: ``(keys, column, value, n)``.

    Any number of values; missing values have a row of their own with a NULL value.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in require(df, columns)])
    long = normalize_missing(df).select(*[col(k) for k in keys], F.explode(pairs).alias("__p"))
    return long.groupBy(*[col(k) for k in keys], "__p.column", "__p.value").agg(F.count(F.lit(1)).alias("n"))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of ``x`` in ``lo..hi``; the last bin is closed, a single-valued range uses the middle bin."""
    step = (hi - lo) / bins
    raw = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
    # one step back or forth where rounding put an edge value on the wrong side of its edge
    fixed = (
        F.when(x < lo + raw * step, raw - 1)
        .when((x >= lo + (raw + 1) * step) & (raw < bins - 1), raw + 1)
        .otherwise(raw)
    )
    return F.when(hi == lo, F.lit(bins // 2)).otherwise(fixed).cast("long")


def _ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    by = [col(k) for k in keys]
    aggs = [F.min(col(value)).alias("__lo"), F.max(col(value)).alias("__hi"), F.count(col(value)).alias("__n")]
    return df.groupBy(*by).agg(*aggs) if keys else df.agg(*aggs)


def group_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Share of each group's rows per bin of the group's own range: (keys, bin, n, fraction), empty bins included.

    The range table is fitted first and joined back; counting is map-side combined, so a large
    group costs no more than any other rows.
    """
    present = normalize_missing(df.select(*[col(k) for k in keys], col(value))).where(col(value).isNotNull())
    ranges = fitted(_ranges(present, keys, value))
    placed = join_back(present, ranges, keys)
    counted = placed.groupBy(
        *[col(k) for k in keys], bin_index(col(value), F.col("__lo"), F.col("__hi"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = join_back(every.select(*[col(k) for k in keys], "bin", "__n"), counted, [*keys, "bin"])
    return full.select(
        *[col(k) for k in keys],
        "bin",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("n", F.lit(0)) / F.col("__n")).alias("fraction"),
    )


def poly_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Histogram over 1, x and x² of every row."""
    x = col(value).cast("double")
    spread = df.where(col(value).isNotNull()).select(
        *[col(k) for k in keys], F.explode(F.array(F.lit(1.0), x, x * x)).alias(value)
    )
    return group_histogram(spread, keys, value, bins)


def moments(df: DataFrame, ref: str, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Kurtosis, skew (both population), min, max and mean per ref value and column, in one pass."""
    aggs = []
    for c in columns:
        x = col(c).cast("double")
        flat = F.min(x) == F.max(x)
        aggs += [
            F.when(~flat, F.kurtosis(x)).alias(f"{c}_kurtosis"),
            F.when(~flat, F.skewness(x)).alias(f"{c}_skew"),
            F.min(x).alias(f"{c}_min"),
            F.max(x).alias(f"{c}_max"),
            F.avg(x).alias(f"{c}_mean"),
        ]
    if label:
        aggs.append(F.min(col(label)).alias(label))
    return df.groupBy(col(ref)).agg(*aggs)


def summarize(
    df: DataFrame,
    ref: str,
    label: str | None = None,
    columns: Sequence[str] | None = None,
    bins: int = 10,
    approx: bool = False,
) -> DataFrame:
    """One row per ref value: for each column its bin shares, kurtosis, skew, min, max, mean and median.

    Columns default to all numeric ones but ref and label. Three scans (moments, bins, medians), each
    map-side combined; the three results have one row per ref value and meet on it.
    """
    columns = require(df, columns) if columns else numeric_columns(df, (ref, label))
    df = normalize_missing(df)
    stats = fitted(moments(df, ref, columns, label))
    medians = wide_quantiles(df, [ref], columns, {"median": 0.5}, approx=approx)

    ranged = join_back(df.select(col(ref), *[col(c) for c in columns]), stats, [ref])
    clash = {c: f"__bin_{i}" for i, c in enumerate(columns)}
    for c, b in clash.items():
        x = col(c).cast("double")
        ranged = ranged.withColumn(b, bin_index(x, col(f"{c}_min"), col(f"{c}_max"), bins))
    shares = ranged.groupBy(col(ref)).agg(
        *[
            (F.count_if(F.col(b) == i) / F.count(col(c))).alias(f"{c}_bin{i}")
            for c, b in clash.items()
            for i in range(bins)
        ]
    )
    out = join_back(join_back(stats, shares, [ref]), medians, [ref])
    kept = [
        n
        for c in columns
        for n in [f"{c}_bin{i}" for i in range(bins)]
        + [f"{c}_{s}" for s in ("kurtosis", "skew", "min", "max", "mean", "median")]
    ]
    return out.select(col(ref), *[col(n) for n in kept], *([col(label)] if label else []))


def label_conflicts(df: DataFrame, ref: str, label: str) -> DataFrame:
    """Ref values whose rows carry more than one label; empty when the labels are sound."""
    g = df.groupBy(col(ref)).agg(
        F.min(col(label)).alias("__lo"), F.max(col(label)).alias("__hi"),
        F.count(col(label)).alias("__n"), F.count(F.lit(1)).alias("__all"),
    )
    mixed = (F.col("__lo") != F.col("__hi")) | ((F.col("__n") > 0) & (F.col("__n") < F.col("__all")))
    return g.where(mixed).select(col(ref), F.col("__lo").alias("first_label"), F.col("__hi").alias("last_label"))


def profile(df: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """One row per column: max, min, mean (3 decimals), zeros, missing and, for categorical ones, cardinality.

    One aggregation over all columns, then unpivoted. Text and categorical columns have no numeric
    statistics; a missing value counts as one more distinct value.
    """
    require(df, categorical)
    none = F.lit(None)
    rows, aggs = [], []
    for i, f in enumerate(df.schema):
        c = col(f.name)
        gone = c.isNull() | F.isnan(c) if is_float(f.dataType) else c.isNull()
        numeric = is_numeric(f.dataType) and f.name not in categorical
        aggs.append(F.count_if(gone).alias(f"missing_{i}"))
        if numeric:
            x = F.when(~gone, c.cast("double"))
            aggs += [F.max(x).alias(f"max_{i}"), F.min(x).alias(f"min_{i}"), F.avg(x).alias(f"mean_{i}"),
                     F.count_if(x == 0).alias(f"zeros_{i}")]
        if f.name in categorical:
            value = F.nullif(c, F.lit(" ")) if isinstance(f.dataType, T.StringType) else c
            aggs += [F.countDistinct(value).alias(f"distinct_{i}"), F.max(value.isNull()).alias(f"any_null_{i}")]
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                *[(F.col(f"{s}_{i}") if numeric else none).cast("double").alias(s) for s in ("max", "min")],
                (F.round(F.col(f"mean_{i}"), 3) if numeric else none).cast("double").alias("mean"),
                (F.col(f"zeros_{i}") if numeric else none).cast("long").alias("zeros"),
                F.col(f"missing_{i}").cast("long").alias("missing"),
                (F.col(f"distinct_{i}") + F.col(f"any_null_{i}").cast("long") if f.name in categorical else none)
                .cast("long").alias("cardinality"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def type_features(df: DataFrame) -> DataFrame:
    """Per column: is it floating, how many distinct values (raw and standardised), are they one step apart.

    Rows with a missing value are left out. Sorted distinct values are all one apart exactly when they
    share a fractional part and span ``count - 1``, so no sort is needed; text always counts as one step.
    """
    whole = df.na.drop("any")
    aggs = []
    for i, f in enumerate(df.schema):
        c = col(f.name)
        aggs.append(F.countDistinct(c).alias(f"n_{i}"))
        if is_numeric(f.dataType):
            x = c.cast("double")
            frac = x - F.floor(x)
            aggs += [(F.max(x) - F.min(x)).alias(f"span_{i}"), (F.max(frac) - F.min(frac)).alias(f"frac_{i}")]
    rows = []
    for i, f in enumerate(df.schema):
        step = (
            (F.col(f"span_{i}") == F.col(f"n_{i}") - 1) & (F.col(f"frac_{i}") == 0)
            if is_numeric(f.dataType)
            else F.lit(True)
        )
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(int(is_float(f.dataType))).alias("is_float"),
                F.col(f"n_{i}").alias("unique_values"),
                step.cast("int").alias("one_step"),
            )
        )
    long = whole.agg(*aggs).select(F.inline(F.array(*rows)))
    spread = long.agg(F.avg("unique_values").alias("__mean"), F.stddev_pop("unique_values").alias("__std"))
    return with_scalars(long, spread).select(
        "column", "is_float", "unique_values", "one_step",
        F.when(F.col("__std") > 0, (F.col("unique_values") - F.col("__mean")) / F.col("__std"))
        .otherwise(0.0).alias("unique_scaled"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-missing value, most frequent first, ties by value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), col(column))


def literal_types(df: DataFrame, column: str) -> DataFrame:
    """How many values read as each literal kind; the first kind that fits wins."""
    return df.groupBy(literal_type(col(column)).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def literal_type(text: Column) -> Column:
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\d+$"), "integer")
        .when(F.lower(t) == "null", "null")
        .when(t.rlike(r"^\d+\.\d+$"), "double")
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.startswith("'"), "string")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(t.rlike(r"^\d{2}:\d{2}:\d{2}$"), "time")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), "timestamp")
        .otherwise("unsupported")
    )


def call_arguments(text: Column) -> Column:
    """Arguments between the outer parentheses of a call text, trimmed; an empty list without any."""
    inner = F.trim(F.regexp_extract(text, r"^[^(]*\((.*)\)[^)]*$", 1))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(inner, r",\s*"), lambda x: F.trim(x))
    )


# --- aggregates behind charts ---------------------------------------------------------------

def chart_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    return group_histogram(df, [], value, bins).drop("fraction")


def chart_box(df: DataFrame, keys: Sequence[str], value: str, approx: bool = False) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    q = exact_quantiles(df, keys, [value], [0.0, 0.25, 0.5, 0.75, 1.0], approx=approx)
    names = ("low", "q1", "median", "q3", "high")
    return q.select(*[col(k) for k in keys], *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def chart_pie(df: DataFrame, category: str) -> DataFrame:
    """Rows and share of the whole per category."""
    counts = df.groupBy(col(category)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def chart_heatmap(
    df: DataFrame, row: str, column: str, measure: Column | None = None, columns: Sequence | None = None
) -> DataFrame:
    """Row × column table of a measure (row count by default); absent cells are 0. Also feeds stacked bars."""
    measure = F.count(F.lit(1)) if measure is None else measure
    values = list(columns) if columns is not None else value_list(df, column)
    return df.groupBy(col(row)).pivot(column, values).agg(measure).na.fill(0)
