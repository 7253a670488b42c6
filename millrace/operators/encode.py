"""Categorical encoders. Codes follow sorted value order, so they do not depend on row order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, name_list, require
from millrace.session import fitted
from millrace.skew import SMALL_ROWS, join_back, numbered

#: Fixed value: from this many categories on, automatic coding takes the compact encoders.
HIGH_CARDINALITY = 15


def label_codes(df: DataFrame, column: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(value, code): 0-based place of each distinct non-missing value in sorted order."""
    values = df.select(col(column).alias("value")).where(col(column).isNotNull()).distinct()
    return numbered(values, [F.col("value")], "code", small_rows)


def apply_codes(df: DataFrame, column: str, codes: DataFrame, out: str | None = None, invert: bool = False) -> DataFrame:
    """Replace values by codes, or codes by values; what the table does not know becomes NULL."""
    source, target = ("code", "value") if invert else ("value", "code")
    table = codes.select(F.col(source).alias(column), F.col(target).alias("__coded"))
    joined = join_back(df, table, [column])
    return joined.withColumn(out or column, F.col("__coded")).drop("__coded")


def encode(df: DataFrame, columns: str | Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Label-encode columns; also return the (value, code) table of each."""
    maps = {c: label_codes(df, c) for c in require(df, name_list(columns))}
    for c, table in maps.items():
        df = apply_codes(df, c, table)
    return df, maps


def decode(df: DataFrame, maps: Mapping[str, DataFrame]) -> DataFrame:
    """Undo ``encode``."""
    for c, table in maps.items():
        df = apply_codes(df, c, table, invert=True)
    return df


def categories(df: DataFrame, column: str) -> tuple[list, bool]:
    """Sorted categories, about to become columns, and whether missing occurs."""
    rows = df.select(col(column)).distinct().collect()
    values = sorted(r[0] for r in rows if r[0] is not None)
    return values, len(values) < len(rows)


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` per category; missing is a category of its own, ``_nan``."""
    values, missing = categories(df, column)
    flags = [F.coalesce(col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values]
    if missing:
        flags.append(col(column).isNull().cast("int").alias(f"{column}_nan"))
    return df.select(*[col(c) for c in df.columns if c != column], *flags)


def dummy(df: DataFrame, column: str) -> DataFrame:
    """One-hot without the first sorted category; missing is all zero."""
    values, _ = categories(df, column)
    flags = [F.coalesce(col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values[1:]]
    return df.select(*[col(c) for c in df.columns if c != column], *flags)


def ordinal(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Categories to 1..k in sorted order."""
    coded = apply_codes(df, column, label_codes(df, column), out)
    name = out or column
    return coded.withColumn(name, col(name) + 1)


def base_n(df: DataFrame, column: str, base: int = 2) -> DataFrame:
    """Digits of the 1-based ordinal in a base, most significant first; missing is all zero."""
    if base < 2:
        raise ValueError("the base must be at least 2")
    codes = label_codes(df, column)
    k = codes.count()
    width = 1
    while base**width < k + 1:
        width += 1
    coded = apply_codes(df, column, codes, "__ordinal")
    number = F.coalesce(F.col("__ordinal") + 1, F.lit(0))
    digits = [
        (F.floor(number / F.lit(base ** (width - 1 - i))) % base).cast("int").alias(f"{column}_{i}") for i in range(width)
    ]
    return coded.select(*[col(c) for c in df.columns if c != column], *digits)


def binary(df: DataFrame, column: str) -> DataFrame:
    """Bits of the ordinal."""
    return base_n(df, column, 2)


def hash_bucket(value: Column, buckets: int) -> Column:
    """MD5 of the text form, modulo ``buckets``: the 128 bits are folded 32 at a time."""
    digest = F.md5(F.encode(value.cast("string"), "UTF-8"))
    acc = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        acc = (acc * F.lit(1 << 32) + part) % buckets
    return acc.cast("int")


def hash_encode(df: DataFrame, column: str, buckets: int = 8) -> DataFrame:
    """0/1 columns ``<column>_0 .. <column>_<n-1>`` by hash bucket; no fitting pass, any cardinality."""
    bucket = hash_bucket(col(column), buckets)
    flags = [F.coalesce(F.col("__bucket") == i, F.lit(False)).cast("int").alias(f"{column}_{i}") for i in range(buckets)]
    return df.withColumn("__bucket", bucket).select(*[col(c) for c in df.columns if c != column], *flags)


def target_means(df: DataFrame, column: str, target: str, min_rows: float = 1.0, smoothing: float = 1.0) -> DataFrame:
    """(value, encoding): category mean pulled to the overall mean by 1 / (1 + exp(-(n - m) / s))."""
    per = df.groupBy(col(column).alias("value")).agg(
        F.avg(col(target)).alias("mean"), F.count(col(target)).alias("n"), F.sum(col(target)).alias("sum")
    )
    held = fitted(per)
    prior = held.agg(F.sum("sum") / F.sum("n")).scalar()
    weight = 1 / (1 + F.exp(-(F.col("n") - min_rows) / smoothing))
    return held.withColumn("__prior", prior).select(
        "value", (F.col("__prior") * (1 - weight) + F.col("mean") * weight).alias("encoding")
    )


def target_encode(df: DataFrame, column: str, target: str, **options) -> DataFrame:
    """Replace categories by their smoothed target mean; a category unseen in fitting gives NULL."""
    means = target_means(df, column, target, **options).select(F.col("value").alias(column), F.col("encoding").alias("__e"))
    return join_back(df, means, [column]).withColumn(column, F.col("__e")).drop("__e").select([col(c) for c in df.columns])


def choose_coding(cardinality: Column, kind: Column) -> Column:
    """Automatic method by cardinality and kind ('Nominal' or 'Ordinal')."""
    low = cardinality < HIGH_CARDINALITY
    return (
        F.when(low & (kind == "Nominal"), "OneHot")
        .when(kind == "Nominal", "Hash")
        .when(low & (kind == "Ordinal"), "Ordinal")
        .when(kind == "Ordinal", "Binary")
    )


def auto_encode_plan(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(column, category, cardinality, coding) from one aggregation; missing counts as a value."""
    require(df, kinds)
    counts = df.agg(
        *[
            (F.countDistinct(col(c)) + F.max(col(c).isNull().cast("int"))).cast("long").alias(f"n{i}")
            for i, c in enumerate(kinds)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(kind).alias("category"), F.col(f"n{i}").alias("cardinality"))
            for i, (c, kind) in enumerate(kinds.items())
        ]
    )
    return counts.select(F.inline(rows)).withColumn("coding", choose_coding(F.col("cardinality"), F.col("category")))


def auto_encode(df: DataFrame, kinds: Mapping[str, str], hash_buckets: int = 8) -> DataFrame:
    """Encode each column by the method its cardinality and kind call for."""
    steps = {
        "OneHot": one_hot,
        "Hash": lambda d, c: hash_encode(d, c, hash_buckets),
        "Ordinal": ordinal,
        "Binary": binary,
    }
    for row in auto_encode_plan(df, kinds).collect():  # one row per column name given
        df = steps[row["coding"]](df, row["column"])
    return df
