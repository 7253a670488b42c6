"""Append, distinct, ordering and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import col


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both tables, aligned by column name; a column one table lacks is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def distinct_keep_first(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, with the place it was first seen."""
    return df.groupBy(col(value)).agg(F.min(col(position)).alias("first_position"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; missing counts as one of them."""
    return df.select(col(column)).distinct()


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order; ``n <= 0`` returns every row."""
    return df.orderBy(*[col(o) for o in order]).limit(n) if n > 0 else df


def preview(df: DataFrame, n: int | None = None) -> tuple[DataFrame, int | None]:
    """A few rows (5 unless told otherwise); ``n <= 0`` gives the whole table and its row count."""
    n = 5 if n is None else n
    return (df.limit(n), None) if n > 0 else (df, df.count())


def top_k(df: DataFrame, by: str, name: str, k: int = 50) -> DataFrame:
    """Largest ``k`` rows by a measure; ties go by name."""
    return df.orderBy(col(by).desc_nulls_last(), col(name).asc()).limit(k)


def sorted_classes(df: DataFrame, column: str) -> DataFrame:
    """Distinct classes as text, in text order."""
    return df.select(col(column).cast("string").alias("class")).distinct().orderBy("class")
