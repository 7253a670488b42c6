"""Managed tables, inline rows, and sparse wide-column cells as a long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.columns import col


def create_and_load(
    spark: SparkSession, table: str, schema: str, csv: str, skip_header: bool = True, location: str | None = None
) -> DataFrame:
    """Create a table of a stated schema if need be, replace its content by a CSV file, return it."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet{place}")
    rows = spark.read.option("header", skip_header).schema(schema).csv(csv)
    rows.write.insertInto(table, overwrite=True)
    return spark.table(table)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short list of rows as a table; duplicates are kept."""
    return spark.createDataFrame(list(rows), schema)


# --- cells (rowkey, family, qualifier, value, version) --------------------------------------

def put(cells: DataFrame, more: DataFrame) -> DataFrame:
    """Add cells; a later version of the same cell hides the earlier ones."""
    return cells.unionByName(more)


def latest_cells(cells: DataFrame) -> DataFrame:
    """Current value per cell, map-side combined."""
    return cells.groupBy("rowkey", "family", "qualifier").agg(F.max_by("value", "version").alias("value"))


def get(cells: DataFrame, rowkey: str, family: str | None = None, qualifier: str | None = None) -> DataFrame:
    """Current cells of one row; the filter goes to the scan."""
    out = cells.where(F.col("rowkey") == rowkey)
    if family is not None:
        out = out.where(F.col("family") == family)
    if qualifier is not None:
        out = out.where(F.col("qualifier") == qualifier)
    return latest_cells(out)


def cells_pivot(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per row key, a column ``family:qualifier`` per cell name, NULL where a row lacks the cell."""
    name = F.concat_ws(":", "family", "qualifier")
    if names is None:
        names = sorted(r["n"] for r in cells.select(name.alias("n")).distinct().collect())  # a column each
    named = cells.withColumn("__name", name)
    # one aggregation picks versions and pivots at once
    return named.groupBy("rowkey").agg(
        *[
            F.max_by(F.when(col("__name") == n, F.col("value")), F.when(col("__name") == n, F.col("version"))).alias(n)
            for n in names
        ]
    )
