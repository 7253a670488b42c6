"""SQL text over named tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL text with the given tables in scope; views of these names are as before afterwards."""
    if not text.strip():
        raise ValueError("the SQL text is empty")
    held = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in views if name.lower() in held}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
