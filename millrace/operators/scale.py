"""Column scalers: fitted on one table, applied to any."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.columns import col, require
from millrace.quantiles import exact_quantiles


@dataclass(frozen=True)
class Scaler:
    """Fitted centre and width per column."""

    method: str
    center: dict[str, float]
    width: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        """(x - centre) / width in every fitted column."""
        require(df, self.center)
        return df.withColumns(
            {c: (col(c) - F.lit(self.center[c])) / F.lit(self.width[c]) for c in self.center}
        )

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.method, self.center[c], self.width[c]) for c in self.center]
        return spark.createDataFrame(rows, "column string, method string, center double, width double")


def _widths(raw: dict[str, float | None]) -> dict[str, float]:
    return {c: float(w) if w else 1.0 for c, w in raw.items()}


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "robust", approx: bool = False) -> Scaler:
    """Fit ``standard`` (mean, population deviation), ``robust`` (median, interquartile range) or ``minmax``.

    A column without spread is divided by 1. One small row per fit reaches the driver.
    """
    columns = require(df, columns)
    if method == "robust":
        rows = {r["column"]: r["q"] for r in exact_quantiles(df, [], columns, [0.25, 0.5, 0.75], approx=approx).collect()}
        center = {c: float(rows[c][1]) for c in columns}
        return Scaler(method, center, _widths({c: rows[c][2] - rows[c][0] for c in columns}))
    if method == "standard":
        pair = [(F.avg, F.stddev_pop)]
    elif method == "minmax":
        pair = [(F.min, lambda x: F.max(x) - F.min(x))]
    else:
        raise ValueError(f"unknown scaler {method}")
    mid, spread = pair[0]
    aggs = [f(col(c)).cast("double").alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("c", mid), ("w", spread))]
    row = df.agg(*aggs).first()
    return Scaler(
        method,
        {c: row[f"c{i}"] for i, c in enumerate(columns)},
        _widths({c: row[f"w{i}"] for i, c in enumerate(columns)}),
    )


def scale(df: DataFrame, columns: Sequence[str], method: str = "robust", approx: bool = False) -> DataFrame:
    return fit_scaler(df, columns, method, approx).apply(df)


def normalize_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide the columns of a row by their Euclidean length; a zero row stays."""
    columns = require(df, columns)
    length = sum((col(c).cast("double") * col(c) for c in columns), F.lit(0.0))
    norm = F.when(length > 0, F.sqrt(length)).otherwise(1.0)
    return df.withColumn("__norm", norm).withColumns({c: col(c) / F.col("__norm") for c in columns}).drop("__norm")
