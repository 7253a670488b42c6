"""Column selection, cleaning and small row-wise operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col, is_numeric, name_list, normalize_missing, require

#: The marks written beside right and wrong predictions.
MARK_RIGHT, MARK_WRONG = "✅", "❌"


def filter_columns(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Keep the named columns in the order asked; unknown names are ignored."""
    return df.select([col(n) for n in name_list(names) if n in df.columns])


def drop_columns(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Drop the named columns; an unknown name is an error."""
    return df.drop(*require(df, name_list(names)))


def rename_columns(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Rename all columns by position."""
    names = name_list(names)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names given for {len(df.columns)} columns")
    return df.toDF(*names)


def rename_one(df: DataFrame, position: int, name: str) -> DataFrame:
    """Rename the column at a 0-based position."""
    names = df.columns
    names[position] = name
    return df.toDF(*names)


def drop_nans(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value; NaN and the infinities count as missing."""
    return normalize_missing(df, infinite=True).na.drop("any")


def fill_nans(df: DataFrame, values: Mapping[str, object] | None = None) -> DataFrame:
    """Fill missing values from ``{column: value}``, or every column with 0 when none is given."""
    clean = normalize_missing(df, infinite=True)
    if values:
        require(df, values)
        return clean.na.fill(dict(values))

    def zero(field: T.StructField) -> Column:
        kind = field.dataType
        if is_numeric(kind) or isinstance(kind, T.StringType):
            return F.coalesce(col(field.name), F.lit(0).cast(kind)).alias(field.name)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(col(field.name), F.lit(False)).alias(field.name)
        return col(field.name)

    return clean.select([zero(f) for f in clean.schema])


def blank_to_null(df: DataFrame) -> DataFrame:
    """A string that is exactly one space becomes missing."""
    return df.select(
        [
            F.when(col(f.name) != " ", col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema
        ]
    )


def with_label(df: DataFrame, label: Column, name: str = "LABEL") -> DataFrame:
    """Append the label as the last column."""
    return df.drop(name).withColumn(name, label)


def mark_correct(df: DataFrame, label: str, prediction: str = "predictions") -> DataFrame:
    """Add ``results``: a tick where the prediction equals the label, else a cross."""
    hit = col(label) == col(prediction)
    return df.withColumn("results", F.when(hit, MARK_RIGHT).otherwise(MARK_WRONG))


def signed_error(df: DataFrame, label: str, prediction: str = "predictions", magnitude: bool = False) -> DataFrame:
    """Add ``absolute_error`` = label - prediction (signed); ``magnitude`` also adds ``abs_error``."""
    out = df.withColumn("absolute_error", col(label) - col(prediction))
    return out.withColumn("abs_error", F.abs("absolute_error")) if magnitude else out


def remap_anomaly(df: DataFrame, prediction: str = "predictions") -> DataFrame:
    """Detector output to flags: -1 (outlier) -> 1 and 1 (inlier) -> 0; other values stay."""
    p = col(prediction)
    return df.withColumn(prediction, F.when(p == -1, F.lit(1)).when(p == 1, F.lit(0)).otherwise(p))


def score_threshold(df: DataFrame, score: str, threshold: float = 0.6) -> DataFrame:
    """Keep rows whose score reaches the threshold; NaN scores are dropped."""
    return df.where((col(score) >= threshold) & ~F.isnan(col(score)))


def round_for_display(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round floating columns half to even."""
    return df.select(
        [
            F.bround(col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else col(f.name)
            for f in df.schema
        ]
    )


def target_class_hits(
    df: DataFrame, target: str | float, prediction: str = "predictions", regression: bool = False
) -> DataFrame:
    """Add ``hit``: 1 where the sample is predicted as the target class.

    Regression compares whole parts, cut toward zero; a prediction that is missing or no such number is no hit.
    Classes compare as text.
    """
    if regression:
        same = col(prediction).try_cast("double").try_cast("long") == F.lit(int(float(target)))
    else:
        same = col(prediction).cast("string") == F.lit(str(target))
    return df.withColumn("hit", F.coalesce(same, F.lit(False)).cast("int"))


def when_enabled(df: DataFrame, step, enabled: bool = True, **options) -> DataFrame:
    """Apply ``step`` unless it is switched off; switched off, the table passes unchanged."""
    return step(df, **options) if enabled else df
