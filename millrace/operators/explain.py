"""Permutation importance, partial dependence and the classifier drift test."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import col, numeric_columns, require
from millrace.operators.scale import fit_scaler
from millrace.quantiles import exact_quantiles
from millrace.skew import join_back

#: Rows of a slice of the hashed order, about.
SLICE_ROWS = 100_000


def shuffled(df: DataFrame, key: str, features: Sequence[str], seed: int, rows: int | None = None) -> DataFrame:
    """Add ``__perm_<f>``: the feature's value of another row, a permutation of the column.

    All rows stand in one order, by a hash of the key, and each takes the values of its successor, the last those of
    the first. The order is cut evenly into slices by the hash; the last row of a slice takes those of the first
    row of the next one, from a table with a row for each slice. One shuffle serves all features.
    """
    n = rows if rows is not None else df.count()
    bits = max(0, math.ceil(math.log2(max(1, n / SLICE_ROWS))))
    order = F.struct(F.xxhash64(col(key), F.lit(seed)).alias("h"), col(key).alias("k"))
    number = F.shiftrightunsigned("__order.h", 64 - bits) if bits else F.lit(0).cast("long")
    take = F.struct(*[col(f) for f in features])
    placed = df.withColumn("__order", order).withColumn("__slice", number)
    first = placed.groupBy("__slice").agg(F.min_by(take, "__order").alias("__first"))
    first = first.withColumn("__slice", F.pmod(F.col("__slice") - 1, F.lit(1 << bits)))
    w = Window.partitionBy("__slice").orderBy("__order")
    out = join_back(placed.withColumn("__next", F.lead(take).over(w)), first, ["__slice"])
    out = out.withColumn("__next", F.coalesce("__next", "__first", take))
    return out.withColumns({f"__perm_{f}": F.col(f"__next.`{f}`") for f in features}).drop("__order", "__slice", "__next", "__first")


def permutation_importance(
    model, df: DataFrame, label: str, key: str, features: Sequence[str], repeats: int = 5, seed: int = 1,
) -> DataFrame:
    """(feature, weight, std): mean loss of accuracy over ``repeats`` when one column is shuffled."""
    n = df.count()
    base = df.select(col(key), col(label), *[col(f) for f in features])

    def hit(scored: DataFrame) -> Column:
        return F.coalesce(F.col("predictions") == col(label).cast("string"), F.lit(False)).cast("double")

    plain = model.transform(base)
    reference = plain.agg(F.avg(hit(plain))).first()[0]
    runs = None
    for r in range(repeats):
        mixed = shuffled(base, key, features, seed + r, n)
        variants = F.array(
            *[
                F.struct(F.lit(f).alias("feature"), *[(col(f"__perm_{g}") if g == f else col(g)).alias(g) for g in features])
                for f in features
            ]
        )
        wide = mixed.select(col(label), F.explode(variants).alias("v")).select(col(label), "v.*")
        scored = model.transform(wide)
        per = scored.groupBy("feature").agg((F.lit(reference) - F.avg(hit(scored))).alias("drop"))
        runs = per if runs is None else runs.unionByName(per)
    return runs.groupBy("feature").agg(F.avg("drop").alias("weight"), F.stddev_pop("drop").alias("std"))


def _grid_points(df: DataFrame, feature: str, points: int) -> list[float]:
    probs = [i / (points - 1) for i in range(points)]
    values = exact_quantiles(df, [], [feature], probs).first()["q"]
    return sorted(set(values))


def partial_dependence(
    predict: Callable[[DataFrame], DataFrame], df: DataFrame, feature: str, points: int = 10, output: str = "predictions"
) -> DataFrame:
    """(value, average): mean output when the feature is set to each of up to ``points`` percentiles.

    Every row is scored at every grid point; averaging is map-side combined.
    """
    values = _grid_points(df, feature, points)
    spread = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(v) for v in values])))
    return predict(spread).groupBy(col(feature).alias("value")).agg(F.avg(output).alias("average"))


def partial_dependence_2d(
    predict: Callable[[DataFrame], DataFrame], df: DataFrame, features: tuple[str, str], points: int = 10,
    output: str = "predictions",
) -> DataFrame:
    """The same over the grid of two features."""
    a, b = require(df, features)
    spread = df.drop(a, b)
    for f in (a, b):
        spread = spread.withColumn(f, F.explode(F.array(*[F.lit(v) for v in _grid_points(df, f, points)])))
    return predict(spread).groupBy(col(a), col(b)).agg(F.avg(output).alias("average"))


def drift_classifier(
    reference: DataFrame, test: DataFrame, key: str, columns: Sequence[str] | None = None, seed: int = 0
) -> DataFrame:
    """(feature, coefficient, auc): can a classifier tell the tables apart, and by which column?

    Half of each table trains, the other half is judged; an AUC near 0.5 means no drift.
    """
    columns = list(columns) if columns else numeric_columns(reference, (key,))
    both = reference.select(col(key), *[col(c) for c in columns], F.lit(0.0).alias("__origin")).unionByName(
        test.select(col(key), *[col(c) for c in columns], F.lit(1.0).alias("__origin"))
    )
    scaled = fit_scaler(both, columns, "standard").apply(both)
    half = F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(2)) == 0
    data = VectorAssembler(inputCols=list(columns), outputCol="__f").transform(scaled)
    model = LogisticRegression(featuresCol="__f", labelCol="__origin", regParam=1e-6).fit(data.where(half))
    judged = model.transform(data.where(~half))
    auc = BinaryClassificationEvaluator(labelCol="__origin", rawPredictionCol="rawPrediction").evaluate(judged)
    rows = [(c, float(w), float(auc)) for c, w in zip(columns, model.coefficients.toArray())]
    return reference.sparkSession.createDataFrame(rows, "feature string, coefficient double, auc double")


