"""Scores of predictions against labels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.skew import join_back, running_sums, with_scalars


#: Cluster sizes that stand in one row while sizes of the two sides meet.
SIZES_PER_PIECE = 1_000


def confusion_counts(df: DataFrame, label: str, prediction: str = "predictions") -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str = "predictions", classes: Sequence | None = None) -> DataFrame:
    """Square table: a row per true class, a column ``pred_<class>`` per class, zeros filled."""
    counts = confusion_counts(df, label, prediction)
    names = counts.select("label").union(counts.select("prediction")).where("label is not null").distinct()
    if classes is None:
        classes = sorted(r[0] for r in names.collect())  # a column each; confusion_counts is the long form
    wide = counts.groupBy("label").agg(
        *[F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in classes]
    )
    return names.join(wide, "label", "left").na.fill(0, [f"pred_{c}" for c in classes])


def classification_scores(df: DataFrame, label: str, prediction: str = "predictions") -> DataFrame:
    """Accuracy and micro precision, which are one number for single-label data."""
    hit = F.coalesce(col(label) == col(prediction), F.lit(False)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.avg(hit).alias("micro_precision"), F.count(F.lit(1)).alias("n"))


def regression_scores(df: DataFrame, label: str, prediction: str = "predictions") -> DataFrame:
    """MSE, MAE and R² in one pass; R² is NULL for constant labels."""
    e = col(label) - col(prediction)
    spread = F.count(e) * F.var_pop(col(label).cast("double"))
    return df.agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"),
    )


# --- clustering -----------------------------------------------------------------------------

def _entropy(sizes: Column, total: Column) -> Column:
    return -F.sum(sizes / total * F.log(sizes / total))


def clustering_scores(df: DataFrame, label: str, prediction: str = "predictions") -> DataFrame:
    """Mutual information (nats), homogeneity, completeness and V-measure from the contingency counts."""
    cells = confusion_counts(df, label, prediction).withColumnRenamed("n", "nij")
    rows = cells.groupBy("label").agg(F.sum("nij").alias("a"))
    cols = cells.groupBy("prediction").agg(F.sum("nij").alias("b"))
    total = rows.agg(F.sum("a")).scalar()
    joint = join_back(join_back(cells, rows, ["label"]), cols, ["prediction"])
    n = F.col("__n")
    mi = joint.withColumn("__n", total).agg(
        F.sum(F.col("nij") / n * F.log(F.col("nij") * n / (F.col("a") * F.col("b").cast("double")))).alias("mi")
    )
    h_label = rows.withColumn("__n", total).agg(_entropy(F.col("a"), n).alias("h_label"))
    h_pred = cols.withColumn("__n", total).agg(_entropy(F.col("b"), n).alias("h_pred"))
    one = with_scalars(with_scalars(mi, h_label), h_pred)
    info = F.greatest(F.col("mi"), F.lit(0.0))
    hom = F.when(F.col("h_label") > 0, info / F.col("h_label")).otherwise(1.0)
    com = F.when(F.col("h_pred") > 0, info / F.col("h_pred")).otherwise(1.0)
    return one.select(
        info.alias("mutual_info"), hom.alias("homogeneity"), com.alias("completeness"),
        F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0).alias("v_measure"),
        "h_label", "h_pred",
    )


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!) for whole numbers: exact sums for small ones, Stirling's series beyond."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))
    z = np.maximum(x, 1.0)
    series = z * np.log(z) - z + 0.5 * np.log(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(x < 256, small[np.minimum(x, 255).astype(int)], series)


def _expected_information(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expected information of one pair of margins under random labelling (hypergeometric).

    The sum covers 40 standard deviations either side of the mean; what lies beyond is below the
    smallest double.
    """
    for pdf in batches:
        out = np.zeros(len(pdf))
        for k, (a, b, n) in enumerate(zip(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float), pdf["n"].to_numpy(float))):
            mean = a * b / n
            sd = math.sqrt(max(mean * (1 - a / n) * (n - b) / max(n - 1, 1), 1.0))
            lo = max(1.0, a + b - n, math.floor(mean - 40 * sd))
            hi = min(a, b, math.ceil(mean + 40 * sd))
            fixed = (_log_factorial(np.array([a, b, n - a, n - b])).sum() - _log_factorial(np.array([n]))[0])
            for start in np.arange(lo, hi + 1, 1_000_000):
                x = np.arange(start, min(start + 1_000_000, hi + 1))
                logp = fixed - (_log_factorial(x) + _log_factorial(a - x) + _log_factorial(b - x) + _log_factorial(n - a - b + x))
                out[k] += float(np.sum(x / n * (np.log(x * n) - math.log(a) - math.log(b)) * np.exp(logp)))
        yield pd.DataFrame({"emi": out * pdf["times"].to_numpy(float)})


def adjusted_mutual_info(df: DataFrame, label: str, prediction: str = "predictions") -> DataFrame:
    """Mutual information corrected for chance, arithmetic-mean normaliser.

    Chance depends only on the class sizes; equal sizes are counted once. The formula has a term for each two
    sizes; of N rows there are at most sqrt(2 N) sizes on a side, met in pieces by shuffle.
    """
    cells = confusion_counts(df, label, prediction)
    a = cells.groupBy("label").agg(F.sum("n").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("ta"))
    b = cells.groupBy("prediction").agg(F.sum("n").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("tb"))
    pieces = max(1, b.count() // SIZES_PER_PIECE)
    others = b.groupBy(F.pmod(F.hash("b"), F.lit(pieces)).alias("piece")).agg(F.collect_list(F.struct("b", "tb")).alias("os"))
    pairs = (
        a.withColumn("n", cells.agg(F.sum("n")).scalar())
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        .join(others, "piece")
        .withColumn("o", F.explode("os"))
        .select("a", "o.b", "n", (F.col("ta") * F.col("o.tb")).alias("times"))
    )
    emi = pairs.repartition(F.hash("a", "b")).mapInPandas(_expected_information, "emi double").agg(F.sum("emi").alias("emi"))
    one = with_scalars(clustering_scores(df, label, prediction), emi)
    mean_h = (F.col("h_label") + F.col("h_pred")) / 2
    return one.select(
        F.when((F.col("h_label") == 0) & (F.col("h_pred") == 0), 1.0)
        .when(mean_h - F.col("emi") == 0, 0.0)
        .otherwise((F.col("mutual_info") - F.col("emi")) / (mean_h - F.col("emi")))
        .alias("adjusted_mutual_info")
    )


# --- ranking --------------------------------------------------------------------------------

def _by_score(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys], col(score).alias("score")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg")
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the origin (threshold NULL), for 0/1 labels."""
    steps = running_sums(_by_score(df, [], score, col(label) == 1), [], "score", ["pos", "neg"], descending=True)
    totals = df.agg(F.count_if(col(label) == 1).alias("__p"), F.count_if(col(label) != 1).alias("__q"))
    points = with_scalars(steps, totals).select(
        F.col("score").cast("double").alias("threshold"),
        (F.col("cum_neg") / F.col("__q")).alias("fpr"),
        (F.col("cum_pos") / F.col("__p")).alias("tpr"),
    )
    origin = totals.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.union(points)


def average_precision(
    df: DataFrame, keys: Sequence[str], score: str, correct: str, truths: DataFrame | None = None
) -> DataFrame:
    """Area under the precision envelope per group; equal scores form one step.

    ``truths`` holds (keys, n_truths); without it the correct rows are taken as all there is to find.
    """
    by = [col(k) for k in keys]
    steps = running_sums(
        _by_score(df, keys, score, col(correct) == 1), keys, "score", ["pos", "neg"], descending=True, keep_slice=True
    )
    steps = steps.withColumn("precision", F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    # envelope: the best precision at this step or any later one, slice by slice
    tops = steps.groupBy(*by, "__slice").agg(F.max("precision").alias("__top"))
    later = Window.partitionBy(*by).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.withColumn("__later", F.max("__top").over(later)).drop("__top")
    inside = Window.partitionBy(*by, "__slice").orderBy(F.col("score").asc())  # from the last step upward
    env = join_back(steps, carry, [*keys, "__slice"]).withColumn(
        "__env", F.greatest(F.max("precision").over(inside), F.col("__later"))
    )
    sums = env.groupBy(*by).agg(F.sum(F.col("pos") * F.col("__env")).alias("__area"), F.sum("pos").alias("__found"))
    if truths is None:
        return sums.select(*by, F.when(F.col("__found") > 0, F.col("__area") / F.col("__found")).otherwise(0.0).alias("ap"))
    return join_back(sums, truths, keys).select(*by, (F.col("__area") / F.col("n_truths")).alias("ap"))
