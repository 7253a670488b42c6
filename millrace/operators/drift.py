"""Has the distribution of a column moved between two tables?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import numeric_columns
from millrace.quantiles import melt
from millrace.skew import running_sums


@dataclass(frozen=True)
class DriftModel:
    """A reference table, the name of the test that compares another one with it, and the test's options."""

    reference: DataFrame
    features: tuple[str, ...]
    test: str
    options: dict

    def transform(self, df: DataFrame) -> DataFrame:
        if self.test == "KolmogorovSmirnov":
            return ks_drift(self.reference, df, self.features, **self.options)
        from millrace.operators.explain import drift_classifier

        options = dict(self.options)
        return drift_classifier(self.reference, df, options.pop("key"), list(self.features), **options)


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic (Kolmogorov's series)."""
    lam = d * F.sqrt(n * m / (n + m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_drift(reference: DataFrame, test: DataFrame, columns: Sequence[str] | None = None, p: float = 0.05) -> DataFrame:
    """Per column: the two-sample Kolmogorov-Smirnov statistic, its p-value and a corrected decision.

    Both samples are reduced to counts per distinct value before anything is ordered; the threshold
    is ``p`` divided by the number of columns.
    """
    columns = list(columns) if columns else numeric_columns(reference)
    both = melt(reference, [], columns).withColumn("a", F.lit(1)).unionByName(
        melt(test, [], columns).withColumn("a", F.lit(0))
    )
    per_value = both.groupBy("column", "value").agg(
        F.sum("a").alias("in_ref"), F.sum(1 - F.col("a")).alias("in_test")
    )
    totals = both.groupBy("column").agg(F.sum("a").alias("n_ref"), F.sum(1 - F.col("a")).alias("n_test"))
    # cumulative counts over the value order; the totals have one row per column name
    running = running_sums(per_value, ["column"], "value", ["in_ref", "in_test"])
    gap = F.abs(F.col("cum_in_ref") / F.col("n_ref") - F.col("cum_in_test") / F.col("n_test"))
    stats = running.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.max(gap).alias("statistic"), F.first("n_ref").alias("n_ref"), F.first("n_test").alias("n_test")
    )
    value = ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_test"))
    return stats.withColumn("p_value", value).withColumn(
        "drift", (F.col("p_value") < p / len(columns)).cast("int")
    )
