"""Portfolio risk over a profit-and-loss table, and bond values over a scenario grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.operators.summary import group_histogram
from millrace.quantiles import exact_quantiles
from millrace.session import fitted
from millrace.skew import join_back


def var_es(df: DataFrame, keys: Sequence[str], pnl: str, confidence: float = 0.99) -> DataFrame:
    """Value at risk (the 1 - confidence quantile) and expected shortfall (mean of what lies at or below it)."""
    by = [col(k) for k in keys]
    q = exact_quantiles(df, keys, [pnl], [1 - confidence]).select(*by, F.col("q")[0].alias("var"))
    limits = fitted(q)
    tail = join_back(df.select(*by, col(pnl)), limits, keys).where(col(pnl) <= F.col("var"))
    es = [F.avg(col(pnl)).alias("es"), F.first("var").alias("var")]
    return tail.groupBy(*by).agg(*es) if keys else tail.agg(*es)


def var_incremental(df: DataFrame, scenario: str, asset: str, pnl: str, confidence: float = 0.99) -> DataFrame:
    """Per asset: portfolio value at risk with it, without it, and the difference."""
    each = df.groupBy(col(scenario).alias("scenario"), col(asset).alias("asset")).agg(F.sum(col(pnl)).alias("own")).where("asset is not null")
    totals = df.groupBy(col(scenario).alias("scenario")).agg(F.sum(col(pnl)).alias("total"), F.collect_set(col(asset)).alias("held"))
    own = join_back(each, totals.drop("held"), ["scenario"]).select("total", "asset", (F.col("total") - F.coalesce("own", F.lit(0.0))).alias("rest"))
    # assets that a scenario says nothing of
    every = each.agg(F.collect_set("asset")).scalar()
    other = totals.select("total", F.explode(F.array_except(every, F.col("held"))).alias("asset"), F.col("total").alias("rest"))
    rest = own.unionByName(other)
    q = exact_quantiles(rest, ["asset"], ["total", "rest"], [1 - confidence])
    return q.groupBy("asset").agg(
        F.max(F.when(F.col("column") == "total", F.col("q")[0])).alias("var_all"),
        F.max(F.when(F.col("column") == "rest", F.col("q")[0])).alias("var_without"),
    ).withColumn("var_incremental", F.col("var_all") - F.col("var_without"))


def pnl_histogram(df: DataFrame, pnl: str, bins: int = 50) -> DataFrame:
    return group_histogram(df, [], pnl, bins)


def bond_value(face: Column, coupon: Column, redemption: Column, at: Column, maturity: Column, rate: Column) -> Column:
    """Present value of annual coupons and the redemption at a flat yearly yield, as of ``at``.

    Coupon dates count back from maturity in whole years; those on or before ``at`` are past.
    """
    years = F.greatest(F.months_between(maturity, at) / 12.0, F.lit(0.0))
    payments = F.ceil(years).cast("int")
    coupons = F.aggregate(
        F.when(payments > 0, F.sequence(F.lit(0), payments - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, k: acc + face * coupon / F.pow(1 + rate, years - k),
    )
    return F.when(years > 0, coupons + redemption / F.pow(1 + rate, years)).otherwise(0.0)


def cube_stats(grid: DataFrame, value: str) -> DataFrame:
    """Portfolio value, mean and spread per evaluation date and shock."""
    return grid.groupBy("eval_date", "shock").agg(
        F.sum(col(value)).alias("total"), F.avg(col(value)).alias("mean"), F.stddev_pop(col(value)).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )
