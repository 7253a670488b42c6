"""Boosting of symmetric trees over ordered target statistics of categories.

A row's category is coded by the targets of the rows *before* it in a hashed order, so no row sees its own target.
The order is cut into slices by the hash, which cuts every category evenly: sums inside a slice run in one window per
category and slice, and what the slices before hold is added from a table with a row for each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col
from millrace.operators.gradient import GradientTrees, boosting_options, encoded, fit_trees
from millrace.session import materialize, pin
from millrace.skew import join_back

#: Hexadecimal digits of the hash that name a slice: 256 slices.
DIGITS = 2


def hashed_order(key: Sequence[str], seed: int = 0) -> Column:
    """The MD5 digest, in hexadecimal, of the seed and the key columns, parted by ``|``; a missing value is empty."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key]))


def ordered_codes(
    df: DataFrame, key: Sequence[str], column: str, target: Column, out: str, prior: float | None = None, weight: float = 1.0, seed: int = 0
) -> DataFrame:
    """Add ``out``: ``(sum of targets before + weight * prior) / (rows before + weight)`` over the rows of the same category.

    *Before* is by ``hashed_order``; ``prior`` is the mean target unless given. A missing category is a category of its own, a
    missing target counts as no row. Rows with equal keys follow their target.
    """
    if prior is None:
        prior = df.agg(F.avg(target)).first()[0] or 0.0
    rows = df.withColumns({"__y": target.cast("double"), "__h": hashed_order(key, seed)}).withColumn("__slice", F.substring("__h", 1, DIGITS))
    group = [col(column), F.col("__slice")]
    sums = rows.groupBy(*group).agg(F.sum("__y").alias("__s"), F.count("__y").alias("__n"))
    before = Window.partitionBy(col(column)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    carried = sums.select(*group, F.sum("__s").over(before).alias("__s0"), F.sum("__n").over(before).alias("__n0"))
    inside = Window.partitionBy(*group).orderBy("__h", "__y").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({"__s1": F.sum("__y").over(inside), "__n1": F.count("__y").over(inside)})
    placed = join_back(summed, carried, [column, "__slice"])
    total = F.coalesce("__s0", F.lit(0.0)) + F.coalesce("__s1", F.lit(0.0))
    n = F.coalesce("__n0", F.lit(0)) + F.col("__n1")
    code = (total + F.lit(weight * prior)) / (n + F.lit(weight))
    return placed.withColumn(out, code).drop("__y", "__h", "__slice", "__s0", "__n0", "__s1", "__n1")


@dataclass(frozen=True)
class CodedTrees:
    """Trees over numbers and coded categories. ``statistics`` holds, per category column, a table of the sums
    of all training rows, by which new rows are coded: ``(category, s0, …, n)``. An unknown category has the prior."""

    trees: GradientTrees
    columns: tuple[str, ...]
    statistics: tuple[DataFrame, ...]
    priors: tuple[float, ...]
    weight: float

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (column, table) in enumerate(zip(self.columns, self.statistics)):
            renamed = table.withColumnRenamed("category", "__c")
            held, _ = pin(renamed)
            out = out.join(held, col(column).eqNullSafe(F.col("__c")), "left")
            n = F.coalesce("n", F.lit(0))
            codes = {f"__code{i}_{k}": (F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(self.weight * p)) / (n + F.lit(self.weight)) for k, p in enumerate(self.priors)}
            out = out.withColumns(codes).drop("__c", "n", *[f"s{k}" for k in range(len(self.priors))])
        scored = self.trees.transform(out)
        return scored.select(*[col(c) for c in df.columns if c != "predictions"], "predictions")


def train_ordered_targets(df: DataFrame, algorithm, label: str, features: Sequence[str]) -> CodedTrees:
    """Symmetric trees on ordered target statistics.

    Options beside those of boosting: ``cat_features`` (default: the text columns among the features), ``key`` (columns that
    identify a row, for the order; default: all that are used), ``prior_weight``, ``order_seed``. Several classes: a code for each.
    """
    options = dict(algorithm.input_variables)
    text = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    columns = [str(c) for c in options.pop("cat_features", text)]
    key = options.pop("key", None)
    key = [key] if isinstance(key, str) else list(key or [*features, label])
    weight, seed = float(options.pop("prior_weight", 1.0)), int(options.pop("order_seed", 0))
    rows = df.where(col(label).isNotNull()).select(*[col(c) for c in dict.fromkeys([*features, label, *key])])
    target, labels, outputs = encoded(rows, label, algorithm.type)
    targets = [target] if outputs == 1 else [(target == k).cast("double") for k in range(outputs)]
    priors = [float(x or 0.0) for x in rows.agg(*[F.avg(t) for t in targets]).first()]
    coded, names, statistics = rows, [f for f in features if f not in columns], []
    for i, column in enumerate(columns):
        for k, (one, prior) in enumerate(zip(targets, priors)):
            names.append(f"__code{i}_{k}")
            coded = ordered_codes(coded, key, column, one, names[-1], prior, weight, seed)
        sums = [F.sum(one).alias(f"s{k}") for k, one in enumerate(targets)]
        statistics.append(materialize(rows.groupBy(col(column).alias("category")).agg(*sums, F.count(F.lit(1)).alias("n"))))
    settings = {"rounds": 100, "depth": 6, "rate": 0.1, "reg": 3.0, "symmetric": True, **boosting_options(options)}
    base, trees = fit_trees(materialize(coded), target, names, "number" if labels is None else "class", outputs, **settings)
    model = GradientTrees(tuple(names), labels, base, float(settings["rate"]), trees)
    return CodedTrees(model, tuple(columns), tuple(statistics), tuple(priors), weight)
