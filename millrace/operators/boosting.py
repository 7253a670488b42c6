"""Adaptive boosting as rounds of weighted Spark decision trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.session import dealt, materialize


@dataclass(frozen=True)
class BoostedTrees:
    """Trees with their say; classes vote by weight, numbers take the weighted median."""

    trees: tuple
    weights: tuple[float, ...]
    features: tuple[str, ...]
    labels: tuple[str, ...] | None

    def transform(self, df: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=list(self.features), outputCol="__features").transform(df)
        names = []
        for i, tree in enumerate(self.trees):
            names.append(f"__p{i}")
            out = tree.copy({tree.getParam("predictionCol"): names[-1]}).transform(out)
            out = out.drop("rawPrediction", "probability")
        final = self._vote(names) if self.labels is not None else self._median(names)
        return out.withColumn("predictions", final).drop("__features", *names)

    def _vote(self, names: Sequence[str]) -> Column:
        says = [
            sum((F.when(F.col(n) == k, F.lit(w)).otherwise(0.0) for n, w in zip(names, self.weights)), F.lit(0.0))
            for k in range(len(self.labels))
        ]
        best = F.array_max(F.array(*says))
        place = F.array_position(F.array(*says), best)
        return F.get(F.array(*[F.lit(x) for x in self.labels]), (place - 1).cast("int"))

    def _median(self, names: Sequence[str]) -> Column:
        pairs = F.array_sort(F.array(*[F.struct(F.col(n).alias("x"), F.lit(w).alias("w")) for n, w in zip(names, self.weights)]))
        half = sum(self.weights) / 2
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("x"))
        found = F.aggregate(
            pairs, start,
            lambda a, p: F.struct(
                (a["s"] + p["w"]).alias("s"),
                F.coalesce(a["x"], F.when(a["s"] + p["w"] >= half, p["x"])).alias("x"),
            ),
        )
        return found["x"]


def train_adaboost(df: DataFrame, algorithm, label: str, features: Sequence[str]) -> BoostedTrees:
    """Multi-class boosting (SAMME) with stumps, or boosting of regression trees with linear loss (R2).

    Each round is two Spark jobs: fit a tree on the current weights, then sum its weighted error. The
    weights are written out every round, so the plan does not grow.
    """
    options = dict(algorithm.input_variables)
    classify = algorithm.type == "classification"
    rounds = int(options.get("n_estimators", 50 if classify else 20))
    rate = float(options.get("learning_rate", 1.0))
    depth = int(options.get("max_depth", 1 if classify else 3))
    kept = df.select(*[col(f) for f in features], col(label))
    labels = None
    if classify:
        index = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(kept)
        kept, labels = index.transform(kept), tuple(index.labels)
    else:
        kept = kept.withColumn("__label", col(label).cast("double"))
    data = VectorAssembler(inputCols=list(features), outputCol="__features").transform(kept).select("__features", "__label")
    state = materialize(dealt(data).withColumn("__w", F.lit(1.0)))
    common = {"featuresCol": "__features", "labelCol": "__label", "weightCol": "__w", "predictionCol": "__p", "seed": 1, "maxDepth": depth}
    trees, says = [], []
    for _ in range(rounds):
        tree = (DecisionTreeClassifier if classify else DecisionTreeRegressor)(**common).fit(state)
        seen = tree.transform(state).select("__features", "__label", "__w", "__p")
        if classify:
            wrong = (F.col("__p") != F.col("__label")).cast("double")
            error = seen.agg(F.sum(F.col("__w") * wrong) / F.sum("__w")).first()[0]
            if error <= 0:
                trees, says = [*trees, tree], [*says, 1.0]
                break
            if error >= 1 - 1 / len(labels):
                break
            say = rate * (math.log((1 - error) / error) + math.log(len(labels) - 1))
            grow = F.exp(F.lit(say) * wrong)
        else:
            miss = F.abs(F.col("__p") - F.col("__label"))
            worst = seen.agg(F.max(miss)).first()[0]
            if worst <= 0:
                trees, says = [*trees, tree], [*says, 1.0]
                break
            loss = miss / F.lit(worst)
            error = seen.agg(F.sum(F.col("__w") * loss) / F.sum("__w")).first()[0]
            if error >= 0.5:
                break
            beta = error / (1 - error)
            say = rate * math.log(1 / beta)
            grow = F.pow(F.lit(beta), (1 - loss) * rate)
        trees, says = [*trees, tree], [*says, say]
        total = seen.agg(F.avg(F.col("__w") * grow)).first()[0]
        state = materialize(seen.select("__features", "__label", (F.col("__w") * grow / F.lit(total)).alias("__w")))
    if not trees:
        raise ValueError("the first tree is no better than chance")
    return BoostedTrees(tuple(trees), tuple(says), tuple(features), labels)
