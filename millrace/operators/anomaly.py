"""Outlier detectors: isolation forest and a distance rule."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, require
from millrace.operators.scale import Scaler, fit_scaler
from millrace.quantiles import exact_quantiles
from millrace.session import materialize, spread

EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, float)
    deep = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[list[float]]:
    """Nodes [feature, cut, left, right, depth estimate]; feature -1 marks a leaf."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = [[-1, 0.0, 0, 0, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at] = [-1, 0.0, 0, 0, depth + float(average_path(len(rows)))]
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] < cut
        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        nodes[at] = [f, cut, len(nodes) - 2, len(nodes) - 1, 0.0]
        todo += [(len(nodes) - 2, rows[left], depth + 1), (len(nodes) - 1, rows[~left], depth + 1)]
    return nodes


def path_lengths(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    while True:
        f = tree[at, 0].astype(int)
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return tree[at, 4]
        here = at[inner]
        below = x[inner, f[inner]] < tree[here, 1]
        at[inner] = np.where(below, tree[here, 2], tree[here, 3]).astype(int)


@dataclass(frozen=True)
class IsolationForest:
    features: tuple[str, ...]
    trees: tuple[np.ndarray, ...]
    sample: int
    threshold: float = 0.5

    def scores(self, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """Add the score in 0..1; the trees (a few hundred nodes each) travel once per executor."""
        trees = df.sparkSession.sparkContext.broadcast([np.asarray(t) for t in self.trees])
        scale = float(average_path(self.sample))

        @F.pandas_udf("double")
        def rate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = trees.value
            for series in batches:
                x = np.column_stack([s.to_numpy(float) for s in series])
                depth = np.mean([path_lengths(x, t) for t in forest], axis=0)
                yield pd.Series(np.power(2.0, -depth / scale))

        return df.withColumn(out, rate(*[col(f).cast("double") for f in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predictions``: -1 for outliers, 1 for inliers."""
        scored = self.scores(df, "__score")
        return scored.withColumn("predictions", F.when(F.col("__score") > self.threshold, -1).otherwise(1)).drop("__score")


def train_isolation_forest(
    df: DataFrame, key: str | Sequence[str], features: Sequence[str], trees: int = 100, sample: int = 256,
    contamination: float | None = None, seed: int = 1,
) -> IsolationForest:
    """Each tree grows on its own small sample, drawn by hashes of the key and the features; one group per tree.

    With a contamination share the threshold is that quantile of the training scores, else 0.5.
    """
    require(df, features)
    keys = [key] if isinstance(key, str) else list(key)
    names = list(features)
    every = list(dict.fromkeys([*keys, *names]))
    rows = df.select(*[col(c).cast("double").alias(c) if c in names else col(c) for c in every]).na.drop()
    alike = rows.groupBy(*[col(c) for c in every]).agg(F.count(F.lit(1)).alias("__n"))
    n = rows.count()
    # A row takes part in a tree by a hash of the two, so the forest does not depend on how the rows lie. About twice as many come as
    # a tree needs. Of equal rows as many come as their number asks for, so that no tree's group can grow with them.
    expected = F.col("__n") * F.lit(min(1.0, 2 * sample / max(n, 1)))

    def draw(*more: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[col(c) for c in every], F.lit(seed), *more), 11) / float(1 << 53)

    def copies(tree: Column) -> Column:
        return F.struct(tree.alias("tree"), (F.floor(expected) + (draw(tree) < expected - F.floor(expected)).cast("long")).alias("n"))

    drawn = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), copies), lambda d: d["n"] > 0)
    picked = alike.withColumn("__d", F.explode(drawn)).withColumn("__tree", F.col("__d.tree"))
    picked = picked.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__d.n"))))
    picked = materialize(picked.select(*[col(f) for f in names], "__tree", draw(F.col("__tree"), F.col("__copy"), F.lit(1)).alias("__u")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["__tree"].iloc[0])
        x = pdf.sort_values(["__u", *names])[names].to_numpy(float)[:sample]
        return pd.DataFrame({"tree": [number], "nodes": [json.dumps(grow_tree(x, np.random.default_rng([seed, number])))]})

    grown = spread(picked, ["__tree"]).groupBy("__tree").applyInPandas(build, "tree long, nodes string").orderBy("tree").collect()
    arrays = tuple(np.asarray(json.loads(r["nodes"]), float) for r in grown)
    forest = IsolationForest(tuple(features), arrays, min(sample, n))
    if contamination is None:
        return forest
    scored = materialize(forest.scores(rows, "__score").select("__score"))
    cut = exact_quantiles(scored, [], ["__score"], [1 - contamination]).first()["q"][0]
    return IsolationForest(forest.features, forest.trees, forest.sample, float(cut))


@dataclass(frozen=True)
class DistanceRule:
    """Inliers lie within a radius of the centre of the standardised training table."""

    scaler: Scaler
    radius: float

    def transform(self, df: DataFrame) -> DataFrame:
        distance = self.distance(df)
        return distance.withColumn("predictions", F.when(F.col("__d") > self.radius, -1).otherwise(1)).drop("__d")

    def distance(self, df: DataFrame) -> DataFrame:
        s = self.scaler
        terms = [(col(c) - F.lit(s.center[c])) / F.lit(s.width[c]) for c in s.center]
        return df.withColumn("__d", F.sqrt(sum((z * z for z in terms), F.lit(0.0))))


def train_one_class(df: DataFrame, features: Sequence[str], nu: float = 0.5) -> DistanceRule:
    """One-class rule: the share ``nu`` of the training rows farthest from the centre is outside.

    Stands in for the kernel machine, whose cost is quadratic in the rows.
    """
    scaler = fit_scaler(df, features, "standard")
    rule = DistanceRule(scaler, math.inf)
    radius = exact_quantiles(rule.distance(df), [], ["__d"], [1 - nu]).first()["q"][0]
    return DistanceRule(scaler, float(radius))
