"""Gradient boosting by second-order sums: regularised trees over quantile bins.

The rows are binned once. Each level of a tree is one aggregation: the sums of gradients and Hessians per node, feature and
bin, whose number depends on the parameters alone. From these sums the driver picks the splits, the side that missing values
take, and the leaf weights; the rows never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.session import dealt, materialize

#: Rounds after which the margins are written out, so that plans stay short.
KEEP = 4
#: Precision of the sketch that bins come from: ranks are off by 1 / SKETCH of the rows at most.
SKETCH = 20_000


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in heap order: ``x <= cut`` goes left; a missing value where ``missing_left`` says."""

    depth: int
    feature: tuple[int, ...]
    cut: tuple[float, ...]
    missing_left: tuple[bool, ...]
    leaf: tuple[float, ...]

    def values(self, x: np.ndarray) -> np.ndarray:
        feature, cut, missing = np.asarray(self.feature), np.asarray(self.cut), np.asarray(self.missing_left)
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            v = x[rows, feature[at]]
            node = 2 * node + ~np.where(np.isnan(v), missing[at], v <= cut[at])
        return np.asarray(self.leaf)[node]


@dataclass(frozen=True)
class GradientTrees:
    """Sums of trees: one sum per class (two classes: one in all), or one for a number.

    ``trees`` holds a tuple of trees per round, one for each sum. Missing values (NULL, NaN) are allowed in any feature.
    """

    features: tuple[str, ...]
    labels: tuple[str, ...] | None
    base: tuple[float, ...]
    rate: float
    trees: tuple[tuple[Tree, ...], ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.asarray(self.base, dtype=float), (len(x), 1))
        for turn in self.trees:
            for k, tree in enumerate(turn):
                out[:, k] += self.rate * tree.values(x)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """The table with ``predictions``: labels as text, or numbers."""

        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.array([[np.nan if v is None else v for v in row] for row in batch], dtype=float).reshape(len(batch), len(self.features))
                found = self.margins(x)
                if self.labels is None:
                    yield pd.Series(found[:, 0])
                else:
                    best = (found[:, 0] > 0).astype(int) if len(self.base) == 1 else found.argmax(axis=1)
                    yield pd.Series(np.asarray(self.labels, dtype=object)[best])

        kind = "double" if self.labels is None else "string"
        predict = F.pandas_udf(apply, kind)
        return df.withColumn("predictions", predict(F.array(*[_number(f) for f in self.features])))


def _number(name: str) -> Column:
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature the places it may be cut at, at most ``bins``: its own values if they are few, else quantiles of a sketch."""
    points = F.array(*[F.lit(i / bins) for i in range(1, bins + 1)])
    row = df.agg(*[F.percentile_approx(_number(f), points, SKETCH).alias(f"f{k}") for k, f in enumerate(features)]).first()
    return [sorted({x for x in found or [] if x is not None}) for found in row]


def _bin(x: Column, cuts: Sequence[float]) -> Column:
    """How many cuts lie below the value, by bisection; -1 if it is missing."""
    if not cuts:
        return F.when(x.isNull(), -1).otherwise(0)
    held = F.array(*[F.lit(float(c)) for c in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, h: F.when(F.get(held, at + h - 1) < x, at + h).otherwise(at))
    return F.when(x.isNull(), -1).otherwise(place)


@dataclass(frozen=True)
class _Split:
    feature: int
    place: int
    missing_left: bool


def _walk(bins: Column, splits: Mapping[int, _Split], depth: int, out, node: int = 0, level: int = 0) -> Column:
    """A value for each row from the tree grown so far: ``out(place at the last level)``."""
    if level == depth:
        return out(node)
    split = splits.get((1 << level) - 1 + node)
    left = _walk(bins, splits, depth, out, 2 * node, level + 1)
    if split is None:
        return left
    x = F.get(bins, F.lit(split.feature))
    goes_left = F.when(x < 0, F.lit(split.missing_left)).otherwise(x <= split.place)
    return F.when(goes_left, left).otherwise(_walk(bins, splits, depth, out, 2 * node + 1, level + 1))


def best_splits(g: np.ndarray, h: np.ndarray, reg: float, gamma: float, least: float, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """From sums per (node, feature, bin), the last bin being that of missing values: ``(gain, choice)`` per node.

    A choice is ``(feature, place, missing left?)``. Of equal gains (but for rounding) the first feature, then the lowest
    place, then missing values to the left. Symmetric trees take one choice for all nodes, that of the greatest sum of gains.
    """
    total_g, total_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    left_g, left_h = np.cumsum(g[:, :, :-1], axis=2), np.cumsum(h[:, :, :-1], axis=2)
    # the last axis: missing values to the left, to the right
    left_g = np.stack([left_g + g[:, :, -1:], left_g], axis=3)
    left_h = np.stack([left_h + h[:, :, -1:], left_h], axis=3)
    right_g, right_h = total_g[..., None] - left_g, total_h[..., None] - left_h

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a * a, b + reg, out=np.zeros_like(a), where=b + reg > 0)

    gain = (score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[..., None]) / 2 - gamma
    gain[(left_h < least) | (right_h < least) | (left_h <= 0) | (right_h <= 0)] = 0 if symmetric else -np.inf
    if symmetric:
        gain = np.broadcast_to(gain.sum(axis=0, keepdims=True), gain.shape)
    flat = gain.reshape(len(gain), -1)
    slack = 1e-11 * (np.abs(flat.max(axis=1)) + np.abs(score(total_g, total_h)).sum(axis=0 if symmetric else (1, 2)).ravel())
    best = (flat >= (flat.max(axis=1) - slack)[:, None]).argmax(axis=1)
    return flat[np.arange(len(flat)), best], np.stack(np.unravel_index(best, gain.shape[1:]), axis=1)


def _gradients(kind: str, margins: Column, target: Column, outputs: int) -> list[tuple[Column, Column]]:
    if kind == "number":
        return [(F.get(margins, F.lit(0)) - target, F.lit(1.0))]
    if outputs == 1:
        p = 1 / (1 + F.exp(-F.get(margins, F.lit(0))))
        return [(p - target, p * (1 - p))]
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    whole = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    out = []
    for k in range(outputs):
        p = F.get(powers, F.lit(k)) / whole
        out.append((p - (target == k).cast("double"), 2 * p * (1 - p)))
    return out


def fit_trees(
    df: DataFrame,
    target: Column,
    features: Sequence[str],
    kind: str,
    outputs: int = 1,
    rounds: int = 100,
    depth: int = 6,
    rate: float = 0.3,
    reg: float = 1.0,
    gamma: float = 0.0,
    least: float = 1.0,
    bins: int = 64,
    base: float | None = None,
    symmetric: bool = False,
) -> tuple[tuple[float, ...], tuple[tuple[Tree, ...], ...]]:
    """Base margins and trees. ``kind``: ``number`` (squared error) or ``class`` (logistic; ``outputs`` above 1: softmax).

    ``reg`` (lambda), ``gamma`` and ``least`` (child weight) are the usual penalties; a node that no split improves stays whole.
    """
    cuts = quantile_cuts(df, features, bins)
    if base is None:
        base = (df.agg(F.avg(target)).first()[0] or 0.0) if kind == "number" else 0.0
    start = tuple([float(base)] * outputs)
    binned = F.array(*[_bin(_number(f), c).cast("int") for f, c in zip(features, cuts)])
    state = materialize(dealt(df.select(binned.alias("bins"), target.cast("double").alias("y"), F.array(*[F.lit(b) for b in start]).alias("m"))))
    width = max(map(len, cuts), default=0) + 1
    trees = []
    for turn in range(rounds):
        grads = _gradients(kind, F.col("m"), F.col("y"), outputs)
        splits: list[dict[int, _Split]] = [{} for _ in range(outputs)]
        weights = np.zeros((outputs, 1 << depth))
        grown = False
        for level in range(depth):
            # one row per output, feature and node with rows in it
            parts = [F.struct(F.lit(k).alias("k"), _walk(F.col("bins"), splits[k], level, F.lit).alias("node"), g.alias("g"), h.alias("h")) for k, (g, h) in enumerate(grads)]
            each = state.select(F.explode(F.array(*parts)).alias("o"), "bins").select("o.*", F.posexplode("bins").alias("f", "b"))
            sums = each.groupBy("k", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
            g, h = (np.zeros((outputs, 1 << level, len(features), width + 1)) for _ in range(2))
            at = tuple(sums[c].to_numpy(int) for c in ("k", "node", "f", "b"))  # bin -1 is the last one
            g[at], h[at] = sums["g"], sums["h"]
            split_now = False
            for k in range(outputs):
                gain, choice = best_splits(g[k], h[k], reg, gamma, least, symmetric)
                all_g, all_h = g[k][:, 0].sum(axis=1), h[k][:, 0].sum(axis=1)
                for node in range(1 << level):
                    below = slice(node << (depth - level), (node + 1) << (depth - level))
                    if level == 0 or splits[k].get((1 << (level - 1)) - 1 + node // 2):
                        weights[k, below] = -all_g[node] / (all_h[node] + reg) if all_h[node] + reg > 0 else 0.0
                    if gain[node] > 1e-12 and all_h[node] > 0:
                        f, place, way = (int(x) for x in choice[node])
                        splits[k][(1 << level) - 1 + node] = _Split(f, place, way == 0)
                        split_now = True
                        left = g[k][node, f, : place + 1].sum() + (g[k][node, f, -1] if way == 0 else 0)
                        left_h = h[k][node, f, : place + 1].sum() + (h[k][node, f, -1] if way == 0 else 0)
                        middle = (below.start + below.stop) // 2
                        for where, a, b in ((slice(below.start, middle), left, left_h), (slice(middle, below.stop), all_g[node] - left, all_h[node] - left_h)):
                            weights[k, where] = -a / (b + reg) if b + reg > 0 else 0.0
            grown |= split_now
            if not split_now:
                break
        made = []
        for k in range(outputs):
            nodes = [splits[k].get(i) for i in range((1 << depth) - 1)]
            made.append(
                Tree(
                    depth,
                    tuple(s.feature if s else 0 for s in nodes),
                    tuple(float(cuts[s.feature][s.place]) if s and s.place < len(cuts[s.feature]) else float("inf") for s in nodes),
                    tuple(s.missing_left if s else True for s in nodes),
                    tuple(float(w) for w in weights[k]),
                )
            )
        trees.append(tuple(made))
        moved = [F.get("m", F.lit(k)) + rate * _walk(F.col("bins"), splits[k], depth, lambda n, k=k: F.lit(float(weights[k][n]))) for k in range(outputs)]
        state = state.select("bins", "y", F.array(*moved).alias("m"))
        if (turn + 1) % KEEP == 0:
            state = materialize(state)
        if not grown and not any(abs(w) > 1e-12 for w in weights.ravel()):
            break
    return start, tuple(trees)


#: Other spellings of the options.
_SPELLINGS = {
    "n_estimators": "rounds", "iterations": "rounds", "num_boost_round": "rounds", "maxIter": "rounds",
    "max_depth": "depth", "maxDepth": "depth", "learning_rate": "rate", "eta": "rate", "stepSize": "rate",
    "reg_lambda": "reg", "lambda": "reg", "l2_leaf_reg": "reg", "min_split_loss": "gamma",
    "min_child_weight": "least", "max_bin": "bins", "border_count": "bins", "base_score": "base",
}


def boosting_options(options: Mapping[str, object]) -> dict[str, object]:
    """Options of ``fit_trees`` from the names that boosting libraries give them; a seed is accepted (nothing here is random)."""
    known = {"rounds", "depth", "rate", "reg", "gamma", "least", "bins", "base", "symmetric"}
    out = {}
    for name, value in options.items():
        name = _SPELLINGS.get(name, name)
        if name in known:
            out[name] = value
        elif name not in ("seed", "random_state", "random_seed", "verbose", "verbosity"):
            raise ValueError(f"unknown option {name}; one of {sorted(known | set(_SPELLINGS))}")
    return out


def encoded(df: DataFrame, label: str, kind: str) -> tuple[Column, tuple[str, ...] | None, int]:
    """The target as a number, the classes in order, and how many sums they need."""
    if kind != "classification":
        return col(label).cast("double"), None, 1
    found = df.select(col(label).cast("string").alias("x")).where("x is not null").distinct().orderBy("x").limit(1_001).collect()
    if len(found) > 1_000:
        raise ValueError(f"{label} has more than 1,000 classes")
    labels = tuple(r.x for r in found)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), col(label).cast("string")) - 1
    return place.cast("double"), labels, 1 if len(labels) <= 2 else len(labels)


def train_second_order(df: DataFrame, algorithm, label: str, features: Sequence[str]) -> GradientTrees:
    """Second-order boosting with regularised leaves and a learned side for missing values. Rows without a label are left out."""
    rows = df.where(col(label).isNotNull())
    target, labels, outputs = encoded(rows, label, algorithm.type)
    options = {"rounds": 100, "depth": 6, "rate": 0.3, **boosting_options(algorithm.input_variables)}
    kind = "number" if labels is None else "class"
    base, trees = fit_trees(rows, target, features, kind, outputs, **options)
    return GradientTrees(tuple(features), labels, base, float(options["rate"]), trees)
