"""Kernel machines by random Fourier features: classifier, regressor and one-class machine.

A Gaussian kernel ``exp(-gamma |x - y|^2)`` is the mean of products of cosines in random directions. Rows become vectors of a fixed
number of such cosines, and a machine is linear in them: its gradients are sums over rows, made where the rows are, so
the cost grows with the rows and not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.operators.gradient import encoded
from millrace.quantiles import exact_quantiles
from millrace.session import dealt, materialize

#: Cosines, rounds of the optimiser, rows mapped at a time, and how far a loss with a kink is rounded off around it.
SIZE, ROUNDS, STEP, ROUND_OFF = 256, 60, 4_096, 0.05
#: Sums from more parts than this are added up by tasks before the driver adds the rest.
DIRECT_PARTS, GROUPS = 256, 16


@dataclass(frozen=True)
class FourierMap:
    """``sqrt(2 / D) cos(x W + b)`` of the centred and scaled features."""

    features: tuple[str, ...]
    center: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.cos((x - self.center) @ self.weights + self.shift) * math.sqrt(2 / len(self.shift))

    def column(self) -> Column:
        """The same as an array expression."""
        x = F.array(*[col(f).cast("double") - F.lit(float(c)) for f, c in zip(self.features, self.center)])
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(self.weights.T, self.shift)])
        dot = lambda r: F.aggregate(F.zip_with(r["w"], x, lambda a, b: a * b), r["b"], lambda s, v: s + v)
        return F.transform(rows, lambda r: F.cos(dot(r)) * F.lit(math.sqrt(2 / len(self.shift))))


def fourier_map(df: DataFrame, features: Sequence[str], gamma: float | str = "scale", size: int = SIZE, seed: int = 1) -> FourierMap:
    """Seeded directions for a Gaussian kernel. ``gamma``: a number, ``auto`` (1 / columns) or ``scale`` (1 / (columns * variance))."""
    sums = [f(col(c).cast("double")) for c in features for f in (F.avg, F.var_pop)]
    row = df.agg(*sums).first()
    mean, var = np.array([x or 0.0 for x in row[0::2]]), np.array([x or 0.0 for x in row[1::2]])
    if gamma == "scale":
        whole = float(var.mean() + mean.var())
        gamma = 1 / (len(features) * whole) if whole > 0 else 1.0
    elif gamma == "auto":
        gamma = 1 / len(features)
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, math.sqrt(2 * float(gamma)), (len(features), size))
    return FourierMap(tuple(features), mean, weights, rng.uniform(0, 2 * math.pi, size))


def _rows(df: DataFrame, features: Sequence[str], target: Column | None = None) -> DataFrame:
    """``(x, y)`` of the rows without a missing value, dealt out evenly and written once."""
    x = [col(f).cast("double") for f in features]
    whole = F.array(*x)
    y = F.lit(0.0) if target is None else target.cast("double")
    full = F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v))
    return materialize(dealt(df.where(full & y.isNotNull()).select(whole.alias("x"), y.alias("y"))))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, batch.num_rows, STEP):
        part = batch.slice(k, STEP)
        y = part.column("y").to_numpy()
        yield part.column("x").flatten().to_numpy().reshape(len(y), -1), y


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum of ``work(x, y)``, an array of ``size`` numbers, over all rows."""

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x, y in _batches(batch):
                total += work(x, y)
        yield one(total)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column("s").flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield one(total)

    parts = rows.mapInArrow(partial, "s array<double>")
    if rows.rdd.getNumPartitions() > DIRECT_PARTS:
        parts = parts.repartition(GROUPS).mapInArrow(gathered, "s array<double>")
    found = parts.collect()
    return np.sum([np.asarray(r.s) for r in found], axis=0) if found else np.zeros(size)


def minimise(value_and_slope, start: np.ndarray, rounds: int = ROUNDS, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; each evaluation is one pass over the rows."""
    x = start
    value, slope = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        direction, kept = slope.copy(), []
        for s, g in reversed(steps):
            a = s @ direction / (g @ s)
            kept.append(a)
            direction -= a * g
        if steps:
            s, g = steps[-1]
            direction *= s @ g / (g @ g)
        for (s, g), a in zip(steps, reversed(kept)):
            direction += s * (a - g @ direction / (g @ s))
        length, down = (1.0 if steps else min(1.0, 1 / np.abs(slope).sum())), slope @ direction
        while True:
            there = x - length * direction
            new, new_slope = value_and_slope(there)
            if new <= value - 1e-4 * length * down or length < 1e-8:
                break
            length /= 2
        s, g = there - x, new_slope - slope
        if s @ g > 1e-12:
            steps = [*steps[1 - memory :], (s, g)]
        if length < 1e-8 or value - new < 1e-9 * max(1.0, abs(value)):
            return there if new < value else x
        x, value, slope = there, new, new_slope
    return x


def _rounded_off(r: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """``max(0, r)`` and its slope, the kink rounded off over ``width``."""
    inside = np.clip(r, 0, width)
    return np.where(r > width, r - width / 2, inside**2 / (2 * width)), inside / width


@dataclass(frozen=True)
class KernelMachine:
    """A linear machine over the cosines: ``weights`` has a column for each class (two classes: one), or one for a number."""

    map: FourierMap
    weights: np.ndarray
    labels: tuple[str, ...] | None
    center: float
    width: float

    def transform(self, df: DataFrame) -> DataFrame:
        """The table with ``predictions``; NULL where a feature is missing."""

        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            labels = None if self.labels is None else np.asarray(self.labels, dtype=object)
            for batch in batches:
                x = np.array([[np.nan if v is None else v for v in row] for row in batch], dtype=float).reshape(len(batch), len(self.map.features))
                z = np.column_stack([self.map(x), np.ones(len(x))]) @ self.weights
                if labels is None:
                    yield pd.Series(z[:, 0] * self.width + self.center)
                else:
                    best = (z[:, 0] > 0).astype(int) if z.shape[1] == 1 else z.argmax(axis=1)
                    found = pd.Series(labels[np.minimum(best, len(labels) - 1)])
                    yield found.where(~np.isnan(z[:, 0]), None)

        predict = F.pandas_udf(apply, "double" if self.labels is None else "string")
        out = df.withColumn("predictions", predict(F.array(*[col(f).cast("double") for f in self.map.features])))
        return out.withColumn("predictions", F.nanvl("predictions", F.lit(None).cast("double"))) if self.labels is None else out


def _options(options: Mapping[str, object]) -> dict[str, object]:
    known = {"C": 1.0, "gamma": "scale", "epsilon": 0.1, "size": SIZE, "rounds": ROUNDS, "seed": 1}
    spellings = {"maxIter": "rounds", "max_iter": "rounds", "n_components": "size", "random_state": "seed"}
    out = dict(known)
    for name, value in options.items():
        name = spellings.get(name, name)
        if name == "kernel" and value == "rbf" or name in ("verbose", "tol"):
            continue
        if name not in known:
            raise ValueError(f"unknown option {name}={value}; one of {sorted(known)}")
        out[name] = value
    return out


def train_kernel_machine(df: DataFrame, algorithm, label: str, features: Sequence[str]) -> KernelMachine:
    """Support vector classifier (hinge loss, one against the rest) or regressor (epsilon-insensitive loss) with a Gaussian kernel.

    Options: ``C``, ``gamma``, ``epsilon`` (in units of the target), ``size`` (cosines), ``rounds``, ``seed``. The kinks of
    the losses are rounded off over a twentieth. Rows with a missing value are left out.
    """
    o = _options(algorithm.input_variables)
    present = df.where(col(label).isNotNull())
    target, labels, outputs = encoded(present, label, algorithm.type)
    phi = fourier_map(present, features, o["gamma"], int(o["size"]), int(o["seed"]))
    rows = _rows(present, features, target)
    n, mean, width = rows.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y")).first()
    if not n:
        raise ValueError("no row has all features and a label")
    mean, width = (mean, width or 1.0) if labels is None else (0.0, 1.0)
    epsilon, size = float(o["epsilon"]) / width, int(o["size"]) + 1
    reg = 1 / (float(o["C"]) * n)

    def value_and_slope(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(size, outputs)

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack([phi(x), np.ones(len(x))])
            f = z @ w
            if labels is None:
                gap = f[:, 0] - (y - mean) / width
                loss, slope = _rounded_off(np.abs(gap) - epsilon, ROUND_OFF)
                slope = (slope * np.sign(gap))[:, None]
            else:
                side = np.where((y[:, None] == np.arange(outputs)) if outputs > 1 else (y[:, None] == 1), 1.0, -1.0)
                loss, slope = _rounded_off(1 - side * f, ROUND_OFF)
                slope = -slope * side
            return np.append(z.T @ slope, loss.sum())

        found = _summed(rows, work, size * outputs + 1)
        penalty = w.copy()
        penalty[-1] = 0  # not of the offset
        return float(found[-1] / n + reg / 2 * (penalty**2).sum()), found[:-1] / n + reg * penalty.ravel()

    w = minimise(value_and_slope, np.zeros(size * outputs), int(o["rounds"]))
    return KernelMachine(phi, w.reshape(size, outputs), labels, float(mean), float(width))


@dataclass(frozen=True)
class OneClassMachine:
    """Rows whose cosines score below the offset are outside."""

    map: FourierMap
    weights: np.ndarray
    offset: float

    def scores(self, df: DataFrame, out: str) -> DataFrame:
        def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.column_stack([v.to_numpy(float) for v in batch])
                yield pd.Series(np.concatenate([x[:0, 0], *[self.map(x[k : k + STEP]) @ self.weights for k in range(0, len(x), STEP)]]))

        score = F.pandas_udf(apply, "double")
        return df.withColumn(out, score(*[col(f).cast("double") for f in self.map.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predictions``: -1 outside, 1 inside; a row with a missing feature is outside."""
        scored = self.scores(df, "__s")
        inside = F.coalesce(~F.isnan("__s") & (F.col("__s") >= self.offset), F.lit(False))
        return scored.withColumn("predictions", F.when(inside, 1).otherwise(-1)).drop("__s")


def train_one_class_machine(
    df: DataFrame, features: Sequence[str], nu: float = 0.5, gamma: float | str = "scale", size: int = SIZE, rounds: int = 20, seed: int = 1, **unused
) -> OneClassMachine:
    """The one-class machine: a direction of the cosines and an offset such that the share ``nu`` of the rows scores below it.

    Conditional gradient steps: in each, the rows below the exact ``nu``-quantile of the scores pull the direction to their
    mean, by 2 / (step + 2). The offset is the exact quantile of the last scores.
    """
    if not 0 < nu <= 1:
        raise ValueError("nu lies in (0, 1]")
    phi = fourier_map(df, features, gamma, size, seed)
    rows = _rows(df, features)
    n = rows.count()
    if not n:
        raise ValueError("no row has all features")
    w = _summed(rows, lambda x, y: phi(x).sum(axis=0), size) / n

    def quantile(w: np.ndarray) -> float:
        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, _ in _batches(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(phi(x) @ w)], names=["__s"])

        scored = materialize(rows.mapInArrow(scores, "__s double"))  # a quantile reads them several times
        return float(exact_quantiles(scored, [], ["__s"], [nu]).first()["q"][0])

    for step in range(rounds):
        cut = quantile(w)

        def work(x: np.ndarray, y: np.ndarray, w=w, cut=cut) -> np.ndarray:
            z = phi(x)
            low = z @ w <= cut
            return np.append(z[low].sum(axis=0), low.sum())

        found = _summed(rows, work, size + 1)
        pull = 2 / (step + 2 + 1)
        w = (1 - pull) * w + pull * found[:-1] / max(found[-1], 1)
    return OneClassMachine(phi, w, quantile(w))
