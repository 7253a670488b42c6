"""Bayesian ridge regression: one pass for the moment matrix, then a small fixed point."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import col


@dataclass(frozen=True)
class LinearFit:
    """A linear model as a projection."""

    coefficients: dict[str, float]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(self.intercept)
        for name, w in self.coefficients.items():
            total = total + F.lit(w) * col(name)
        return df.withColumn("predictions", total)


def centred_moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without a missing value, the columns' means, and sums of products of deviations from them.

    The means come first, so columns far from zero lose no digits.
    """
    rows = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    first = rows.agg(F.count(F.lit(1)), *[F.avg(f"c{i}") for i in range(len(columns))]).first()
    mean = np.array([x or 0.0 for x in first[1:]])
    gaps = [F.col(f"c{i}") - F.lit(float(m)) for i, m in enumerate(mean)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.agg(*[F.sum(gaps[i] * gaps[j]) for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), x in zip(pairs, sums):
        out[i, j] = out[j, i] = x or 0.0
    return first[0], mean, out


def train_bayesian_ridge(
    df: DataFrame, label: str, features: Sequence[str], n_iter: int = 300, tol: float = 1e-3,
    alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6, lambda_2: float = 1e-6,
) -> LinearFit:
    """Evidence maximisation over noise precision ``alpha`` and weight precision ``lambda``."""
    n, mean, centred = centred_moments(df, [*features, label])
    xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ xy
    alpha, lam = 1.0 / max(yy / n, np.finfo(float).eps), 1.0
    w = np.zeros(len(features))
    for _ in range(n_iter):
        new = vectors @ (rotated / (values + lam / alpha))
        rss = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * lambda_1) / (new @ new + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (rss + 2 * alpha_2)
        moved, w = np.abs(new - w).sum(), new
        if moved < tol:
            break
    w = vectors @ (rotated / (values + lam / alpha))
    return LinearFit(dict(zip(features, w.tolist())), float(mean[-1] - w @ mean[:-1]))
