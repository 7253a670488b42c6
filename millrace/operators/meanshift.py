"""Mean shift clustering: grid cells as seeds, a neighbourhood join per step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, require
from millrace.session import BROADCAST_ROWS, materialize

#: Directions that cells are laid along; rows and centres compared at a time when rows are given their centre.
DIRECTIONS, STEP = 3, 1_024


@dataclass(frozen=True)
class MeanShiftModel:
    features: tuple[str, ...]
    centers: tuple[tuple[float, ...], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predictions``, the number of the nearest centre; NULL where a feature is missing."""
        sent = df.sparkSession.sparkContext.broadcast(np.asarray(self.centers, dtype=float).reshape(-1, len(self.features)))  # <= BROADCAST_ROWS

        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            centers = sent.value
            for batch in batches:
                x = np.array([[np.nan if v is None else v for v in row] for row in batch], dtype=float).reshape(len(batch), len(self.features))
                best, place = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
                for k in range(0, len(centers), STEP):
                    for i in range(0, len(x), STEP):
                        gaps = ((x[i : i + STEP, None, :] - centers[None, k : k + STEP, :]) ** 2).sum(axis=2)
                        at = gaps.argmin(axis=1)
                        least = gaps[np.arange(len(at)), at]
                        closer = least < best[i : i + STEP]
                        best[i : i + STEP] = np.where(closer, least, best[i : i + STEP])
                        place[i : i + STEP] = np.where(closer, at + k, place[i : i + STEP])
                yield pd.Series(place, dtype="Int32").where(~np.isnan(x).any(axis=1))

        return df.withColumn("predictions", F.pandas_udf(nearest, "int")(F.array(*[col(f).cast("double") for f in self.features])))


class _Grid:
    """Cells as wide as the bandwidth along a few directions at right angles: two points within the bandwidth lie in the
    same cell or in adjoining ones, since no projection is longer than what it is of."""

    def __init__(self, width: int, bandwidth: float):
        self.bandwidth = bandwidth
        if width <= DIRECTIONS + 1:
            self.axes = np.eye(width)
        else:
            self.axes = np.linalg.qr(np.random.default_rng(width).normal(size=(width, DIRECTIONS)))[0].T
        self.names = [f"g{i}" for i in range(len(self.axes))]
        steps = product((-1, 0, 1), repeat=len(self.axes))
        self.steps = F.array(*[F.array(*[F.lit(o) for o in offset]) for offset in steps])

    def cells(self, xs: Sequence[str]) -> list[Column]:
        out = []
        for name, axis in zip(self.names, self.axes):
            along = sum((F.col(x) * F.lit(float(a)) for x, a in zip(xs, axis) if a), F.lit(0.0))
            out.append(F.floor(along / self.bandwidth).cast("long").alias(name))
        return out

    def near(self, left: DataFrame, ls: Sequence[str], right: DataFrame, rs: Sequence[str]) -> DataFrame:
        """Pairs within the bandwidth; ``right`` already has its cells. Columns of both sides have names of their own."""
        looking = left.select("*", *[c.alias(f"l{n}") for c, n in zip(self.cells(ls), self.names)]).withColumn("o", F.explode(self.steps))
        looking = looking.withColumns({n: F.col(f"l{n}") + F.get("o", F.lit(i)) for i, n in enumerate(self.names)}).drop("o", *[f"l{n}" for n in self.names])
        gap = sum(((F.col(x) - F.col(s)) * (F.col(x) - F.col(s)) for x, s in zip(rs, ls)), F.lit(0.0))
        return looking.join(right, self.names).where(gap <= self.bandwidth * self.bandwidth)


def train_mean_shift(df: DataFrame, features: Sequence[str], bandwidth: float, max_iter: int = 300, max_centers: int = BROADCAST_ROWS) -> MeanShiftModel:
    """Move each occupied grid cell's mean to the mean of the points within the bandwidth until it rests;
    of the resting places closer than the bandwidth the one with most points stays.

    Seeds and points meet on grid cells (a seed looks into its own and the adjoining cells) and every pair is verified; equal
    points are reduced to one with a count first, and means are map-side combined. More than four columns are laid out
    along three directions. A seed that still moves after ``max_iter`` steps is left out. Centres stay a table
    until they are known to be at most ``max_centers``.
    """
    names = require(df, features)
    if bandwidth <= 0:
        raise ValueError("the bandwidth must be positive")
    xs, ss, ms = ([f"{c}{i}" for i in range(len(names))] for c in "xsm")
    grid = _Grid(len(names), bandwidth)
    points = df.select(*[col(f).cast("double").alias(x) for x, f in zip(xs, names)]).na.drop()
    points = points.groupBy(*xs).agg(F.count(F.lit(1)).alias("n"))
    points = materialize(points.select(*xs, "n", *grid.cells(xs)))

    def mean(of: str) -> Column:
        return F.sum(F.col(of) * F.col("n")) / F.sum("n")

    seeds = points.groupBy(*grid.names).agg(*[mean(x).alias(s) for x, s in zip(xs, ss)]).select(*ss)

    def neighbourhood(at: DataFrame) -> DataFrame:
        """Mean and number of the points near each seed, and how far the mean lies from it."""
        out = grid.near(at, ss, points, xs).groupBy(*ss).agg(*[mean(x).alias(m) for x, m in zip(xs, ms)], F.sum("n").alias("n"))
        moved = sum(((F.col(m) - F.col(s)) * (F.col(m) - F.col(s)) for m, s in zip(ms, ss)), F.lit(0.0))
        return out.withColumn("moved", moved)

    resting = None
    for _ in range(max_iter):
        step = materialize(neighbourhood(seeds))
        still = F.col("moved") < (1e-3 * bandwidth) ** 2
        done = step.where(still).select(*[F.round(m, 9).alias(m) for m in ms], "n").distinct()
        resting = done if resting is None else resting.unionByName(done)
        # seeds that have met go on as one
        seeds = step.where(~still).select(*[F.round(m, 9).alias(s) for m, s in zip(ms, ss)]).distinct()
        if seeds.isEmpty():
            break
    rows = _densest(materialize(resting.groupBy(*ms).agg(F.max("n").alias("n"))), grid, ms).limit(max_centers + 1).collect()
    if len(rows) > max_centers:
        raise ValueError(f"more than {max_centers} clusters; the bandwidth is too small")
    ranked = sorted(((r["n"], *[r[m] for m in ms]) for r in rows), reverse=True)
    return MeanShiftModel(tuple(names), tuple(tuple(float(v) for v in place[1:]) for place in ranked))


def _densest(resting: DataFrame, grid: _Grid, ms: Sequence[str]) -> DataFrame:
    """The resting places that no denser one that stays lies within the bandwidth of; of equal ones the greater place.

    Rounds of joins: a place with no open rival that ranks before it stays, and those near it go.
    """
    pairs = ["n", *ms]
    other = resting.select(*[F.col(c).alias(f"o{c}") for c in pairs])
    other = other.select("*", *grid.cells([f"o{m}" for m in ms]))
    ahead = F.struct(*[F.col(f"o{c}") for c in pairs]) > F.struct(*[F.col(c) for c in pairs])
    rivals = materialize(grid.near(resting, ms, other, [f"o{m}" for m in ms]).where(ahead).select(*pairs, *[f"o{c}" for c in pairs]))
    open_, kept = resting, None
    while True:
        beaten = rivals.join(open_.select(*[F.col(c).alias(f"o{c}") for c in pairs]), [f"o{c}" for c in pairs], "left_semi")
        stays = materialize(open_.join(beaten, pairs, "left_anti"))
        kept = stays if kept is None else kept.unionByName(stays)
        gone = rivals.join(stays.select(*[F.col(c).alias(f"o{c}") for c in pairs]), [f"o{c}" for c in pairs], "left_semi")
        open_ = materialize(open_.join(stays, pairs, "left_anti").join(gone, pairs, "left_anti"))
        if open_.isEmpty():
            return kept.select(*pairs)
