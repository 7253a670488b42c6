"""Cross-validated losses and model search."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.operators import metrics
from millrace.operators.models import Algorithm, score, train


def hash_folds(df: DataFrame, key: str | Sequence[str], folds: int = 5, seed: int = 0) -> DataFrame:
    """Add ``__fold`` by hashing the key: the same rows fall in the same fold on every run."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__fold", F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(folds)).cast("int"))


def _quality(scored: DataFrame, label: str, algorithm: Algorithm) -> float:
    if algorithm.type == "regression":
        row = metrics.regression_scores(scored, label).first()
        names = {"r2": row["r2"], "neg_mean_absolute_error": -row["mae"], "neg_mean_squared_error": -row["mse"]}
        return names[algorithm.scoring or "neg_mean_squared_error"]
    return metrics.classification_scores(scored, label).first()["accuracy"]


def cv_loss(
    df: DataFrame, algorithm: Algorithm, label: str, key: str | Sequence[str], features: Sequence[str], folds: int = 5,
    seed: int = 0,
) -> float:
    """1 - mean score over the folds for classes, |mean score| for numbers."""
    parts = hash_folds(df, key, folds, seed)
    scores = []
    for i in range(folds):
        model = train(parts.where(F.col("__fold") != i).drop("__fold"), algorithm, label, features)
        held_out = parts.where(F.col("__fold") == i).drop("__fold")
        scores.append(_quality(score(model, held_out, label, algorithm.type), label, algorithm))
    mean = sum(scores) / len(scores)
    return abs(mean) if algorithm.type == "regression" else 1 - mean


def grid(algorithm: Algorithm, choices: Mapping[str, Sequence]) -> list[Algorithm]:
    """The algorithm with every combination of option values."""
    names = list(choices)
    return [
        Algorithm(algorithm.name, algorithm.type, {**algorithm.input_variables, **dict(zip(names, values))}, algorithm.scoring)
        for values in product(*choices.values())
    ]


def search(
    df: DataFrame, candidates: Sequence[Algorithm], label: str, key: str | Sequence[str], features: Sequence[str],
    folds: int = 5, parallelism: int = 4, budget_seconds: float | None = None,
) -> DataFrame:
    """(name, options, loss), best first. Candidates run as concurrent Spark jobs over one kept table.
    None is started once the time budget is spent; those left have a NULL loss and come last."""
    spark = df.sparkSession
    held = df.persist()
    started = time.monotonic()

    def one(algorithm: Algorithm):
        spent = budget_seconds is not None and time.monotonic() - started > budget_seconds
        loss = None if spent else float(cv_loss(held, algorithm, label, key, features, folds))
        return (algorithm.name, _spelled(algorithm), loss)

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(one, candidates))
    finally:
        held.unpersist()
    losses = spark.createDataFrame(rows, "name string, options string, loss double")
    return losses.orderBy(F.col("loss").asc_nulls_last(), "name", "options")


def _spelled(algorithm: Algorithm) -> str:
    return str(dict(sorted(algorithm.input_variables.items())))


def hashed_share(key: str | Sequence[str], seed: int = 0) -> Column:
    """A number in [0, 1) per row, from the MD5 digest of the seed and the key columns, parted by ``|``."""
    keys = [key] if isinstance(key, str) else list(key)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


_RUNGS = "rung int, share double, name string, options string, loss double"


def successive_halving(
    df: DataFrame, candidates: Sequence[Algorithm], label: str, key: str | Sequence[str], features: Sequence[str],
    folds: int = 3, factor: int = 3, parallelism: int = 4, budget_seconds: float | None = None, table: str | None = None, seed: int = 0,
) -> DataFrame:
    """(rung, share, name, options, loss): all candidates on a hashed share of the rows, the best of them on ``factor`` times as
    many rows, and so on, until the last rung has all rows and at most ``factor`` candidates.

    The rows of a rung are among those of the next. Every candidate gets a loss on the first rung; no further rung begins once
    the time budget is spent. Losses are appended to the folder ``table`` rung by rung: a search that is started again with the same
    folder reads what is there and goes on. ``best_of_rungs`` picks the winner.
    """
    if factor < 2 or not candidates:
        raise ValueError("successive halving needs candidates and a factor of at least 2")
    spark = df.sparkSession
    started, rungs = time.monotonic(), max(1, math.ceil(math.log(len(candidates), factor) - 1e-9))
    place = hashed_share(key, seed)
    known: dict[tuple[int, str, str], float] = {}
    if table is not None:
        spark.createDataFrame([], _RUNGS).write.mode("append").parquet(table)
        known = {(r.rung, r.name, r.options): r.loss for r in spark.read.schema(_RUNGS).parquet(table).collect()}
    rows, left = [], list(candidates)
    for rung in range(rungs):
        if rung and budget_seconds is not None and time.monotonic() - started > budget_seconds:
            break
        share = float(factor) ** (rung - rungs + 1)
        held = (df if share >= 1 else df.where(place < share)).persist()

        def one(algorithm: Algorithm, rung=rung, held=held) -> float:
            found = known.get((rung, algorithm.name, _spelled(algorithm)))
            return float(cv_loss(held, algorithm, label, key, features, folds)) if found is None else found

        try:
            with ThreadPoolExecutor(parallelism) as pool:
                losses = list(pool.map(one, left))
        finally:
            held.unpersist()
        here = [(rung, share, a.name, _spelled(a), loss) for a, loss in zip(left, losses)]
        rows += here
        fresh = [r for r in here if (rung, r[2], r[3]) not in known]
        if table is not None and fresh:
            spark.createDataFrame(fresh, _RUNGS).coalesce(1).write.mode("append").parquet(table)
        ranked = sorted(range(len(left)), key=lambda i: (losses[i] != losses[i], losses[i], left[i].name, _spelled(left[i])))
        left = [left[i] for i in ranked[: max(1, len(left) // factor)]]
    return spark.createDataFrame(rows, _RUNGS)


def best_of_rungs(rungs: DataFrame, candidates: Sequence[Algorithm]) -> Algorithm:
    """The candidate with the smallest loss on the last rung."""
    last = rungs.agg(F.max("rung")).first()[0]
    return best(rungs.where(F.col("rung") == last), candidates)


def best(losses: DataFrame, candidates: Sequence[Algorithm]) -> Algorithm:
    """The candidate with the smallest loss."""
    top = losses.where("loss is not null").orderBy("loss", "name", "options").first()
    return next(a for a in candidates if a.name == top["name"] and _spelled(a) == top["options"])
