"""Feature vectors per session from structured logs. A line may name several session ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, require
from millrace.functions.text import explode_ids
from millrace.operators.summary import value_list


def _pattern_total(df: DataFrame, pattern: str) -> int:
    return df.agg(F.max(col(pattern)).cast("long")).first()[0] or 0


def _pattern_aggs(pattern: str, patterns: int) -> list[Column]:
    return [F.count_if(col(pattern) == i).alias(f"pattern_{i}") for i in range(1, patterns + 1)]


def _state_aggs(df: DataFrame, states: Mapping[str, Sequence] | Sequence[str]) -> list[Column]:
    known = dict(states) if isinstance(states, Mapping) else {s: value_list(df, s) for s in require(df, states)}
    return [F.count_if(col(s) == v).alias(f"{s}={v}") for s, values in known.items() for v in values]


def _distinct_aggs(counts: Sequence[str]) -> list[Column]:
    return [F.countDistinct(col(c).cast("string")).alias(f"distinct_{c}") for c in counts]


def pattern_counts(df: DataFrame, session: str, pattern: str, patterns: int | None = None) -> DataFrame:
    """Lines of each pattern per id; patterns run 1..max and every one gets a column."""
    n = patterns if patterns is not None else _pattern_total(df, pattern)
    return explode_ids(df, session).groupBy("id").agg(*_pattern_aggs(pattern, n))


def state_counts(df: DataFrame, session: str, states: Mapping[str, Sequence] | Sequence[str]) -> DataFrame:
    """Lines per id for each value of each state column, as ``column=value``."""
    return explode_ids(df, session).groupBy("id").agg(*_state_aggs(df, states))


def session_distinct(df: DataFrame, session: str, counts: Sequence[str]) -> DataFrame:
    """Distinct non-missing values of each count column per id."""
    return explode_ids(df, session).groupBy("id").agg(*_distinct_aggs(counts))


def session_features(
    df: DataFrame,
    session: str,
    pattern: str,
    states: Mapping[str, Sequence] | Sequence[str] = (),
    counts: Sequence[str] = (),
    patterns: int | None = None,
) -> DataFrame:
    """All three feature families side by side by id, from one aggregation over the exploded lines."""
    n = patterns if patterns is not None else _pattern_total(df, pattern)
    aggs = _pattern_aggs(pattern, n) + _state_aggs(df, states) + _distinct_aggs(counts)
    return explode_ids(df, session).groupBy("id").agg(*aggs)
