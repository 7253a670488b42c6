"""Per-key state across batches: gaps and cool-down. They agree with their batch twins on the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.columns import col
from millrace.operators.alerts import firing_times
from millrace.skew import micros


def gap_stream(df: DataFrame, keys: Sequence[str], ts: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``gap`` to a stream: change since the key's previous row, also across batches.

    A batch's rows of one key are put in (time, ties) order; the state is the last value. Between batches order of
    arrival counts: a row older than the last one of an earlier batch is compared with that one, like any other. Where
    rows come late, order them first or use ``rate_gap`` on the stored table. A batch's rows of a key are held at once.
    """
    order = ["__us", *ties]
    rows = df.withColumn("__us", micros(col(ts)))
    out_schema = T.StructType([*df.schema.fields, T.StructField("gap", T.DoubleType())])
    names = df.columns

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(chunks), ignore_index=True).sort_values(order, ignore_index=True)
        x = pdf[value].astype(float)
        before = x.shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((float(x.iloc[-1]),))
        yield pdf.assign(gap=x - before)[[*names, "gap"]]

    return rows.groupBy(*[col(k) for k in keys]).applyInPandasWithState(
        step, out_schema, T.StructType([T.StructField("last", T.DoubleType())]), "append", GroupStateTimeout.NoTimeout
    )


def cooldown_stream(
    df: DataFrame, keys: Sequence[str], ts: str, period_seconds: int = 120, ties: Sequence[str] = (), delay: str = "10 minutes"
) -> DataFrame:
    """Rows of a stream that fire under a cool-down; the state is the last firing time.

    Once the watermark passes the end of the silence the state is dropped, so it holds only keys that
    fired lately. Rows later than ``delay`` are not considered.
    """
    period = period_seconds * 1_000_000
    rows = df.withColumn("__us", micros(col(ts))).withWatermark(ts, delay)
    names = df.columns
    order = ["__us", *ties]

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(chunks), ignore_index=True).sort_values(order, ignore_index=True)
        first = pdf.drop_duplicates("__us", keep="first")
        times = first["__us"].to_numpy(np.int64)
        fired = firing_times(times, period, state.get[0] if state.exists else None)
        if len(fired):
            state.update((int(fired[-1]),))
        if state.exists:
            free = (state.get[0] + period) // 1000 + 1
            state.setTimeoutTimestamp(max(free, state.getCurrentWatermarkMs() + 1))
        yield first[np.isin(times, fired)][names]

    return rows.groupBy(*[col(k) for k in keys]).applyInPandasWithState(
        step, df.schema, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout
    )


def hop_average(df: DataFrame, keys: Sequence[str], ts: str, value: str, length: str = "10 seconds", hop: str = "1 second", delay: str = "10 minutes") -> DataFrame:
    """Mean per key over windows of ``length`` that start every ``hop``; emitted once the watermark closes them."""
    window = F.window(col(ts), length, hop)
    means = df.withWatermark(ts, delay).groupBy(*[col(k) for k in keys], window.alias("w")).agg(F.avg(col(value)).alias("average"))
    return means.select(*[col(k) for k in keys], F.col("w.start").alias("start"), F.col("w.end").alias("end"), "average")


def hop_alerts(df: DataFrame, keys: Sequence[str], ts: str, value: str, limit: float = 70.0, scale: float = 100.0, **options) -> DataFrame:
    return hop_average(df, keys, ts, value, **options).where(F.col("average") * scale > limit)
