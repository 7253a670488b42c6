"""Exchange-rate stream: one topic fanned out to rates, gaps and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.series import gap_alerts
from millrace.streaming.run import start_fanout
from millrace.streaming.stateful import gap_stream


def start_exchange(
    ticks: DataFrame, rates: str, gaps: str, alerts: str, checkpoint: str,
    key: str = "key", ts: str = "ts", rate: str = "rate", threshold: float = 50.0, ties=(), polling_minutes: float | None = None,
) -> StreamingQuery:
    """Write (key, ts, rate), the gaps between successive rates, and the gaps beyond the threshold."""
    with_gap = gap_stream(ticks, [key], ts, rate, ties)
    return start_fanout(
        with_gap,
        {
            "rate": (lambda df: df.select(key, ts, rate), rates),
            "gap": (lambda df: df.where("gap is not null"), gaps),
            "alert": (lambda df: gap_alerts(df, "gap", threshold), alerts),
        },
        checkpoint,
        polling_minutes,
    )
