"""Running streams: triggers, several outputs from one input, and draining what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.session import scratch_folder


def trigger(polling_minutes: float | None) -> dict:
    """None: take what is there and stop. 0: react at once. Otherwise look every so many minutes."""
    if polling_minutes is None:
        return {"availableNow": True}
    return {"processingTime": f"{polling_minutes * 60:g} seconds"}


@contextmanager
def _store(stream: DataFrame) -> Iterator[None]:
    """States with timers need RocksDB: a query with one, started inside, keeps its state there. Others keep the session's store."""
    name, conf = "spark.sql.streaming.stateStore.providerClass", stream.sparkSession.conf
    before = conf.get(name)
    if "TransformWithState" in stream._jdf.queryExecution().analyzed().toString():
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        conf.set(name, before)


def start_table(
    stream: DataFrame, path: str, checkpoint: str, polling_minutes: float | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Append a stream to files, exactly once."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    with _store(stream):
        return writer.trigger(**trigger(polling_minutes)).start(path)


def start_fanout(
    stream: DataFrame,
    outputs: Mapping[str, tuple[Callable[[DataFrame], DataFrame], str]],
    checkpoint: str,
    polling_minutes: float | None = None,
) -> StreamingQuery:
    """One input, several outputs: ``{name: (transformation, folder)}``.

    Each batch is computed once and kept while its outputs are written. A batch goes to a folder of
    its own number and replaces it, so a batch run again after a failure does not double its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for transform, folder in outputs.values():
                transform(held).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with _store(stream):
        return writer.trigger(**trigger(polling_minutes)).start()


def drain(
    spark: SparkSession, stream: DataFrame, stem: str = "stream", close: Callable[[], None] | None = None, feeds: Sequence[Callable[[], None]] = ()
) -> DataFrame:
    """Run a stream over all input present, then return its output as a table.

    With ``feeds`` each of them brings more input, and the stream takes it before the next one is called.
    With ``close`` (from ``ordered.closable``) the stream then ends: waiting rows and open windows come out as well.
    """
    path, checkpoint = scratch_folder(spark, stem), scratch_folder(spark, f"{stem}-progress")
    steps = [*feeds, *([close] if close else [])]
    if not feeds:
        start_table(stream, path, checkpoint).awaitTermination()
    for step in steps:
        step()
        start_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
