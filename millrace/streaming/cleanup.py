"""Delete the files of a stream once what was read from them is committed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.streaming.run import start_table


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _lines(spark: SparkSession, file: str) -> list[str]:
    return spark.read.text(file, wholetext=True).first()[0].splitlines()


def committed_files(spark: SparkSession, checkpoint: str, source: int = 0, after: int = -1) -> tuple[list[str], int]:
    """Files that committed batches of a query have read, from its progress folder, and how far its file log is committed.

    ``source``: which of the query's inputs, in order; ``after``: leave out what an earlier call has told up to there.
    """
    batches = [int(n) for n in _names(spark, f"{checkpoint}/commits") if n.isdigit()]
    if not batches:
        return [], after
    # a batch's entry: a version, settings, then a line for each input
    line = _lines(spark, f"{checkpoint}/offsets/{max(batches)}")[2 + source]
    if line == "-":
        return [], after
    until = int(json.loads(line)["logOffset"])
    found: dict[str, None] = {}
    for name in _names(spark, f"{checkpoint}/sources/{source}"):
        number = name.removesuffix(".compact")
        if number.isdigit() and (name != number or after < int(number) <= until):
            for entry in map(json.loads, _lines(spark, f"{checkpoint}/sources/{source}/{name}")[1:]):
                if after < entry["batchId"] <= until:
                    found[entry["path"]] = None
    return list(found), until


def delete_committed(spark: SparkSession, checkpoint: str, source: int = 0, after: int = -1) -> tuple[int, int]:
    """Delete them. ``(files deleted, how far)``; files of a batch that failed or still runs stay."""
    files, until = committed_files(spark, checkpoint, source, after)
    deleted = 0
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(file))
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False))
    return deleted, until


def delete_while_running(query: StreamingQuery, spark: SparkSession, checkpoint: str, source: int = 0, every_seconds: int = 60) -> int:
    """Delete committed files until the query ends, and once more then, also if it ends in an error. Files deleted in all."""
    total, after = 0, -1
    try:
        while not query.awaitTermination(every_seconds):
            deleted, after = delete_committed(spark, checkpoint, source, after)
            total += deleted
    finally:
        total += delete_committed(spark, checkpoint, source, after)[0]
    return total


def drain_and_delete(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append all that is there to files, then delete what was read; the number of files deleted. The first input is a file drop."""
    return delete_while_running(start_table(stream, path, checkpoint), spark, checkpoint)
