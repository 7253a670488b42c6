"""Stream inputs: message topics, file drops and newly arrived files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import base_name


def message_stream(spark: SparkSession, fmt: str = "kafka", options: Mapping[str, str] | None = None, from_start: bool = True) -> DataFrame:
    """Text messages of a topic as (key, value, ts). Progress lives in the query's checkpoint, so a
    restart neither rereads nor skips; ``from_start`` only decides where a new query begins."""
    start = {"startingOffsets": "earliest" if from_start else "latest"} if fmt == "kafka" else {}
    raw = spark.readStream.format(fmt).options(**start, **(options or {})).load()
    return raw.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts")
    )


def record_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", pattern: str | None = None,
    files_per_batch: int | None = None, delete_after: bool = False,
) -> DataFrame:
    """Rows of files as they arrive; ``delete_after`` removes a file once its rows are committed."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if delete_after:
        reader = reader.option("cleanSource", "delete")
    return reader.load(folder)


def new_files(
    spark: SparkSession, folder: str, name_regex: str | None = None, sub_folders: bool = True,
    files_per_batch: int | None = None, delete_after: bool = False,
) -> DataFrame:
    """(path, length, modified) of each file once; the checkpoint remembers what was seen."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", sub_folders)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if delete_after:
        reader = reader.option("cleanSource", "delete")
    files = reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.where(base_name(F.col("path")).rlike(f"^(?:{name_regex})$")) if name_regex else files


def extract_rate(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON payload ``{"key", "ts", "rate"}`` -> columns; malformed payloads give NULLs and are left out."""
    parsed = messages.select(F.from_json(value, "key string, ts timestamp, rate double").alias("p")).select("p.*")
    return parsed.where(F.col("rate").isNotNull())
