"""Helpers shared by the operators: narrow inputs, Arrow batches in pieces, tables written between steps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_folder

#: Rows and bytes of text that Python works on at a time.
PIECE_ROWS, PIECE_BYTES = 2_000, 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str):
    """A column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``narrow(df, id="doc_id", text="text")``.

    Other columns never reach an operator, so their names cannot clash with its own.
    """
    return df.select(*[quoted(old).alias(new) for new, old in columns.items()])


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds few rows and few bytes; one long text is a piece of its own."""
    start, held = 0, 0
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    for row, size in enumerate(lengths):
        size = size or 0
        if row > start and (held + size > PIECE_BYTES or row - start >= PIECE_ROWS):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


@contextmanager
def tidy() -> Iterator[None]:
    """Hand unused memory back to the machine at the end: a worker lives on for other tasks, next to other workers."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass


def per_piece(build: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text"):
    """A function for ``mapInArrow`` that works piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            for batch in batches:
                for piece in pieces(batch, text):
                    out = build(piece)
                    if out is not None and out.num_rows:
                        yield out

    return run


def written(df: DataFrame, stem: str) -> DataFrame:
    """Write to the shared folder of the cluster and read on from there.

    A later step reads files instead of computing again, also after the loss of an executor.
    """
    folder = scratch_folder(df.sparkSession, stem)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
