"""Session helpers: the package on the workers, the checkpoint folder, materialised stage outputs and
size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, in rows and in bytes, that may be sent whole to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64_000_000

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_scratch: dict[str, SparkSession] = {}
_temporary: list[str] = []


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "millrace") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make the package known to the session's workers, once per application.

    Nothing is sent where they find it by themselves: by ``PYTHONPATH`` or, on one machine, in the working folder.
    """
    sc = spark.sparkContext
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in paths or (sc.master.startswith("local[") and Path.cwd() == _ROOT) or sc.applicationId in _shipped:
        return spark
    folder = tempfile.mkdtemp(prefix="millrace-package-")
    _temporary.append(folder)
    with zipfile.ZipFile(f"{folder}/millrace.zip", "w") as packed:
        for file in sorted((_ROOT / "millrace").rglob("*.py")):
            packed.write(file, file.relative_to(_ROOT))
    sc.addPyFile(f"{folder}/millrace.zip")
    _shipped.add(sc.applicationId)
    return spark


def _remove_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def remove_scratch() -> None:
    """Remove what this process has written beside the checkpoints; runs by itself at the end."""
    for folder, spark in list(_scratch.items()):
        try:
            _remove_folder(spark, folder)
        except Exception:  # the session may be gone; its folder on one machine is removed below
            pass
        _scratch.pop(folder, None)
    for folder in _temporary:
        shutil.rmtree(folder, ignore_errors=True)
    _temporary.clear()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        _temporary.append(configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, stem: str) -> str:
    """A fresh folder name beside the checkpoints, on storage every executor reaches; removed at the end."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    _scratch[folder] = spark
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read on from there.

    The result survives the loss of executors and is computed from the same files however often it
    is read, so values that depend on row placement stay fixed.
    """
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def _row_bytes(df: DataFrame) -> Column | None:
    """Bytes of a row's texts and arrays; None if all columns have a fixed size."""
    parts = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            parts.append(F.length(F.to_json(F.struct(c))))
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)) if parts else None


def pin(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Compute a table of fitted values once; also tell whether it is small.

    Up to ``max_rows`` rows of together ``max_bytes`` bytes become a local table, marked for broadcast. A larger
    table goes to the checkpoint folder and is joined by shuffle, where adaptive execution splits skewed keys.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        few, size = held.limit(max_rows + 1), _row_bytes(df)
        small = size is None or (few.agg(F.sum(size)).first()[0] or 0) <= max_bytes
        rows = few.toArrow() if small else None
        if small and rows.num_rows <= max_rows:
            return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True
        checkpoint_dir(df.sparkSession)
        return held.checkpoint(eager=True), False
    finally:
        held.unpersist()


def fitted(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pinned table alone."""
    return pin(df, max_rows)[0]


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by key over the session's shuffle partitions, ahead of grouped Python work.

    Partitions small in bytes may still be heavy in Python, so they are not to be merged at run time;
    the grouping that follows needs no further shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *[F.col("`" + k.replace("`", "``") + "`") for k in keys])


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, ahead of heavy work per row: a table small in bytes is read in one or two pieces."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def at_most(df: DataFrame, rows: int) -> bool:
    """Does the table hold no more than ``rows`` rows? Reads about that many rows, not the table."""
    return df.limit(rows + 1).count() <= rows
