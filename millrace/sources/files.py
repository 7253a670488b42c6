"""Readers and writers for delimited text, JSON, labelled file sets, matrices and GeoJSON."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import NA_SPELLINGS, col
from millrace.functions.text import base_name, parent_folder
from millrace.sources.ranges import numbered_lines, second_level_objects

#: Fixed value: white-space run, semicolon or comma.
ANY_SEPARATOR = r"\s+|;|,"


# --- delimited text -------------------------------------------------------------------------

def na_to_null(df: DataFrame) -> DataFrame:
    """The usual spellings of "missing" become NULL in string columns."""
    return df.select(
        [
            F.when(~F.trim(col(f.name)).isin(*NA_SPELLINGS), col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema
        ]
    )


#: How a number is written. A trailing D or F, which the cast would take, makes a code of it.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def infer_types(df: DataFrame) -> DataFrame:
    """Cast all-text columns to long, double or boolean where every present value allows it; one pass."""
    kinds = (("bigint", r"^\s*[+-]?\d+\s*$"), ("double", NUMBER), ("boolean", r"(?i)^\s*(true|false)\s*$"))
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(df.columns):
        for kind, shape in kinds:
            fits = col(c).try_cast(kind).isNotNull() & col(c).rlike(shape)
            aggs.append(F.count_if(fits).alias(f"{kind}{i}"))
    seen = df.agg(*aggs).first()

    def typed(i: int, name: str) -> Column:
        kind = next((k for k, _ in kinds if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]), None)
        return (col(name).try_cast(kind) if kind else col(name)).alias(name)

    return df.select([typed(i, c) for i, c in enumerate(df.columns)])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: str | T.StructType | None = None) -> DataFrame:
    """Delimited text with a header line. Without a schema the types are inferred after missing-value
    spellings are read as NULL, so a number column with ``NA`` stays a number column."""
    reader = spark.read.option("sep", sep).option("header", True)
    if schema is not None:
        return na_to_null(reader.schema(schema).csv(path))
    return infer_types(na_to_null(reader.csv(path)))


def read_typed(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """Delimited text of a known schema, with or without a header line."""
    options = {"sep": sep, "header": header, "dateFormat": date_format, "enforceSchema": True}
    return spark.read.options(**options).schema(schema).csv(path)


def read_regex_delimited(spark: SparkSession, path: str, regex: str = ANY_SEPARATOR, rest: str | None = None) -> DataFrame:
    """Lines split by a regular expression, quotes meaning nothing; the first line of each file names the columns.

    A line with more fields than that is an error, unless ``rest`` names a column for what is left over.
    """
    whole = spark.read.options(header=True, sep="\x01", quote="", escape="").csv(path)
    return split_lines(whole, whole.columns[0], regex, rest)


def split_lines(lines: DataFrame, header: str, regex: str = ANY_SEPARATOR, rest: str | None = None) -> DataFrame:
    """One text column named by the header line -> the columns it names, and ``rest``, an array of further fields (NULL: none)."""
    names = re.split(regex, header.strip())
    split = F.split(F.trim(col(header)), regex)
    if rest is None:
        more = F.concat(F.lit(f"more than {len(names)} fields in a line: "), col(header))
        split = F.when(F.size(split) > len(names), F.raise_error(more).cast("array<string>")).otherwise(split)
    parts = lines.select(split.alias("__p"))
    left = [F.when(F.size("__p") > len(names), F.slice("__p", len(names) + 1, F.size("__p"))).alias(rest)] if rest else []
    return parts.select([F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(names)] + left)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; NULL is an empty field."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """JSON lines; NULL fields are kept, ``compression="bzip2"`` makes an archive form."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.option("compression", compression) if compression else writer).json(path)


def read_json(spark: SparkSession, path: str, columns: Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines in a stated column order (JSON itself keeps none)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path).select([col(c) for c in columns])


def write_object_store(df: DataFrame, uri: str, fmt: str = "csv") -> str:
    """Write under a fresh name below ``uri`` (any file system Spark knows) and return it.

    Access follows the target's own policy; nothing is made public.
    """
    target = f"{uri.rstrip('/')}/{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(target)
    return target


def export_by_value(df: DataFrame, column: str, path: str, fmt: str = "csv") -> None:
    """One folder per value (a predicted class); each row lands under exactly one.

    ``column`` moves into the folder name. Rows are written where they are, so a large class needs no
    shuffle and ends up in as many files as the tasks that hold it.
    """
    df.write.partitionBy(column).format(fmt).option("header", True).save(path)


# --- file sets ------------------------------------------------------------------------------

def file_inventory(
    spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True
) -> DataFrame:
    """(relative_path, length, modified) of files that hold something; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    files = reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "^" + _literal(base) + "/", "")
    return files.select(relative.alias("relative_path"), "length", "modified").where("length > 0")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def to_transfer(inventory: DataFrame, already: DataFrame, sync: bool = True) -> DataFrame:
    """Files still to be moved; without ``sync`` existing names are moved again."""
    if not sync:
        return inventory
    return inventory.join(already.select("relative_path").distinct(), "relative_path", "left_anti")


def folder_metrics(spark: SparkSession, folder: str, modified_after: str, pattern: str | None = None) -> DataFrame:
    """File count, total bytes, files modified after a time, and lines of text, as one row.

    Empty files are counted, but their times are not looked at.
    """
    files = file_inventory(spark, folder, pattern)
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    text = reader.text(folder)
    lines = text.agg(F.count(F.lit(1)).alias("lines")).scalar()
    return files.agg(
        F.lit(len(text.inputFiles())).cast("long").alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("modified") > F.lit(modified_after).cast("timestamp")).alias("modified_since"),
    ).withColumn("lines", lines)


def _with_label_id(df: DataFrame, label: str) -> DataFrame:
    from millrace.operators.encode import apply_codes, label_codes

    return apply_codes(df, label, label_codes(df, label), "label_id")


def read_labelled_binary(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, length, label, label_id): the folder of a file is its label; dot files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder).select("path", "length", parent_folder(F.col("path")).alias("label"))
    return _with_label_id(files.where(~base_name(F.col("path")).startswith(".")), "label")


def read_labelled_text(
    spark: SparkSession, folder: str, charset: str = "UTF-8", labelled: bool = True, label_from: str = "folder"
) -> DataFrame:
    """(text, label): one row per line that holds text; the label is the folder's or the file's name."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("encoding", charset).text(folder)
        if charset.upper().replace("-", "") == "UTF8"
        else spark.read.options(recursiveFileLookup=True, encoding=charset, sep="\x01", quote="", escape="")
        .schema("value string").csv(folder)
    )
    path = F.col("_metadata.file_path")
    named = parent_folder(path) if label_from == "folder" else F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    label = named if labelled else F.lit("unlabeled")
    return lines.select(F.col("value").alias("text"), label.alias("label")).where(F.length(F.trim("text")) > 0)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """White-space matrix -> (i, j, value). Lines are numbered over the whole file, which is read in byte ranges."""
    cells = numbered_lines(spark, path).select("i", F.posexplode(F.split("line", r"\s+")).alias("j", "x"))
    return cells.select(F.col("i").cast("int").alias("i"), "j", F.col("x").cast("double").alias("value"))


# --- GeoJSON --------------------------------------------------------------------------------

_FEATURE = "type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>"
GEO_SCHEMA = f"features array<struct<{_FEATURE}>>"


def _axis(i: int):
    return lambda point: point[i]


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature: properties, outer ring, its points, and bounding box.

    ``lines`` reads one collection per line; otherwise each file is one document, read in byte ranges.
    """
    if lines:
        found = spark.read.schema(GEO_SCHEMA).json(path).select(F.explode("features").alias("f"))
    else:
        each = second_level_objects(spark, path).select(F.from_json("text", f"struct<{_FEATURE}>").alias("f"))
        found = each.where((F.col("f.type") == "Feature") | F.col("f.type").isNull() & F.col("f.geometry").isNotNull())
    ring = F.col("f.geometry.coordinates")[0]
    out = found.select(F.col("f.properties").alias("properties"), ring.alias("ring"))
    axis = {"x": 0, "y": 1}
    ends = {"1": F.array_min, "2": F.array_max}
    return out.withColumn("points", F.size("ring").cast("long")).withColumns(
        {a + e: pick(F.transform("ring", _axis(i))) for a, i in axis.items() for e, pick in ends.items()}
    )
