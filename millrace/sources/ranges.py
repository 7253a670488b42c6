"""Big text documents read in byte ranges: places in the whole document from sums over the ranges before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import materialize


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(file, start, at, s)``: what stands between separators; ``start`` is where its byte range begins in the file, and ``at`` grows
    inside a range."""
    text = spark.read.option("lineSep", separator).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return text.select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("s"))


def sums_before(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``<name>_before``: the sum of a column over all fragments that come before in the file.

    Sums run inside each range and, over a table with one row per range, across them.
    """
    ranges = df.groupBy("file", "start").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "start", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in names])
    inside = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}).join(ranges, ["file", "start"])
    return summed.withColumns({f"{n}_before": F.col(f"{n}_before") + F.col(f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, i, line)``: the lines of each file that are not blank, trimmed and numbered from 0, however the file is cut."""
    lines = fragments(spark, path, "\n").select("file", "start", "at", F.trim(F.regexp_replace("s", r"[\r\t]", " ")).alias("line")).where("line != ''")
    return sums_before(lines.withColumn("n", F.lit(1).cast("long")), ["n"]).select("file", F.col("n_before").alias("i"), "line")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _opening(s: Column, quoted: Column, k: Column) -> Column:
    """Where the first or second (``k``) opening brace outside strings stands in a fragment, from 1."""
    parts = F.split(s, '"')  # of these every other one lies inside a string
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), quoted.alias("inside"), F.lit(0).alias("found"))

    def step(a: Column, part: Column) -> Column:
        here = F.when(a.inside, 0).otherwise(_count(part, "{"))
        place = a.at + 1 + F.when(k - a.seen == 1, F.length(F.substring_index(part, "{", 1))).otherwise(F.length(F.substring_index(part, "{", 2)))
        found = F.when((a.found == 0) & (a.seen + here >= k), place).otherwise(a.found)
        return F.struct((a.at + F.length(part) + 1).alias("at"), (a.seen + here).alias("seen"), (~a.inside).alias("inside"), found.alias("found"))

    return F.aggregate(parts, begin, step, lambda a: a.found)


def second_level_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, text)``: the objects inside the outermost object of each JSON document, whatever its size.

    The text is cut at closing braces. Quotes before a fragment tell whether it begins inside a string, braces before
    it how deep it lies, and openings before it which object it belongs to; each is a sum over all that comes before. An
    object's fragments then meet and are joined in order.
    """
    raw = fragments(spark, path, "}")
    plain = F.regexp_replace("s", r"\\.", "__")  # no escapes, the same length
    quotes = raw.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"').cast("long"))
    found = sums_before(materialize(quotes), ["quotes"])
    quoted = F.col("quotes_before") % 2 == 1
    outside = F.regexp_replace(F.when(quoted, F.concat(F.lit('"'), "plain")).otherwise(F.col("plain")), '"[^"]*("|$)', "")
    found = found.withColumns({
        "quoted": quoted,
        "opens": _count(outside, "{").cast("long"),
        "closes": ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("long"),
    })
    # a fragment's brace closes after what it opens
    found = sums_before(materialize(found.withColumn("net", F.col("opens") - F.col("closes"))), ["net"])
    depth = F.col("net_before")
    found = found.withColumn("begins", ((depth <= 1) & (depth + F.col("opens") >= 2)).cast("long"))
    found = sums_before(materialize(found), ["begins"])
    inside = found.where((depth >= 2) | (F.col("begins") == 1))
    cut = F.when(F.col("begins") == 1, _opening(F.col("plain"), F.col("quoted"), (2 - depth).cast("int"))).otherwise(1)
    own = inside.select("file", (F.col("begins_before") + F.col("begins")).alias("number"), "start", "at", F.substr("s", cut).alias("s"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("start", "at", "s"))), lambda x: x.s)
    return own.groupBy("file", "number").agg(F.concat(F.array_join(pieces, "}"), F.lit("}")).alias("text"))
