"""String and path functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col

#: Words read as true and as false.
TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")


def split_ids(text: Column) -> Column:
    """Ids separated by single spaces; empty ones are left out."""
    return F.array_remove(F.split(text, " "), "")


def explode_ids(df: DataFrame, column: str, out: str = "id") -> DataFrame:
    """One row per id named in ``column``."""
    return df.withColumn(out, F.explode(split_ids(col(column))))


def split_trim(text: Column, sep: str = ",", omit_empty: bool = True) -> Column:
    """Separated list -> array of trimmed items."""
    items = F.transform(F.split(text, f"\\Q{sep}\\E"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "") if omit_empty else items


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def url_port(url: Column) -> Column:
    """Port number, NULL when the URL names none."""
    text = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+:([0-9]+)", 1)
    return F.nullif(text, F.lit("")).cast("int")


def base64_decode(text: Column) -> Column:
    """Base64 -> UTF-8 text; empty input is skipped (NULL)."""
    return F.when(text != "", F.decode(F.unbase64(text), "UTF-8"))


def base64_encode(text: Column) -> Column:
    """One line of base64, however long (Spark may break lines at 76 characters)."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without a dot."""
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def parent_folder(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def key_values(lines: DataFrame, text: str, position: str, sep: str = "=") -> DataFrame:
    """``key = value`` lines -> (key, value); other lines are ignored and later lines win."""
    parts = F.split(F.trim(col(text)), rf"\s*{sep}\s*")
    pairs = lines.select(parts.alias("p"), col(position).alias("at")).where(F.size("p") == 2)
    return pairs.groupBy(F.col("p")[0].alias("key")).agg(F.max_by(F.col("p")[1], F.col("at")).alias("value"))


def truth(word: Column) -> Column:
    """Truth words to boolean; an unknown word gives NULL."""
    w = F.lower(F.trim(word))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def with_truth(df: DataFrame, column: str, out: str = "truth") -> DataFrame:
    """Add the boolean and an ``error`` text for words that are neither."""
    value = truth(col(column))
    return df.withColumn(out, value).withColumn(
        "error", F.when(value.isNull(), F.concat(F.lit("invalid truth value "), col(column)))
    )


def tokens(text: Column) -> Column:
    """Lower-cased words separated by white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
