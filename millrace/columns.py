"""Column-name lists and missing-value rules shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings read as missing in delimited text.
NA_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def name_list(names: str | Iterable[str], sep: str = ",") -> list[str]:
    """``"a, b"`` or a sequence of names -> trimmed list."""
    parts = names.split(sep) if isinstance(names, str) else list(names)
    out = [p.strip() for p in parts]
    if not any(out):
        raise ValueError("at least one column name is needed")
    return out


def require(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Check that every name exists; return them as a list."""
    names = list(names)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; the table has {df.columns}")
    return names


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col(quoted(name))


def finite_or_null(name: str, dtype: T.DataType, infinite: bool = True) -> Column:
    """NaN (and, on request, the infinities) become NULL; other types pass unchanged."""
    c = col(name)
    if not is_float(dtype):
        return c
    bad = F.isnan(c)
    if infinite:
        bad = bad | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c).alias(name)


def normalize_missing(df: DataFrame, infinite: bool = False) -> DataFrame:
    """Replace NaN, and with ``infinite`` also +-inf, by NULL in every floating column."""
    return df.select([finite_or_null(f.name, f.dataType, infinite).alias(f.name) for f in df.schema])


def fresh_name(df_or_names, stem: str) -> str:
    """A helper-column name that does not clash with existing columns."""
    taken = set(getattr(df_or_names, "columns", df_or_names))
    name = stem
    while name in taken:
        name = "_" + name
    return name
