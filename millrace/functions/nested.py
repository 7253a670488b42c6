"""JSON, map and array functions on Columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    """One field of a JSON text by path (``$.a.b``), cast; NULL when absent or not of that kind."""
    return F.get_json_object(text, path).try_cast(kind)


def json_map(text: Column, value_kind: str = "string") -> Column:
    return F.from_json(text, f"map<string,{value_kind}>")


def invert_map(mapping: Column) -> Column:
    """Keys and values swapped; codes are taken to be unique."""
    return F.map_from_entries(
        F.transform(F.map_entries(mapping), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    )


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def array_product(a: Column, b: Column) -> Column:
    """Element-wise product."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def search_space(documents: DataFrame, text: str, keys: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Parameter rows of search-space documents: per object the product of its choices, objects stacked.

    A document is a JSON array of objects; a key holds ``{"choice": [...]}`` or one plain value. Keys
    that begin with ``_`` are ignored; a key an object lacks is NULL there.
    """
    spaces = documents.withColumn("__space", F.explode(F.from_json(col(text), "array<map<string,string>>")))
    if keys is None:
        found = spaces.select(F.explode(F.map_keys("__space")).alias("k")).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"more than {limit} keys in the search space")
        keys = sorted(r["k"] for r in found)
    out = spaces
    for k in [k for k in keys if not k.startswith("_")]:
        raw = F.try_element_at("__space", F.lit(k))
        choices = F.coalesce(F.from_json(raw, "struct<choice:array<string>>")["choice"], F.array(raw))
        out = out.withColumn(k, F.explode(choices))
    return out.drop("__space", text)
