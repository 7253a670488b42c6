"""Two-table operators. No side is broadcast unless its size is bounded or has been checked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, require
from millrace.session import fitted


def merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on one key; missing keys match each other, clashing names get ``_x`` / ``_y``.

    Written as inner + two anti joins: adaptive execution can split a hot key on either side of
    those, but on neither side of a full outer join. The anti joins see the other side's distinct
    keys only.
    """
    require(left, [key])
    require(right, [key])
    shared = (set(left.columns) & set(right.columns)) - {key}
    lcols = {c: f"{c}_x" if c in shared else c for c in left.columns if c != key}
    rcols = {c: f"{c}_y" if c in shared else c for c in right.columns if c != key}
    lt = left.select(col(key), *[col(c).alias(n) for c, n in lcols.items()])
    rt = right.select(col(key).alias("__rk"), *[col(c).alias(n) for c, n in rcols.items()])

    both = lt.join(rt, col(key).eqNullSafe(F.col("__rk")), "inner").drop("__rk")
    left_only = lt.join(rt.select("__rk").distinct(), col(key).eqNullSafe(F.col("__rk")), "left_anti")
    left_keys = lt.select(col(key).alias("__lk")).distinct()
    right_only = rt.join(left_keys, F.col("__rk").eqNullSafe(F.col("__lk")), "left_anti").withColumnRenamed("__rk", key)
    return both.unionByName(left_only, allowMissingColumns=True).unionByName(right_only, allowMissingColumns=True)


def merge_sorted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``merge`` ordered by the key, missing keys last.

    The hash behind the key lets range partitioning cut through a run of equal keys.
    """
    out = merge(left, right, key)
    return out.orderBy(col(key).asc_nulls_last(), F.xxhash64(*[col(c) for c in out.columns]))


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Replace (or add as ``out``) a column by its dictionary value; unseen values give NULL."""
    pairs = table.select(col(key).alias("__k"), col(value).alias("__v"))
    pairs = fitted(pairs)
    joined = df.join(pairs, col(column).eqNullSafe(F.col("__k")), "left")
    name = out or column
    return joined.withColumn(name, F.col("__v")).drop("__k", "__v")


def lookup_map(df: DataFrame, column: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Dictionary lookup for a small literal map."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out or column, F.try_element_at(entries, col(column)))


def new_keys(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the seen set."""
    known = seen.select(col(key).alias("__seen")).distinct()
    return df.join(known, col(key) == F.col("__seen"), "left_anti")


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Target rows overwritten by changes with the same key, plus the new keys.

    Changes must hold a key once (``duplicate_keys`` finds offenders).
    """
    kept = target.join(changes.select(col(key).alias("__c")).distinct(), col(key) == F.col("__c"), "left_anti")
    return kept.unionByName(changes.select([col(c) for c in target.columns]))


def last_write(changes: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The newest change per key, map-side combined."""
    rest = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(v) for v in version]))
    return changes.groupBy(col(key)).agg(newest.alias("__r")).select(col(key), "__r.*").select(
        [col(c) for c in changes.columns]
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(col(key)).count().where("count > 1")


def scenario_grid(df: DataFrame, start: str, end: str, step_months: int, shocks: Sequence[float]) -> DataFrame:
    """Each row × evaluation date × yield shock. Both ranges are inclusive and unfold inside the row."""
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_ym_interval(F.lit(0), F.lit(step_months)))
    return df.withColumn("eval_date", F.explode(dates)).withColumn(
        "shock", F.explode(F.array(*[F.lit(float(s)) for s in shocks]))
    )


def shock_range(start: float, end: float, step: float) -> list[float]:
    """Inclusive arithmetic range."""
    n = int(round((end - start) / step))
    return [round(start + i * step, 12) for i in range(n + 1)]


def pair_by_name(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Join two file lists on the file name without folder and extension."""
    from millrace.functions.text import base_name, stem

    lt = left.select(col(path).alias("left_path"), stem(base_name(col(path))).alias("name"))
    rt = right.select(col(path).alias("right_path"), stem(base_name(col(path))).alias("name"))
    return lt.join(rt, "name")


def align_by_id(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature tables side by side by id: the union of ids; what a table lacks stays NULL.

    Each table has one row per id, so stacking and one aggregation replace a chain of outer joins.
    """
    stacked = tables[0]
    for t in tables[1:]:
        stacked = stacked.unionByName(t, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c != key]
    return stacked.groupBy(col(key)).agg(*[F.first(col(c), ignorenulls=True).alias(c) for c in rest])


__all__ = [
    "align_by_id", "duplicate_keys", "last_write", "lookup", "lookup_map", "merge", "merge_sorted",
    "new_keys", "pair_by_name", "scenario_grid", "shock_range", "upsert",
]
