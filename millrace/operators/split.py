"""Exact, repeatable splits by hashed key.

Rows are ordered by a hash of their key. Only counts per hash slice are shuffled to find the slice
each cut falls into; only the rows of those slices are then ranked. All other rows are placed by
comparing their slice number, without moving.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import col, name_list, require
from millrace.session import fitted
from millrace.skew import join_back

#: 16 leading hash bits: a slice holds about 1/65,536 of the rows.
SLICE_BITS = 16


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """60-bit hash of key and seed that rows are ordered by."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def assign_parts(
    df: DataFrame,
    keys: Sequence[str],
    strata: Sequence[str],
    cuts: Callable[[Column], Sequence[Column]],
    parts: Sequence[str | None],
    seed: int = 0,
) -> DataFrame:
    """Add ``part``: within each stratum of n rows, ``cuts(n)`` are the ranks where one part ends.

    Ranks follow the hash, ties a hash of the whole row. Rows whose part is None are dropped.
    """
    require(df, [*keys, *strata])
    by = [col(s) for s in strata]
    hashed = df.withColumn("__h", hash_order(keys, seed)).withColumn("__s", F.shiftright("__h", 60 - SLICE_BITS))
    sizes = hashed.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    in_order = Window.partitionBy(*by).orderBy("__s")
    runs = sizes.select(
        *by, "__s",
        F.sum("__n").over(in_order).alias("__end"),
        (F.sum("__n").over(in_order) - F.col("__n")).alias("__base"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__total"),
    )  # at most 65,536 rows per stratum
    ends = cuts(F.col("__total"))
    found = [
        F.struct(
            F.max(F.when((F.col("__base") < e) & (e <= F.col("__end")), F.col("__s"))).alias("s"),
            F.max(F.when((F.col("__base") < e) & (e <= F.col("__end")), e - F.col("__base"))).alias("take"),
        )
        for e in ends
    ]
    borders = runs.groupBy(*by).agg(F.array(*found).alias("__cuts")) if strata else runs.agg(F.array(*found).alias("__cuts"))
    borders = fitted(borders)  # one row per stratum

    placed = join_back(hashed, borders, strata)
    on_border = F.exists("__cuts", lambda c: c["s"] == F.col("__s"))
    order = Window.partitionBy(*by, "__s").orderBy("__h", F.xxhash64(*[col(c) for c in df.columns]))
    ranked = placed.where(on_border).withColumn("__rank", F.row_number().over(order))
    rest = placed.where(~F.coalesce(on_border, F.lit(False))).withColumn("__rank", F.lit(1))
    # A cut of 0 rows has no border slice: every row lies past it.
    past = F.aggregate(
        "__cuts",
        F.lit(0),
        lambda n, c: n
        + F.when(c["s"].isNull() | (F.col("__s") > c["s"]), 1)
        .when((F.col("__s") == c["s"]) & (F.col("__rank") > c["take"]), 1)
        .otherwise(0),
    )
    names = F.array(*[F.lit(p).cast("string") for p in parts])
    out = ranked.unionByName(rest).withColumn("part", F.get(names, past))
    return out.where(F.col("part").isNotNull()).select(*[col(c) for c in df.columns], "part")


def split_train_test(df: DataFrame, key: str | Sequence[str], train_share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(n × test share) test rows."""
    both = train_test_parts(df, key, train_share, seed)
    return both.where("part = 'train'").drop("part"), both.where("part = 'test'").drop("part")


def train_test_parts(df: DataFrame, key: str | Sequence[str], train_share: float = 0.7, seed: int = 0) -> DataFrame:
    if not 0 <= train_share <= 1:
        raise ValueError("the train share must lie in 0..1")
    test = round(1 - train_share, 12)
    return assign_parts(df, name_list(key), [], lambda n: [F.ceil(n * F.lit(test))], ["test", "train"], seed)


def split_stratified(
    df: DataFrame,
    key: str | Sequence[str],
    label: str,
    shares: tuple[float, float, float],
    toy_rows: int | None = None,
    classes: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Train, validation and test by class; in toy mode each class gives at most ``toy_rows / classes`` rows."""
    train, validation, test = shares
    if abs(train + validation + test - 1) > 1e-9:
        raise ValueError("the shares must add up to 1")
    cap = None
    if toy_rows is not None:
        if classes is None:
            classes = df.select(col(label)).distinct().count()
        cap = toy_rows // classes

    def cuts(n: Column) -> list[Column]:
        size = F.least(n, F.lit(cap)) if cap is not None else n
        return [F.floor(size * F.lit(train)), F.floor(size * F.lit(round(train + validation, 12))), size]

    return assign_parts(df, name_list(key), [label], cuts, ["train", "validation", "test", None], seed)


def split_nested(
    df: DataFrame, key: str | Sequence[str], test_share: float, validation_share: float, seed: int = 0
) -> DataFrame:
    """Test first, then validation from what is left, so its share is of the remainder."""

    def cuts(n: Column) -> list[Column]:
        test = F.ceil(n * F.lit(test_share))
        return [test, test + F.ceil((n - test) * F.lit(validation_share))]

    return assign_parts(df, name_list(key), [], cuts, ["test", "validation", "train"], seed)
