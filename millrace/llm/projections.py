"""Near-duplicate vectors by sorted passes over random projections.

1. Equal vectors of a label are one row, with their number.
2. A pass gives each vector a key of ``BITS`` signs of random projections, sorts the table by label and key, and compares each row
   with the ``WINDOW`` rows after it, in numpy, by the cosine in double precision. Rows are sorted by ranges over the whole
   table; rows near a border of two parts are compared again around it, so windows do not depend on the layout. What a task finds
   is handed on as a forest: a link from each row to the first row of its group.
3. The forests of all passes are united by joins into components.
4. Windows are bounded, groups are not: inside each component all vectors are compared in square blocks, which count the
   links of each vector without writing out a pair.

The number of passes follows from the rows of the largest label (``passes_for``), so a pair at the threshold is found about
as surely in a large table as in a small one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, written
from millrace.llm.components import components

COSINE, RECALL = 0.93, 0.99
#: Rows after each row that a pass compares it with; signs in a key; passes that are sorted at once.
WINDOW, BITS, AT_ONCE = 64, 32, 4
#: Rows that are compared in one step; vectors on a side of a block inside a component; rows a part should hold.
STEP, SIDE, PART_ROWS = 4_096, 2_048, 50_000
SEED = 11


def passes_for(rows: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which two vectors at the threshold have been neighbours with probability ``recall``.

    Two such vectors agree in a sign with probability ``1 - angle / pi``. They come within a window if their
    first ``log2(rows / window)`` signs agree.
    """
    agree = 1 - math.acos(cosine) / math.pi
    met = agree ** max(0.0, math.log2(max(rows, 1) / window))
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def _planes(turn: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, turn, dim]).standard_normal((dim, BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat / np.abs(flat).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(flat).max(axis=1, keepdims=True)


def _runs(values: list) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch of equal values."""
    start = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[start]:
            yield start, k
            start = k


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a[k] - b[k]`` among ``n`` rows as one link from each row to the first of its group."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    away = np.flatnonzero(root != np.arange(n))
    return away, root[away]


def window_links(groups: np.ndarray, unit: np.ndarray, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of one group at most ``window`` rows apart with the cosine or more."""
    a, b = [], []
    for step in range(1, min(window, len(groups) - 1) + 1):
        same = np.flatnonzero(groups[step:] == groups[:-step])
        if not len(same):
            break  # rows are sorted by group
        near = same[np.einsum("ij,ij->i", unit[same], unit[same + step]) >= cosine]
        a.append(near)
        b.append(near + step)
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_LINKS = "u long, v long"


def _links_of(batch: pa.Table, window: int, cosine: float) -> pa.Table:
    """Links inside sorted rows ``(grp, dim, node, vec)``."""
    u, v = [], []
    nodes = batch.column("node").to_numpy()
    grp = batch.column("grp").combine_chunks().dictionary_encode().indices.to_numpy()
    vecs = batch.column("vec").combine_chunks()
    for start, end in _runs(batch.column("dim").to_pylist()):
        a, b = window_links(grp[start:end], _matrix(vecs.slice(start, end - start)), window, cosine)
        if len(a):
            x, y = forest(a, b, end - start)
            u.append(nodes[start + x])
            v.append(nodes[start + y])
    return (np.concatenate(u), np.concatenate(v)) if u else (nodes[:0], nodes[:0])


def pass_links(vectors: DataFrame, turns: list[int], rows: int, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """``(u, v)``: what the given passes find among ``vectors(node, label, dim, vec)`` (label a string)."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec"].dataType.simpleString()
    names = ["grp", "dim", "key", "node", "vec"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column("dim").to_numpy(), kind="stable")))
            for start, end in _runs(batch.column("dim").to_pylist()):
                part = batch.slice(start, end - start)
                unit, dim = _matrix(part.column("vec")), part.column("dim")[0].as_py()
                for turn in turns:
                    signs = (unit @ _planes(turn, dim)) > 0
                    key = signs.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    grp = pa.array([f"{turn}:{dim}:{x}" for x in part.column("label").to_pylist()])
                    yield pa.RecordBatch.from_arrays([grp, part.column("dim"), pa.array(key), part.column("node"), part.column("vec")], names=names)

    parts = max(1, math.ceil(rows * len(turns) / PART_ROWS))
    order = ["grp", "key", "node"]
    laid = vectors.select("node", "label", "dim", "vec").mapInArrow(keyed, f"grp string, dim int, key long, node long, vec {kind}")
    laid = laid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shape = [("pid", pa.int32()), ("at", pa.int64()), ("u", pa.int64()), ("v", pa.int64())]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, tail, fresh = TaskContext.get().partitionId(), 0, None, None

        def made(u, v, where, rows: pa.Table | None) -> pa.RecordBatch:
            n = len(u) if rows is None else rows.num_rows
            columns = [pa.array(np.full(n, pid, dtype=np.int32))]
            columns += [pa.nulls(n, pa.int64()), pa.array(u), pa.array(v)] if rows is None else [pa.array(where), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            held = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.int64(), vec_type)] if rows is None else [rows.column(c).combine_chunks() for c in ("grp", "dim", "node", "vec")]
            return pa.RecordBatch.from_arrays(columns + held, names=[c for c, _ in shape] + ["grp", "dim", "node", "vec"])

        for batch in batches:
            vec_type = batch.schema.field("vec").type
            for k in range(0, batch.num_rows, STEP):
                step = pa.Table.from_batches([batch.slice(k, STEP)]).select(["grp", "dim", "node", "vec"])
                if at < window:  # rows near the part's start
                    first = step.slice(0, window - at)
                    yield made(None, None, np.arange(at, at + first.num_rows), first)
                held = step if tail is None else pa.concat_tables([tail, step])
                u, v = _links_of(held, window, cosine)
                if len(u):
                    yield made(u, v, None, None)
                at += step.num_rows
                tail = held.slice(max(0, held.num_rows - window))
        if tail is not None:
            last = tail.slice(max(0, tail.num_rows - max(0, at - window)))  # those not handed on above
            if last.num_rows:
                yield made(None, None, np.arange(at - last.num_rows, at), last)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((pid, at, -1, -1), shape)] + [pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.int64(), vec_type)], names=[c for c, _ in shape] + ["grp", "dim", "node", "vec"])

    found = written(laid.mapInArrow(scanned, f"pid int, at long, u long, v long, grp string, dim int, node long, vec {kind}"), "pass")
    inside = found.where("u >= 0").select("u", "v")
    sizes = sorted((r.pid, r.at) for r in found.where("u = -1").select("pid", "at").collect())  # a row per part
    if len(sizes) < 2:
        return inside
    starts, at = [], 0
    for _, n in sizes:
        starts.append(at)
        at += n
    near = []  # (part, where it starts, border): borders within a window of the part's rows
    for k, (pid, n) in enumerate(sizes):
        for way in (range(k, 0, -1), range(k + 1, len(sizes))):
            for border in way:
                if not (starts[border] - window < starts[k] + n and starts[k] < starts[border] + window):
                    break
                near.append((pid, starts[k], starts[border]))
    near = spark.createDataFrame(pa.table({"pid": pa.array([x[0] for x in near], pa.int32()), "start": pa.array([x[1] for x in near], pa.int64()), "border": pa.array([x[2] for x in near], pa.int64())}))
    rank = (F.col("start") + F.col("at")).alias("rank")
    around = found.where("u is null").join(F.broadcast(near), "pid").select("border", rank, "grp", "dim", "node", "vec")  # a row per part and border
    around = around.where((F.col("rank") >= F.col("border") - window) & (F.col("rank") < F.col("border") + window))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["border"]):
            u, v = _links_of(group, window, cosine)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = around.repartition(shuffle, "border").sortWithinPartitions("border", "rank").mapInArrow(across, _LINKS)
    return inside.unionByName(met)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Stretches of equal keys of sorted rows, one table each."""
    now, held = None, []
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        for start, end in _runs(rows):
            if held and rows[start] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = rows[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def inner_links(placed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(node, linked)``: vectors linked to each of ``placed(root, node, vec, n)`` inside its component, by their numbers ``n``.

    A component of up to ``SIDE`` vectors is one block. A larger one is dealt into sides by a hash; each pair of sides is a block.
    """
    shuffle = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = placed.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("sides"))
    dealt = placed.join(sides, "root").withColumn("side", F.when(F.col("sides") > 1, F.pmod(F.xxhash64("node"), F.col("sides"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "vec", "n")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "i", "j"]):
            unit, n = _matrix(group.column("vec").combine_chunks()), group.column("n").to_numpy()
            first = group.column("side").to_numpy() == group.column("i")[0].as_py()
            linked = np.zeros(len(n), dtype=np.int64)
            within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            ours, theirs = (np.arange(len(n)),) * 2 if within else (np.flatnonzero(first), np.flatnonzero(~first))
            for k in range(0, len(ours), 512):
                rows = ours[k : k + 512]
                near = unit[rows] @ unit[theirs].T >= cosine
                if within:
                    near[np.arange(len(rows)), rows] = False
                else:
                    linked[theirs] += n[rows] @ near
                linked[rows] += near @ n[theirs]
            yield pa.RecordBatch.from_arrays([group.column("node").combine_chunks(), pa.array(linked)], names=["node", "linked"])

    met = dealt.repartition(shuffle, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compared, "node long, linked long")
    return met.groupBy("node").agg(F.sum("linked").alias("linked"))


def _usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL
) -> DataFrame:
    """One row per vector: ``(<id_col>, n_links, component_id, kept)``.

    Two vectors are linked if their labels are equal and not null, they have as many components, and their cosine is ``cosine`` or more.
    ``n_links``: other vectors linked directly; ``component_id``: smallest id reachable over links, its own
    included; ``kept``: the row of that id. A vector that is null, empty, zero or holds null or non-finite components, and one without a
    label, links with nothing. Rows of one id are vectors like others; a null id takes the smallest id of its component,
    null if there is none. No link below the threshold is ever made; a pair that no pass brings together is missed. Empty table: no rows.
    """
    rows = narrow(embeddings, id=id_col, vec=vec_col, label=label_col).withColumn("label", F.col("label").cast("string"))
    usable = F.col("label").isNotNull() & _usable(F.col("vec"))
    valid = rows.where(usable).withColumn("h", F.xxhash64("label", "vec"))
    classes = valid.groupBy("h", "label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "h", "label", F.size("vec").alias("dim"), "vec", "least", "n"), "vectors")
    total, most = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    turns = list(range(passes_for(most or 0, cosine, window, recall)))
    found = None
    for k in range(0, len(turns), AT_ONCE):
        some = written(pass_links(classes, turns[k : k + AT_ONCE], total or 0, window, cosine), "links")
        found = some if found is None else found.unionByName(some)
    placed = written(classes.join(components(found), "node"), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    counted = placed.select("root", "node").join(least, "root").join(inner_links(placed, cosine), "node")
    final = classes.join(counted.select("node", "component", "linked"), "node", "left").select(
        "h", "label", "vec", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")
    )
    joined = valid.join(final, ["h", "label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)
