"""Trie of conversation prefixes by ROLLUP over positional turn columns.

A turn is an id of fixed size: a digest of its role and text and the length of its text. ``BLOCK`` turns of a
conversation stand in as many columns; a longer conversation goes on in further rows, each keyed by the node that its
earlier turns lead to. One ``ROLLUP`` over the columns, with ``grouping_id`` for the depth, aggregates every
prefix of every row at once. A node is named by its depth and a 128-bit digest of its turns (the exclusive or of hashes of
each turn with its place), so rows of a conversation need not wait for each other.

Sums over subtrees need no walk either. The smallest member of a node *owns* it; what a conversation owns is the end
of its path. A sum over the nodes below a node is then a sum over the members of that node of what they own, which
a second ``ROLLUP`` adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import narrow, written

#: Turn columns of a row. Rows of a conversation that are added up by one window; a longer one is cut into such groups.
BLOCK, GROUP = 8, 1_024
#: Conversation ids that are joined into one text before they are hashed.
IDS = 4_096

_T = [f"t{k}" for k in range(1, BLOCK + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes: 16 of a digest of role and text, 8 of the text's length in UTF-8."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.unhex(F.concat(F.left(F.sha2(whole, 256), F.lit(32)), size))


def _bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")


def _lanes(turn: Column, at: Column) -> tuple[Column, Column]:
    return F.xxhash64(turn, at), F.xxhash64(at, turn)


def _ends(members: DataFrame) -> DataFrame:
    """``members(depth, x, y, conv)`` -> ``(depth, x, y, ends_sha256)``: a digest of the sorted, comma-joined ids.

    Ids are sorted by ranges and joined in stretches; the stretches of a node are then fed to one digest in order, so a node of any
    number of ids takes little memory.
    """
    shuffle = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["depth", "x", "y"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*now, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [*[pa.int64()] * 4, pa.string()])], names=[*keys, "first", "ids"])

        for batch in batches:
            for depth, x, y, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, x, y) != now or len(ids) >= IDS:
                    close()
                    now = (depth, x, y)
                ids.append(conv)
            if len(out) > 2_000:
                yield made()
                out = []
        close()
        if out:
            yield made()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []
        for batch in batches:
            for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if (depth, x, y) != now:
                    if held:
                        out.append((*now, held.hexdigest()))
                    now, held = (depth, x, y), hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
        if held:
            out.append((*now, held.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 3, pa.string()])], names=[*keys, "ends_sha256"])

    laid = members.select(F.col("depth").cast("long").alias("depth"), "x", "y", "conv").repartitionByRange(shuffle, *keys, "conv").sortWithinPartitions(*keys, "conv")
    stretches = laid.mapInArrow(joined, "depth long, x long, y long, first long, ids string")
    met = stretches.repartition(shuffle, *keys).sortWithinPartitions(*keys, "first")
    return met.mapInArrow(digested, "depth long, x long, y long, ends_sha256 string")


def _rolled(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Aggregates of each prefix of the rows' turn columns: ``(depth, x, y, up_x, up_y, size, inside, …)``.

    ``up``: the node above; ``size``: bytes of the last turn; ``inside``: bytes of the row's turns before it.
    """
    keys = ", ".join(_T)
    asked = ", ".join(f"{how} as {name}" for name, how in sums.items())
    rolled = rows.sparkSession.sql(
        f"select block, x, y, {keys}, {BLOCK} - bit_count(grouping_id()) as d, {asked} from {{rows}} group by block, x, y, rollup({keys})",
        rows=rows,
    )
    here = F.array(*_T)
    last = F.get(here, F.col("d") - 1)
    rolled = rolled.where(((F.col("d") == 0) & (F.col("block") == 0)) | last.isNotNull())
    depth = F.col("block") * BLOCK + F.col("d")

    def at(lane: int, start: Column, cut: int) -> Column:
        for k, name in enumerate(_T, 1):
            h = _lanes(F.col(name), F.col("block") * BLOCK + k)[lane]
            start = start.bitwiseXOR(F.when(F.col("d") >= k + cut, h).otherwise(F.lit(0)))
        return start

    inside = sum((F.when(F.col("d") > k, _bytes(F.col(t))).otherwise(0) for k, t in enumerate(_T, 1)), F.lit(0))
    return rolled.select(
        depth.cast("long").alias("depth"),
        at(0, F.col("x"), 0).alias("x"),
        at(1, F.col("y"), 0).alias("y"),
        at(0, F.col("x"), 1).alias("up_x"),
        at(1, F.col("y"), 1).alias("up_y"),
        F.coalesce(_bytes(last), F.lit(0)).alias("size"),
        inside.alias("inside"),
        *sums,
    )


def numbered_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, pos, turn)``: the id of each turn and its place in its conversation, from 1.

    Order: turn (null first), role, text; a null role or text is empty; equal rows count each time; rows without a conversation id
    belong to none. Rows are sorted by ranges over the whole table, so a conversation of any length is spread; what it has in
    the parts before is added from counts.
    """
    shuffle = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = narrow(turns, conv=id_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    laid = rows.repartitionByRange(shuffle, *order).sortWithinPartitions(*order)
    laid = laid.select("conv", turn_id(F.col("role"), F.col("text")).alias("turn"), F.monotonically_increasing_id().alias("at"))
    laid = written(laid, "turns").withColumn("part", F.shiftright("at", 33))
    parts = laid.groupBy("conv", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv", "part", (F.col("start") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("zero"))
    return laid.join(starts, ["conv", "part"]).select("conv", (F.col("at") - F.col("zero")).alias("pos"), "turn")


def prefix_trie(
    turns: DataFrame,
    members: DataFrame | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per distinct prefix (node) of the conversations in ``turns``; see ``numbered_turns`` and ``trie``."""
    return trie(numbered_turns(turns, id_col, turn_col, role_col, text_col), members, id_col)


def trie(rows: DataFrame, members: DataFrame | None = None, id_col: str = "conv_id") -> DataFrame:
    """One row per node of ``rows(conv, pos, turn)`` (positions from 1 without gaps), the textless root included.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the smallest member and that of
    the node above (null for the root), members (conversations that open with the prefix), nodes one turn longer,
    childless nodes of the subtree (itself included), bytes of text that the subtree's members share (each node's last text once less
    than it has members), SHA-256 of the sorted, comma-joined ids that end here.

    ``members`` lists the conversations, those without turns included (default: all in ``rows``). No conversations: no rows.
    """
    block, slot = F.floor((F.col("pos") - 1) / BLOCK), F.pmod(F.col("pos") - 1, F.lit(BLOCK))
    x, y = _lanes(F.col("turn"), F.col("pos"))
    cut = rows.select("conv", block.cast("long").alias("block"), slot.alias("slot"), "turn", x.alias("x"), y.alias("y"), _bytes(F.col("turn")).alias("size"))
    columns = [F.max(F.when(F.col("slot") == k, F.col("turn"))).alias(t) for k, t in enumerate(_T)]
    own = cut.groupBy("conv", "block").agg(
        *columns, F.bit_xor("x").alias("own_x"), F.bit_xor("y").alias("own_y"), F.sum("size").alias("own_size"), F.count(F.lit(1)).alias("own_n")
    )
    own = written(own, "blocks")
    whole = own.groupBy("conv").agg(F.bit_xor("own_x").alias("x"), F.bit_xor("own_y").alias("y"), F.sum("own_size").alias("total"), F.sum("own_n").alias("depth"))
    if members is not None:
        every = narrow(members, conv=id_col).where("conv is not null").select(F.col("conv").cast("long").alias("conv")).distinct()
        whole = every.join(whole, "conv", "left").fillna(0)
    whole = written(whole, "conversations")
    blocks = written(_keyed(own, whole), "keyed")

    nodes = _rolled(blocks, {"conv": "min(conv)", "n": "count(*)", "ahead": "min(ahead)"}).withColumn("path", F.col("ahead") + F.col("inside")).drop("ahead", "inside")
    nodes = written(nodes, "nodes")
    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y"))
    nodes = written(nodes.join(up.agg(F.count(F.lit(1)).alias("children")), ["depth", "x", "y"], "left").fillna(0, ["children"]), "nodes")
    owned = nodes.groupBy("conv").agg(F.sum("size").alias("owned"), F.max((F.col("children") == 0).cast("long")).alias("leaf"))
    weights = written(whole.select("conv", "total").join(owned, "conv", "left").fillna(0), "weights")
    sums = _rolled(blocks.join(weights, "conv"), {"all_bytes": "sum(total)", "all_owned": "sum(owned)", "leaves": "sum(leaf)"})
    sums = sums.select("depth", "x", "y", "all_bytes", "all_owned", "leaves")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv").alias("parent"))
    met = nodes.join(sums, ["depth", "x", "y"]).join(_ends(whole), ["depth", "x", "y"], "left").join(weights, "conv")
    # the turns of all members from here on, less the turns of all nodes from here on; the smallest member owns the node
    nodes_bytes = F.col("all_owned") - F.col("owned") + F.col("total") - F.col("path")
    saved = F.col("all_bytes") - F.col("n") * F.col("path") - nodes_bytes
    return met.join(above, ["depth", "up_x", "up_y"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _keyed(own: DataFrame, whole: DataFrame) -> DataFrame:
    """``(conv, block, x, y, ahead, turn columns)``: each row with the node that the earlier turns lead to and their bytes."""
    zero = F.lit(0).cast("long")
    names = ["conv", "block", "x", "y", "ahead", *_T]
    short = whole.where(F.col("depth") <= BLOCK).select("conv").join(own.select("conv", *_T), "conv", "left")
    short = short.withColumns({"block": zero, "x": zero, "y": zero, "ahead": zero})
    long = own.join(whole.where(F.col("depth") > BLOCK).select("conv"), "conv", "left_semi").withColumn("group", F.floor(F.col("block") / GROUP))
    before = Window.partitionBy("conv", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = long.groupBy("conv", "group").agg(F.bit_xor("own_x").alias("gx"), F.bit_xor("own_y").alias("gy"), F.sum("own_size").alias("gsize"))
    groups = groups.select("conv", "group", F.bit_xor("gx").over(earlier).alias("gx"), F.bit_xor("gy").over(earlier).alias("gy"), F.sum("gsize").over(earlier).alias("gsize"))
    inside = long.select("conv", "block", "group", *_T, F.bit_xor("own_x").over(before).alias("x"), F.bit_xor("own_y").over(before).alias("y"), F.sum("own_size").over(before).alias("ahead"))
    inside = inside.join(groups, ["conv", "group"]).fillna(0, ["x", "y", "ahead", "gx", "gy", "gsize"])
    placed = inside.withColumns({"x": F.col("x").bitwiseXOR(F.col("gx")), "y": F.col("y").bitwiseXOR(F.col("gy")), "ahead": F.col("ahead") + F.col("gsize")})
    return placed.select(names).unionByName(short.select(names))


def grafted(rows: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations that open with another's turns: a workload with shared prefixes from ``rows(conv, pos, turn)``.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % every`` (all if it has fewer, none if it is absent)
    in place of its own first ``h``; ``h`` is the unsigned CRC-32 of the decimal ``c`` modulo ``most``.
    """
    lengths = rows.groupBy("conv").agg(F.max("pos").alias("n"))
    plan = lengths.select("conv", (F.col("conv") - F.col("conv") % every).alias("donor"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    plan = plan.join(lengths.select(F.col("conv").alias("donor"), F.col("n").alias("given")), "donor", "left").fillna(0, ["given"])
    heads = rows.where(F.col("pos") < most).select(F.col("conv").alias("donor"), "pos", "turn").join(plan.select("conv", "donor", "h"), "donor")
    heads = heads.where(F.col("pos") <= F.col("h")).select("conv", "pos", "turn")
    tails = rows.join(plan.select("conv", "h", "given"), "conv").where(F.col("pos") > F.col("h"))
    return heads.unionByName(tails.select("conv", (F.col("pos") - F.col("h") + F.least("h", "given")).alias("pos"), "turn"))
