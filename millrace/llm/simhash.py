"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints at three or fewer differing bits agree in one of their two 32-bit segments up to
one bit. Each fingerprint stands in the table once per segment; it asks for its own segment value and
for the values one bit above it (of two values one bit apart, exactly one lies below the other). Each
pair met is verified over all 64 bits. Equal fingerprints are one node, so a group of copies of any
size is one row before anything is joined.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, per_piece, quoted, raw, written
from millrace.llm.components import components

#: Shingle length, greatest distance, segments of the fingerprint.
WORDS, DISTANCE, SEGMENTS = 3, 3, 2
#: Shingles counted at a time.
BLOCK = 65_536
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """Lower-cased word shingles, repeats included; a shorter text is one shingle, no word gives none."""
    found = text.translate(_LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined]
    ends = list(accumulate(len(w) + 1 for w in found))
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :])]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits: a bit is set if it is set in over half the shingles' XXH64 (seed 42). No shingle: 0."""
    found = shingles(text, words)
    if not found:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), BLOCK):
        part = found[k : k + BLOCK]
        hashes = np.fromiter(map(_hash, part), dtype="<u8", count=len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, hash, fp)`` per row: ``hash`` is Spark's of the text, ``fp`` holds the 64 bits as a signed long."""

    def build(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in raw(piece)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([piece.column("id"), piece.column("hash"), pa.array(found)], names=["id", "hash", "fp"])

    source = narrow(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("hash"), "text")
    return source.mapInArrow(per_piece(build), f"id {source.schema['id'].dataType.simpleString()}, hash long, fp long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Verified links ``(u, v)``, ``u < v``, between distinct fingerprints ``fp``. Distance 0 to 3."""
    if not 0 <= distance < 2 * SEGMENTS:
        raise ValueError("two segments and balls of one bit serve distances from 0 to 3")
    width = 64 // SEGMENTS
    mask = (1 << width) - 1

    def segment(fp: Column, s: int) -> Column:
        return F.shiftright(fp, s * width).bitwiseAND(F.lit(mask))

    def key(value: Column, s: int) -> Column:
        return value.bitwiseOR(F.lit(s << width))

    fp = F.col("fp")
    held = F.array(*[key(segment(fp, s), s) for s in range(SEGMENTS)])
    asked = []
    for s in range(SEGMENTS):
        value = segment(fp, s)
        asked.append(key(value, s))
        for bit in range(width):
            one = F.lit(1 << bit)
            asked.append(F.when(value.bitwiseAND(one) == 0, key(value.bitwiseOR(one), s)))
    entries = prints.select(F.explode(held).alias("key"), fp.alias("v"))
    probes = prints.select(F.explode(F.array_compact(F.array(*asked))).alias("key"), fp.alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    met = probes.join(entries, "key").where((F.col("u") != F.col("v")) & near)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    """``(id, hash, fp, component_id)`` per row."""
    prints = written(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = nodes.join(linked, "fp", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    final = placed.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(final, "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """One row per input row: ``(<id_col>, fingerprint, component_id)``.

    ``component_id`` is the smallest id reachable over links, the row's own included. A null text has
    no words: its fingerprint is zero, linked like any other. Rows of the same id are rows like others; a null
    id takes the smallest id of its component and is null if there is none. Empty table: no rows.
    """
    out = _grouped(docs, id_col, text_col, words, distance)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns.

    Of several rows of one id in one component the least by all columns stays. Rows without an id cannot be told
    apart and stay.
    """
    found = _grouped(docs, id_col, text_col, words, distance)
    found = written(found.where("id is not null").select("id", "hash", "component_id"), "groups")
    hashed = F.xxhash64(quoted(text_col))

    def where(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(rows, (quoted(id_col) == F.col("__id")) & (hashed == F.col("__hash")), how)

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), "component_id").distinct()

    kept = where(keys(found.where("id != component_id")), "left_anti")
    several = found.where("id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if several.isEmpty():
        return kept
    crowd = keys(found.where("id = component_id").join(several, "id"))
    row = F.min(F.struct(*[quoted(c) for c in docs.columns])).alias("row")
    one = where(crowd, "inner").groupBy("__id").agg(row).select("row.*")
    single = found.where("id = component_id").join(several, "id", "left_anti")
    alone = where(keys(single), "left_semi").unionByName(docs.where(quoted(id_col).isNull()))
    return alone.unionByName(one)
