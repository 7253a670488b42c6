"""Removal of repeated byte strings with suffix arrays, exact over the whole corpus.

A *window* is a string of ``WIDTH`` bytes. A byte is removed if a window covers it that also starts earlier.

1. Each window is routed by its *anchor*, the least of the hashes of the ``GRAM``-byte strings in it: equal
   windows have equal anchors. Neighbouring windows with one anchor form a *run*. Grams of very many
   documents are taken as anchors only where a window has no other, so common lines attract no crowd.
2. Runs meet by anchor. Of runs that are equal as a whole only the first stays; the others are removed
   outright (within a task before anything is shuffled). A run whose anchor has no other run is done.
3. The runs left share an anchor but differ in part. Their bytes form shards, ordered by anchor. Each shard
   gets a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's method; suffixes with
   ``WIDTH`` bytes in common are one class. Classes of an anchor that goes on in the next shard are carried
   there in order and found by binary search.
4. The removed runs of a document meet its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import narrow, pieces, raw, written

WIDTH, GRAM = 100, 32
#: Bytes hashed at a time; runs that a task compares before it hands them on; bytes of a shard.
BLOCK, HELD_RUNS, SHARD = 1 << 20, 1_500_000, 1 << 20
#: Documents looked at for common grams, the share of them that makes a gram common, and the most that are kept.
PILOT_DOCS, COMMON_SHARE, COMMON_GRAMS = 1_024, 0.02, 65_536
#: Rows of one id but different texts are told apart by the high bits of a position.
VARIANT_BITS = 40

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NO_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Hashes of any substring of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


class Common:
    """Membership in a sorted array of hashes: a small table first, the array where that says yes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(hashes >> _U(44)).astype(np.int64)] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Indices of the grams that are members."""
        maybe = np.flatnonzero(self.table[(grams >> _U(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, grams[maybe])
        return maybe[self.hashes[np.minimum(at, len(self.hashes) - 1)] == grams[maybe]]


def runs(data: np.ndarray, ends: np.ndarray, common: Common | None = None):
    """Runs of a buffer of texts that end at ``ends``: arrays ``start, windows, anchor, key``."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),) * 2
    hashes = Hashes(data)
    grams = _mix(hashes.every(GRAM))
    places = np.arange(len(grams), dtype=np.uint64)
    rank = (grams >> _U(1)) & ~_U((1 << 21) - 1) | places  # leftmost of equal grams; BLOCK fits 21 bits
    if common is not None and len(common.hashes):
        rank[common(grams)] |= _U(1 << 63)
    least, width, span = rank, 1, WIDTH - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    anchor = (least & _U((1 << 21) - 1)).astype(np.int64)
    # a window must not cross the end of a text
    valid = np.ones(n, dtype=bool)
    for end in ends[:-1]:
        valid[max(0, end - WIDTH + 1) : end] = False
    opens = valid.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    start = np.flatnonzero(opens)
    if not len(start):
        return start, start, grams[:0], grams[:0]
    stops = valid.copy()
    stops[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    windows = np.flatnonzero(stops) - start + 1
    at = anchor[start]
    shape = (windows * 256 + (at - start)).astype(np.uint64)
    key = _mix(hashes.of(start, start + windows + WIDTH - 1) + shape * _U(0xD6E8FEB86659FD93))
    return start, windows, grams[at], key


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as buffers of at most about ``BLOCK`` bytes: bytes, ends, text number and offset of each part.

    A longer text is cut into parts that share ``WIDTH - 1`` bytes, so every window lies in one part.
    """
    held, rows, offsets, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - WIDTH + 1, 0), BLOCK - WIDTH):
            part = text[at : at + BLOCK - 1]
            if held and size + len(part) > BLOCK:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(h) for h in held]), np.array(rows), np.array(offsets)
                held, rows, offsets, size = [], [], [], 0
            held.append(part)
            rows.append(row)
            offsets.append(at)
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(h) for h in held]), np.array(rows), np.array(offsets)


def _first_of_each(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of ``id, pos, windows, anchor, key``: indices of the first row of each key, and of its later rows."""
    ids, pos, _, _, key = columns
    order = np.lexsort((pos, ids, key))
    k, i, p = key[order], ids[order], pos[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = (i != i[head]) | (p != p[head])  # a repeated row equals its first
    return order[first], order[later]


def _merged(ids: np.ndarray, pos: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join runs that touch within a text."""
    order = np.lexsort((pos, ids))
    ids, pos, ends = ids[order], pos[order], (pos + windows)[order]
    opens = np.ones(len(ids), dtype=bool)
    opens[1:] = (ids[1:] != ids[:-1]) | (pos[1:] > ends[:-1])
    start = np.flatnonzero(opens)
    if not len(start):
        return ids, pos, windows
    return ids[start], pos[start], np.maximum.reduceat(ends, start) - pos[start]


RUNS = "id long, pos long, windows long, anchor long, key long, gone boolean"


def _runs_of(common: np.ndarray):
    def run(batches):
        members = Common(common)
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        count = 0

        def out():
            columns = [np.concatenate(h) for h in held]
            for h in held:
                h.clear()
            first, later = _first_of_each(columns)
            stay = [c[first] for c in columns]
            ids, pos, windows = _merged(*[c[later] for c in columns[:3]])
            spread = _mix(ids.astype(np.uint64) * _BASE + pos.astype(np.uint64))  # any key that no run waits for
            gone = [ids, pos, windows, spread, spread]
            for part, flag in ((stay, False), (gone, True)):
                for a in range(0, len(part[0]), 200_000):
                    cut = [pa.array(c[a : a + 200_000].view(np.int64)) for c in part]
                    yield pa.RecordBatch.from_arrays([*cut, pa.array([flag] * len(cut[0]), pa.bool_())], names=["id", "pos", "windows", "anchor", "key", "gone"])

        for batch in batches:
            for piece in pieces(batch):
                ids = np.array(piece.column("id").to_pylist(), dtype=np.int64)
                variant = np.array(piece.column("variant").to_pylist(), dtype=np.int64) << VARIANT_BITS
                for data, ends, rows, offsets in _blocks(raw(piece)):
                    start, windows, anchor, key = runs(data, ends, members)
                    part = np.searchsorted(ends, start, side="right")
                    begins = ends - np.diff(ends, prepend=0)
                    held[0].append(ids[rows[part]])
                    held[1].append(start - begins[part] + offsets[part] + variant[rows[part]])
                    for h, c in zip(held[2:], (windows.astype(np.int64), anchor, key)):
                        h.append(c)
                    count += len(start)
                    if count >= HELD_RUNS:
                        yield from out()
                        count = 0
        if count:
            yield from out()

    return run


def _common_grams(docs: DataFrame) -> np.ndarray:
    """Hashes of grams that stand in many documents, from a bounded look at some of them. They steer which
    anchors are taken, never what is removed."""
    some = docs.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(PILOT_DOCS)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                for text in raw(piece):
                    for data, _, _, _ in _blocks([text]):
                        found = np.unique(_mix(Hashes(data).every(GRAM)))
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["gram"])

    counted = docs.join(F.broadcast(some), "id").select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= COMMON_SHARE * PILOT_DOCS).orderBy(F.desc("n"), "gram").limit(COMMON_GRAMS)
    found = np.array([r[0] for r in often.select("gram").collect()], dtype=np.int64)  # <= COMMON_GRAMS
    return np.sort(found.view(np.uint64))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are first ordered by seven bytes, the end of the text below any byte. Groups that are still tied are
    ordered by the rank of the suffix ``h`` bytes on, with ``h`` doubling; groups of one are never touched again.
    """
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([text.astype(np.uint64) + _U(1), np.zeros(7, dtype=np.uint64)])
    for k in range(7):
        key = (key << _U(9)) | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    opens = np.ones(n, dtype=bool)
    opens[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    rank[n] = -1
    tied = ~opens
    tied[:-1] |= ~opens[1:]
    places, h = np.flatnonzero(tied), 7
    while len(places):
        pos = order[places]
        pair = rank[pos] * (n + 1) + rank[np.minimum(pos + h, n)] + 1
        sub = np.argsort(pair)
        pos, pair = pos[sub], pair[sub]
        order[places] = pos
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[pos] = np.maximum.accumulate(np.where(fresh, places, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places, h = places[tied], h * 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> np.ndarray:
    """For each place of ``order``, the bytes its suffix shares with the one before, at most ``cap``.

    Kasai's method, in step over all strings of the shard: from one byte of a string to the next the
    shared length falls by one at most, so it is carried on and only lengthened.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int16), np.array([-1], dtype=np.int16)])
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    held = np.zeros(len(starts), dtype=np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        p = starts[:live] + step
        q = before[p]
        held = np.maximum(held[:live] - 1, 0)
        held[q < 0] = 0
        going = np.flatnonzero((q >= 0) & (held < cap))
        while len(going):
            a, b = p[going] + held[going], q[going] + held[going]
            inside = (a < n) & (b < n)
            same = inside & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            going = going[same]
            held[going] += 1
            going = going[held[going] < cap]
        shared[p] = held
    return shared[order]


class Shards:
    """Resolves runs that come ordered by anchor; yields ``(id, pos, windows)`` of removed windows."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.anchor = None
        self.windows = np.empty(0, dtype=f"S{width}")
        self.ids = self.pos = np.empty(0, dtype=np.int64)

    def shard(self, anchors: np.ndarray, ids: np.ndarray, pos: np.ndarray, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings])
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(strings), dtype=np.uint8)
        order = suffix_array(text)
        shared = common_prefixes(text, order, starts, lengths, self.width)
        group = np.cumsum(shared < self.width)
        row = np.searchsorted(starts, order, side="right") - 1
        offset = order - starts[row]
        valid = offset + self.width <= lengths[row]
        place, group, row, offset = order[valid], group[valid], row[valid], offset[valid]
        i, p = ids[row], pos[row] + offset
        # the first of each class, then what earlier shards hold of its anchor
        by = np.lexsort((p, i, group))
        opens = np.ones(len(by), dtype=bool)
        opens[1:] = group[by][1:] != group[by][:-1]
        heads = by[opens]
        number = np.cumsum(opens) - 1
        first_id, first_pos = i[heads].copy(), p[heads].copy()
        views = np.lib.stride_tricks.sliding_window_view(text, self.width)
        if self.anchor is not None and anchors[0] == self.anchor and len(self.windows):
            mine = np.flatnonzero(anchors[row[heads]] == self.anchor)
            if len(mine):
                sought = np.ascontiguousarray(views[place[heads[mine]]]).view(self.windows.dtype).ravel()
                at = np.minimum(np.searchsorted(self.windows, sought), len(self.windows) - 1)
                met = self.windows[at] == sought
                old_id, old_pos = self.ids[at], self.pos[at]
                sooner = met & ((old_id < first_id[mine]) | ((old_id == first_id[mine]) & (old_pos < first_pos[mine])))
                first_id[mine[sooner]], first_pos[mine[sooner]] = old_id[sooner], old_pos[sooner]
                # a class carried from before may lose its first place to one of this shard
                lost = met & ~sooner & ((old_id != first_id[mine]) | (old_pos != first_pos[mine]))
                yield old_id[lost], old_pos[lost], np.ones(int(lost.sum()), dtype=np.int64)
        later = (i[by] != first_id[number]) | (p[by] != first_pos[number])
        gone = by[later]
        yield i[gone], p[gone], np.ones(len(gone), dtype=np.int64)
        self._carry(anchors[-1], anchors[row[heads]], views, place[heads], first_id, first_pos)

    def _carry(self, last, anchors, views, place, ids, pos) -> None:
        same = last == self.anchor
        mine = np.flatnonzero(anchors == last)
        windows = np.ascontiguousarray(views[place[mine]]).view(f"S{self.width}").ravel()
        ids, pos = ids[mine], pos[mine]
        if same:
            windows = np.concatenate([self.windows, windows])
            ids, pos = np.concatenate([self.ids, ids]), np.concatenate([self.pos, pos])
        order = np.lexsort((pos, ids, windows))
        opens = np.ones(len(order), dtype=bool)
        opens[1:] = windows[order][1:] != windows[order][:-1]
        keep = order[opens]
        self.anchor, self.windows, self.ids, self.pos = last, windows[keep], ids[keep], pos[keep]


def _resolve(batches):
    state = Shards()
    held, size = [], 0

    def out():
        anchors, ids, pos = (np.array([h[k] for h in held], dtype=np.int64) for k in range(3))
        found = [np.concatenate(c) for c in zip(*state.shard(anchors, ids, pos, [h[3] for h in held]))]
        ids, pos, windows = _merged(*found)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos), pa.array(windows)], names=["id", "pos", "windows"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "id", "pos", "string")]):
            held.append(row)
            size += len(row[3])
            if size >= SHARD:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _cut(batches):
    """Bytes of the runs that a document is asked for."""
    names = ["anchor", "id", "pos", "string"]
    for batch in batches:
        for piece in pieces(batch):
            held, size = [], 0
            for id_, variant, text, asked in zip(*[piece.column(c).to_pylist() for c in ("id", "variant")], raw(piece), piece.column("asked").to_pylist()):
                for a in asked:
                    if a["pos"] >> VARIANT_BITS == variant:
                        at = a["pos"] & ((1 << VARIANT_BITS) - 1)
                        held.append((a["anchor"], id_, a["pos"], text[at : at + a["windows"] + WIDTH - 1]))
                        size += len(held[-1][3])
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))))
                            held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))))


def _remove(batches, with_text: bool):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def judged(id_, variant, text, gone):
        size, removed, spans = len(text), 0, 0
        mine = [(g["pos"] & ((1 << VARIANT_BITS) - 1), g["windows"]) for g in gone or () if g["pos"] >> VARIANT_BITS == variant]
        if mine:
            marks = np.zeros(size + 1, dtype=np.int64)
            pos, windows = np.array(mine).T
            np.add.at(marks, pos, 1)
            np.add.at(marks, pos + windows + WIDTH - 1, -1)
            covered = np.cumsum(marks)[:-1] > 0
            removed = int(covered.sum())
            spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            text = np.frombuffer(text, dtype=np.uint8)[~covered].tobytes()
        out = (None if id_ == _NO_ID else id_, size, removed, spans, hashlib.sha256(text).hexdigest())
        return (*out, text) if with_text else out

    for batch in batches:
        for piece in pieces(batch):
            columns = [piece.column(c).to_pylist() for c in ("id", "variant")]
            found = [judged(*row) for row in zip(*columns, raw(piece), piece.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``(<id_col>, n_bytes, n_removed, n_spans, kept_sha256)`` and, if wanted, ``kept``.

    Removed is every byte covered by a string of ``WIDTH`` bytes that also starts earlier: in a row of a smaller
    id, or earlier in the same text. ``n_spans`` counts maximal removed stretches. A null text is empty; a
    text shorter than ``WIDTH`` keeps all. Ids are integers; a null id comes after all others. Rows of one id
    and one text are one document and get one result; rows of one id and different texts come in the
    order of a hash of the text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = narrow(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)).alias("id"), "text")
    repeated = source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        source = source.withColumn("variant", F.lit(0).cast("long"))
    else:  # tell texts of one id apart; a hot id has no more rows here than it has texts
        texts = source.join(repeated, "id", "left_semi").select("id", F.xxhash64("text").alias("hash")).distinct()
        number = F.row_number().over(Window.partitionBy("id").orderBy("hash")).cast("long")
        named = texts.withColumn("variant", number)
        source = source.withColumn("hash", F.xxhash64("text")).join(named, ["id", "hash"], "left")
        source = source.select("id", "text", F.coalesce("variant", F.lit(0).cast("long")).alias("variant"))

    found = source.mapInArrow(_runs_of(_common_grams(source)), RUNS)
    place = F.struct("id", "pos")
    met = found.repartition(parts, "anchor").withColumns({
        "first": F.min(place).over(Window.partitionBy("anchor", "key")),
        "least": F.min("key").over(Window.partitionBy("anchor")),
        "most": F.max("key").over(Window.partitionBy("anchor")),
    })
    later, mixed = place > F.col("first"), F.col("least") != F.col("most")
    marks = written(
        met.where(F.col("gone") | later | mixed).select("id", "pos", "windows", F.when(~F.col("gone") & ~later, F.col("anchor")).alias("anchor")),
        "runs",
    )

    texts = source.repartition(parts, "id")  # shuffled once, read by both joins
    asked = marks.where("anchor is not null").groupBy("id").agg(F.collect_list(F.struct("pos", "windows", "anchor")).alias("asked"))
    strings = texts.join(asked, "id").mapInArrow(_cut, "anchor long, id long, pos long, string binary")
    ordered = strings.repartition(parts, "anchor").sortWithinPartitions("anchor", "id", "pos")
    resolved = ordered.mapInArrow(_resolve, "id long, pos long, windows long")
    gone = marks.where("anchor is null").select("id", "pos", "windows").unionAll(resolved)
    lists = gone.groupBy("id").agg(F.collect_list(F.struct("pos", "windows")).alias("gone"))

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = texts.join(lists, "id", "left").mapInArrow(lambda b: _remove(b, with_text), schema)
    return out.withColumnRenamed("id", id_col)
