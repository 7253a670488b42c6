"""SentencePiece encoding as a relational lattice, and decoding.

A text is taken with a space in front and cut into *units* at places that no piece of the vocabulary can
cross; the best path through a unit's pieces is then a part of the best path through the text. Units are
encoded once each: substrings of bounded length are exploded, equi-joined to the piece table, the edges found
are grouped by unit, and a fold over the edges (``aggregate``) finds the path of the highest sum of scores.
A piece that scores less than its own characters cut otherwise is on no best path and makes no edges (``useful``).
A unit of more than ``UNIT_CHARS`` characters is not exploded: the task that holds its text finds the same path
in one go over the characters, with a byte for each place to trace it back.

Units that a bounded look at the corpus shows to be frequent are encoded first and sent to every task. The
rest meet their encodings by shuffle. Which unit goes which way has no bearing on the result. Between the two a
text is a list of numbers: of its words, and for each distinct word of a block those of its units.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import narrow, pieces, raw, tidy, written

#: Documents looked at for frequent units, most units sent to every task, and the longest of them.
PILOT_DOCS, FREQUENT, FREQUENT_CHARS = 10_000, 262_144, 64
#: Units of more characters than this are not exploded, but searched where their text is.
UNIT_CHARS = 4_096
#: Distinct words that a task counts at a time; documents and characters of text in a block.
COUNTED, BLOCK_DOCS, BLOCK_CHARS = 200_000, 8_192, 4_000_000
#: Tasks per shuffle partition where units are encoded: an edge list takes far more room than its unit.
LATTICE_TASKS = 8
#: Words that a task keeps from block to block; frequent ones come early.
KEPT = 300_000
#: Pairs of characters below this are looked up in a table.
NEAR = 1_024
#: What a character without a piece costs beyond the worst piece.
UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a space where the model writes U+2581, so a text may hold that character as itself."""

    surfaces: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]  # by byte value; empty: characters without a piece become ``unknown``
    unknown: int
    pairs: frozenset = field(default_factory=frozenset)  # neighbouring characters in pieces
    worst: float = -UNKNOWN_COST  # the score of a character without a piece

    @property
    def longest(self) -> int:
        return max(map(len, self.surfaces), default=1)


def load(path: str) -> Vocabulary:
    """The piece table of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    surfaces = [model.id_to_piece(i).replace("▁", " ") for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return vocabulary(surfaces, ids, [model.get_score(i) for i in ids], byte_ids if model.is_byte(byte_ids[0]) else [], model.unk_id())


def vocabulary(surfaces: list[str], ids: list[int], scores: list[float], byte_ids: list[int], unknown: int) -> Vocabulary:
    pairs = _pairs(surfaces)
    if max(map(len, surfaces), default=0) >= _LONGEST:
        raise ValueError(f"a piece has {_LONGEST} or more characters")
    if any(p[1] == " " and p != "  " for p in pairs):
        raise ValueError("a piece goes on over a space; words cannot be cut there")
    return Vocabulary(surfaces, ids, scores, byte_ids, unknown, pairs, min(scores, default=0.0) - UNKNOWN_COST)


def _pairs(surfaces: list[str]) -> frozenset:
    return frozenset(a + b for s in surfaces for a, b in zip(s, s[1:]))


def useful(known: Vocabulary) -> Vocabulary:
    """The pieces that can be on a best path; paths and ties stay as they are with all pieces.

    Sums of scores do not depend on what stands around a piece, so one that scores less than the best other cut of its
    characters is worse than that cut wherever it stands. Pieces of equal score are kept, and so are those that come
    nearer than what sums along a unit can be rounded by.
    """
    scores: dict[str, float] = {}
    for s, score in zip(known.surfaces, known.scores):
        scores[s] = max(score, scores.get(s, score))
    largest = max(map(abs, [known.worst, *known.scores]))
    margin = 2 * (known.longest + 1) * max(UNIT_CHARS, FREQUENT_CHARS) * largest * np.finfo(float).eps

    def other(s: str) -> float:
        best = [0.0]
        for end in range(1, len(s) + 1):
            cuts = [(best[start], scores.get(s[start:end], known.worst if end == start + 1 else None)) for start in range(end == len(s), end)]
            best.append(max(before + score for before, score in cuts if score is not None))
        return best[-1]

    kept = [k for k, (s, score) in enumerate(zip(known.surfaces, known.scores)) if len(s) < 2 or not other(s) > score + margin]
    surfaces, ids, of_kept = ([column[k] for k in kept] for column in (known.surfaces, known.ids, known.scores))
    return replace(known, surfaces=surfaces, ids=ids, scores=of_kept, pairs=_pairs(surfaces))


class Units:
    """Words and units of a text. A word is what stands between two spaces, with the space before it."""

    def __init__(self, pairs: frozenset):
        codes = np.array([(ord(a), ord(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
        small = (codes < NEAR).all(axis=1)
        self.near = np.zeros((NEAR, NEAR), dtype=bool)
        self.near[codes[small, 0], codes[small, 1]] = True
        self.far = np.sort(np.append(codes[~small, 0] << 21 | codes[~small, 1], -1))

    @staticmethod
    def words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words without the space before each, how many words a text has, and the numbers of all words in a row.

        Of several spaces the others stay with the word that follows.
        """
        found = [b" " + t.encode() for t in texts if t]
        data = np.frombuffer(b"".join(found), dtype=np.uint8)
        bounds = np.cumsum([0, *map(len, found)])
        space = data == ord(" ")
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[bounds[:-1]] = True
        places = np.append(np.flatnonzero(cut), len(data))
        words = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[[k for k, t in enumerate(texts) if t]] = np.diff(np.searchsorted(places, bounds))
        return pc.utf8_slice_codeunits(words.dictionary, 1), counts, words.indices.to_numpy()

    def of(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Units of all words in a row, and how many each word has.

        A word, with its space, is cut between characters that are neighbours in no piece.
        """
        if not words:
            return [], []
        joined = " " + " ".join(words)
        starts = np.cumsum([0, *[len(w) + 1 for w in words]])
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        left, right = codes[:-1], codes[1:]
        cut = np.ones(len(codes), dtype=bool)
        small = (left < NEAR) & (right < NEAR)
        cut[1:][small] = ~self.near[left[small], right[small]]
        rest = np.flatnonzero(~small)
        pair = (left[rest] << 21) | right[rest]
        at = np.minimum(np.searchsorted(self.far, pair), len(self.far) - 1)
        cut[1:][rest] = self.far[at] != pair
        cut[starts[:-1]] = True
        places = np.flatnonzero(cut)
        counts = np.diff(np.searchsorted(places, starts)).tolist()
        places = [*places.tolist(), len(joined)]
        return [joined[a:b] for a, b in zip(places, places[1:])], counts


def piece_table(spark: SparkSession, known: Vocabulary) -> DataFrame:
    return spark.createDataFrame(list(zip(known.surfaces, known.ids, known.scores)), "surface string, id int, score double")


#: No piece is as long; edges are ordered by their end and 255 less their size.
_LONGEST = 255


def _path(edges: Column) -> Column:
    """Fold edges ``(place, score, end, start, id)``, sorted, to the best edge into each place: ``(score, start, id)``.

    The place at hand stands beside those that are done; a character without a piece has the id -1.
    """
    done = F.array().cast("array<struct<score:double,start:int,id:int>>")
    begin = F.struct(done.alias("done"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id"))

    def closed(s: Column) -> Column:
        return F.array_append(s.done, F.struct(s.score.alias("score"), s.start.alias("start"), s.id.alias("id")))

    def step(s: Column, e: Column) -> Column:
        score = F.when(e.start == s.end, s.score).otherwise(F.get(s.done, e.start).score) + e.score

        def place(done: Column) -> Column:
            return F.struct(done.alias("done"), e.end.alias("end"), score.alias("score"), e.start.alias("start"), e.id.alias("id"))

        # the longest edge into a place comes first
        return F.when(e.end != s.end, place(closed(s))).when(score > s.score, place(s.done)).otherwise(s)

    return F.aggregate(edges, begin, step, closed)


def _back(best: Column) -> Column:
    """The ids on the path, in order; a character without a piece stands as minus its place, counted from 1."""
    last = F.size(best) - 1
    state = F.struct(last.alias("at"), F.array().cast("array<int>").alias("path"))

    def step(s: Column, i: Column) -> Column:
        node = F.get(best, i)
        id_ = F.when(node.id < 0, -i).otherwise(node.id)
        return F.when(s.at == i, F.struct(node.start.alias("at"), F.array_append(s.path, id_).alias("path"))).otherwise(s)

    return F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), state, step, lambda s: F.reverse(s.path))


def _longest(known: Vocabulary) -> dict[str, int]:
    """Size of the longest piece that begins with three given characters."""
    most: dict[str, int] = {}
    for s in known.surfaces:
        if len(s) >= 3:
            most[s[:3]] = max(len(s), most.get(s[:3], 0))
    return most


#: Characters that tell which sizes a piece can have, beyond those that need no telling.
_OPENINGS = (3, 5)


def _openings(spark: SparkSession, known: Vocabulary, chars: int) -> DataFrame:
    """Sizes of the pieces that begin with ``chars`` given characters, up to where longer openings tell."""
    until = min([c for c in _OPENINGS if c > chars], default=_LONGEST)
    sizes: dict[str, set[int]] = {}
    for s in known.surfaces:
        if chars <= len(s) < until:
            sizes.setdefault(s[:chars], set()).add(len(s))
    return spark.createDataFrame([(s, sorted(n)) for s, n in sizes.items()], f"opening{chars} string, sizes{chars} array<int>")


class LongUnits:
    """The path that ``lattice`` finds, for a unit of any length, in linear time."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.scores = dict(zip(known.surfaces, known.scores))
        self.ids = dict(zip(known.surfaces, known.ids))
        self.most = _longest(known)
        self.worst = known.worst

    def __call__(self, unit: str) -> bytes:
        score_of, most, worst, n = self.scores.get, self.most.get, self.worst, len(unit)
        ring = self.known.longest + 1  # an edge reaches no further
        best: list[float | None] = [None] * ring  # sums into the places ahead
        sizes = bytearray(n + 1)  # of the best edge into each place
        best[0] = 0.0
        for start in range(n):
            here = best[start % ring]
            best[start % ring] = None
            for size in range(1, min(most(unit[start : start + 3], 2), n - start) + 1):
                score = score_of(unit[start : start + size], worst if size == 1 else None)
                if score is None:
                    continue
                end = start + size
                before = best[end % ring]
                # the longest edge into a place comes first
                if before is None or here + score > before:
                    best[end % ring] = here + score
                    sizes[end] = size
        out, count, at = np.empty(n, dtype=np.uint8), n, n
        while at:  # sizes on the path, from the back
            count -= 1
            out[count] = sizes[at]
            at -= sizes[at]
        ids, at = array("i"), 0
        for size in out[count:].tolist():
            id_ = self.ids.get(unit[at : at + size])
            if id_ is not None:
                ids.append(id_)
            elif self.known.byte_ids:
                ids.extend(self.known.byte_ids[b] for b in unit[at].encode())
            else:
                ids.append(self.known.unknown)
            at += size
        return ids.tobytes()


def lattice(units: DataFrame, known: Vocabulary) -> DataFrame:
    """``units(unit)``, distinct and not empty -> ``(unit, ids)``: the path of the highest sum of scores.

    Of paths with equal sums the one with the longest last piece is taken, place by place. A character without a piece
    of its own is an edge of the worst score less ``UNKNOWN_COST`` and becomes its bytes' pieces. Substrings have the
    sizes of the pieces that begin like them.
    """
    spark = units.sparkSession
    first, more = _OPENINGS
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    starts = starts.select("unit", "start", F.substring("unit", F.col("start"), F.lit(more)).alias("tail"))
    # the tables have the size of a tokenizer's fixed vocabulary
    bound = starts.join(F.broadcast(_openings(spark, known, more)), F.col("tail") == F.col(f"opening{more}"), "left")
    bound = bound.join(F.broadcast(_openings(spark, known, first)), F.substring("tail", 1, first) == F.col(f"opening{first}"), "left")
    none = F.array().cast("array<int>")
    sizes = F.concat(F.array(*[F.lit(n) for n in range(1, first)]), *[F.coalesce(f"sizes{c}", none) for c in _OPENINGS])
    lengths = bound.select("unit", "start", F.explode(sizes).alias("size")).where(F.col("start") + F.col("size") <= F.length("unit") + 1)
    parts = lengths.select("unit", "start", "size", F.expr("substring(unit, start, size)").alias("surface"))
    edges = parts.join(F.broadcast(piece_table(spark, known)), "surface", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    end = F.col("start") + F.col("size") - 1
    # a fold runs over each edge: what it needs is spelled out before
    place = F.shiftleft(end, 8) + F.lit(_LONGEST) - F.col("size")
    columns = [place.alias("place"), F.coalesce("score", F.lit(known.worst)).alias("score"), end.alias("end"), (F.col("start") - 1).alias("start")]
    edge = F.struct(*columns, F.coalesce("id", F.lit(-1)).alias("id"))
    grouped = edges.groupBy("unit").agg(F.collect_list(edge).alias("edges"))
    best = grouped.select("unit", _path(F.sort_array("edges")).alias("best"))
    path = best.select("unit", _back(F.col("best")).alias("ids"))

    def spelled(i: Column) -> Column:
        if not known.byte_ids:
            return F.array(F.when(i < 0, F.lit(known.unknown)).otherwise(i))
        digits = F.hex(F.substring("unit", -i, F.lit(1)))
        places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
        value = lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int")
        table = F.array(*[F.lit(b) for b in known.byte_ids])
        return F.when(i < 0, F.transform(places, lambda k: F.get(table, value(k)))).otherwise(F.array(i))

    whole = F.when(F.array_min("ids") < 0, F.flatten(F.transform("ids", spelled))).otherwise(F.col("ids"))
    return path.select("unit", whole.alias("ids"))


def _counted(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """``(unit, n)`` of a bounded look at the corpus, for units of at most ``FREQUENT_CHARS``."""
    some = docs.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(PILOT_DOCS)
    pairs = known.pairs

    def run(batches):
        cutter, words = Units(pairs), Counter()

        def out():
            found: Counter = Counter()
            units, sizes = cutter.of(list(words))
            for unit, n in zip(units, np.repeat(list(words.values()), sizes).tolist()):
                if len(unit) <= FREQUENT_CHARS:
                    found[unit] += n
            words.clear()
            return pa.RecordBatch.from_pydict({"unit": list(found), "n": list(found.values())})

        for batch in batches:
            for piece in pieces(batch):
                listed, _, order = cutter.words([text.decode() for text in raw(piece)])
                for word, n in zip(listed.to_pylist(), np.bincount(order, minlength=len(listed)).tolist()):
                    words[word] += n
                if len(words) > COUNTED:
                    yield out()
        if words:
            yield out()

    return docs.join(F.broadcast(some), "id").select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Paths:
    """Ids of units, one unit after another, and where those of each unit begin and how many they are."""

    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def __add__(self, other: Paths) -> Paths:
        codes, sizes = np.concatenate([self.codes, other.codes]), np.concatenate([self.sizes, other.sizes])
        return Paths(codes, np.concatenate([self.starts, len(self.codes) + other.starts]), sizes)


def paths(codes: np.ndarray, sizes: np.ndarray) -> Paths:
    return Paths(codes.astype(np.int32), np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int64))


def _taken(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``codes`` in a row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return codes[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def frequent(docs: DataFrame, known: Vocabulary) -> tuple[list[str], Paths]:
    """At most ``FREQUENT`` units with their ids, those that a bounded look finds most often."""
    counted = written(_counted(docs, known), "units")
    sizes = counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("units")).collect()  # <= 10,000 rows
    least, total = 10_001, 0
    for n, units in sorted(sizes, reverse=True):
        total += units
        if total > FREQUENT:
            break
        least = n
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = counted.where(F.col("n") >= least).select("unit").repartition(LATTICE_TASKS * parts, "unit")
    found = lattice(units, known).toArrow()  # <= FREQUENT units of <= FREQUENT_CHARS
    lists = found.column("ids").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return found.column("unit").to_pylist(), paths(lists.flatten().to_numpy(zero_copy_only=False), sizes)


def _pack(batches):
    """Rows ``(block, place, ids)`` as one binary for each block of a batch: narrow numbers, one column after another."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        places = batch.column("place").to_numpy()[order]
        lists = batch.column("ids").take(pa.array(order))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1, append=-1))
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            columns = [places[a:b], sizes[a:b], codes[ends[a] : ends[b]]]
            wide = [int(c.max(initial=0) > 0xFFFF) for c in columns]
            head = np.array([b - a, *wide], dtype="<u4").tobytes()
            parts.append(head + b"".join(c.astype("<u4" if w else "<u2").tobytes() for c, w in zip(columns, wide)))
        yield pa.RecordBatch.from_arrays([pa.array(blocks[order][cuts[:-1]], pa.int64()), pa.array(parts, pa.binary())], names=["block", "part"])


def _unpacked(part: bytes) -> list[np.ndarray]:
    """Places, how many ids each has, and the ids."""
    n, *wide = np.frombuffer(part, dtype="<u4", count=4).tolist()
    at, columns = 16, []
    for k, w in enumerate(wide):
        kind = "<u4" if w else "<u2"
        count = n if k < 2 else -1
        columns.append(np.frombuffer(part, dtype=kind, count=count, offset=at) if n else np.empty(0, dtype=kind))
        at += columns[-1].nbytes
    return columns


def _found(parts: list[bytes], units: int) -> Paths:
    """Paths of a block's own units, each of which has one, by their places."""
    columns = [np.concatenate(c) for c in zip(*map(_unpacked, parts))] or [np.empty(0, dtype=np.int64)] * 3
    order = np.argsort(columns[0], kind="stable")
    if not np.array_equal(columns[0][order], np.arange(units)):
        raise ValueError("a unit has no path")
    read = paths(columns[2], columns[1])
    return Paths(read.codes, read.starts[order], read.sizes[order])


def _planes(numbers: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones, and so on: they pack better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def encode(
    docs: DataFrame, known: Vocabulary, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, digest: bool = False
) -> DataFrame:
    """One row per input row: ``(<id_col>, ids)``, the piece ids of the whole text, with ``decoded`` also
    ``text``, what the ids decode to (``decode`` in the same pass over the rows), and with ``digest`` also
    ``decoded_sha256``, that text's SHA-256 in lower-case hex.

    A null or empty text has no pieces. Rows of the same id are encoded each on its own; a null id stays null;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = narrow(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    live = useful(known)
    units_, paths_ = frequent(source, live)
    numbered = spark.sparkContext.broadcast(dict(zip(units_, range(len(units_)))))  # <= FREQUENT units
    common = spark.sparkContext.broadcast(paths_)
    vocabulary_ = spark.sparkContext.broadcast((known, live))  # a tokenizer's fixed vocabulary
    names = ["id", "ids", *["text"] * decoded, *["decoded_sha256"] * digest]
    pairs = live.pairs

    def scan(batches):
        """Blocks of documents: ids, the units in them that are not frequent, and their texts as numbers of words.

        Of each distinct word the numbers of its units are written: first come the frequent units, then those of the
        block, then those that are not exploded.
        """
        hot, cutter = numbered.value, Units(pairs)
        # words of frequent units alone need no second look: their units stand in ``arena``
        kept, arena, begins, lengths = {}, *[np.empty(0, dtype=np.int64)] * 3
        packer = zstandard.ZstdCompressor(level=1)
        held, size = [], 0

        def number(keys, of):
            return np.fromiter(map(of.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))

        def out():
            nonlocal arena, begins, lengths
            listed, counts, order = cutter.words([t for _, t in held])
            words = listed.to_pylist()
            at = number(words, kept)
            new = np.flatnonzero(at < 0)
            fresh = [words[k] for k in new.tolist()]
            units, sizes = cutter.of(fresh)
            numbers, sizes = number(units, hot), np.array(sizes, dtype=np.int64)
            ends = np.cumsum(sizes)
            rare = np.flatnonzero(numbers < 0)
            others = [units[k] for k in rare.tolist()]
            distinct = set(others)
            missing = sorted(u for u in distinct if len(u) <= UNIT_CHARS)
            long = sorted(u for u in distinct if len(u) > UNIT_CHARS)
            numbers[rare] = len(hot) + number(others, {u: k for k, u in enumerate(missing + long)})
            at[new] = len(begins) + np.arange(len(fresh))
            codes, firsts, each = np.concatenate([arena, numbers]), np.concatenate([begins, len(arena) + ends - sizes]), np.concatenate([lengths, sizes])
            spelled = _taken(codes, firsts[at], each[at])
            parts = [pickle.dumps(missing), pickle.dumps((len(missing), long)), *map(_planes, (spelled, each[at], counts, order))]
            body = pickle.dumps([packer.compress(part) for part in parts])
            if len(kept) < KEPT:
                plain = np.ones(len(fresh), dtype=bool)
                plain[np.searchsorted(ends, rare, side="right")] = False
                whole = np.flatnonzero(plain)
                kept.update(zip([fresh[k] for k in whole.tolist()], range(len(begins), len(begins) + len(whole))))
                begins = np.concatenate([begins, len(arena) + np.cumsum(sizes[whole]) - sizes[whole]])
                arena = np.concatenate([arena, _taken(numbers, (ends - sizes)[whole], sizes[whole])])
                lengths = np.concatenate([lengths, sizes[whole]])
            return pa.RecordBatch.from_arrays([pa.array([[i for i, _ in held]], kinds), pa.array([body])], names=["ids", "body"])

        with tidy():
            for batch in batches:
                kinds = pa.list_(batch.schema.field("id").type)
                for piece in pieces(batch):
                    for id_, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist()):
                        held.append((id_, text or ""))
                        size += len(held[-1][1])
                        if size > BLOCK_CHARS or len(held) >= BLOCK_DOCS:
                            yield out()
                            held, size = [], 0
            if held:
                yield out()

    def ask(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for body, block in zip(batch.column("body").to_pylist(), batch.column("block").to_pylist()):
                units = pickle.loads(opener.decompress(pickle.loads(body)[0]))
                if units:
                    columns = [pa.array([block] * len(units), pa.int64()), pa.array(range(len(units)), pa.int32()), pa.array(units, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "unit"])

    def join(batches):
        """Ids of each document of a block, from the paths of frequent units and of those the block has got."""
        hot = common.value
        opener = zstandard.ZstdDecompressor()
        search = None
        decoder = Decoder(vocabulary_.value[0]) if decoded or digest else None

        with tidy():
            for batch in batches:
                for ids, body, found in zip(*[batch.column(c) for c in ("ids", "body", "found")]):
                    own, *planes = map(opener.decompress, pickle.loads(body.as_py())[1:])
                    numbers, sizes, counts, order = map(_numbers, planes)
                    missing, long = pickle.loads(own)
                    known_here = hot + _found(found.as_py() or [], missing)
                    if long:
                        search = search or LongUnits(vocabulary_.value[1])
                        alone = [np.frombuffer(search(u), dtype=np.int32) for u in long]
                        known_here += paths(np.concatenate(alone), np.array(list(map(len, alone))))
                    # the ids of all words of the block, one after another
                    each = known_here.sizes[numbers]
                    codes = _taken(known_here.codes, known_here.starts[numbers], each)
                    of_word = np.add.reduceat(each, np.cumsum(sizes, dtype=np.int64) - sizes) if len(sizes) else each
                    begins = np.cumsum(of_word) - of_word
                    # and those of its documents, some at a time
                    ends = np.cumsum([0, *counts.tolist()])
                    for k in range(0, len(counts), 500):
                        last = min(k + 500, len(counts))
                        here = order[ends[k] : ends[last]]
                        taken = of_word[here]
                        bounds = np.concatenate([[0], np.cumsum(taken)])[ends[k : last + 1] - ends[k]]
                        yield rows_of(ids.values.slice(k, last - k), _taken(codes, begins[here], taken), bounds, decoder)

    def rows_of(ids, values, bounds, decoder):
        columns = [ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))]
        texts = decoder(values, np.diff(bounds).tolist()) if decoder else []
        if decoded:
            columns.append(pa.array(texts, pa.string()))
        if digest:
            columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    blocks = source.mapInArrow(scan, f"ids array<{kind}>, body binary")
    blocks = blocks.withColumn("block", F.monotonically_increasing_id()).repartition(parts, "block")  # shuffled once, read twice
    asked = blocks.mapInArrow(ask, "block long, place int, unit string")  # a unit once for each block
    asked = asked.where("unit is not null and block is not null").repartition(LATTICE_TASKS * parts, "unit")
    # counting the other columns, too, lets both uses read one shuffle
    uses = asked.groupBy("unit").agg(F.count("block").alias("blocks"), F.count("place").alias("places"))
    encoded = lattice(uses.where("blocks > 0 and places > 0").select("unit"), live)
    # both sides are dealt alike, and a task's share of the encodings fits a hash table: no need to sort
    packed = asked.join(encoded.hint("shuffle_hash"), "unit").select("block", "place", "ids").mapInArrow(_pack, "block long, part binary")
    found = packed.groupBy("block").agg(F.collect_list("part").alias("found"))
    out = blocks.join(found, "block", "left").select("ids", "body", "found").mapInArrow(join, f"id {kind}, ids array<int>" + ", text string" * decoded + ", decoded_sha256 string" * digest)
    return out.withColumnRenamed("id", id_col)


class Decoder:
    """Texts of piece ids; pieces of bytes are joined before they are read as UTF-8."""

    def __init__(self, known: Vocabulary):
        self.count = max([-1, *known.ids, *known.byte_ids]) + 1
        surfaces = np.full(self.count + 1, b"", dtype=object)  # the last one for ids that are no piece
        for i, piece in [*zip(known.ids, [s.encode() for s in known.surfaces]), *zip(known.byte_ids, [bytes([b]) for b in range(256)])]:
            surfaces[i] = piece
        self.surfaces = surfaces

    def __call__(self, ids: np.ndarray, sizes: list[int | None]) -> list[str | None]:
        """Texts of lists of the given sizes that stand in a row; None has no text."""
        parts = self.surfaces[np.where((ids >= 0) & (ids < self.count), ids, self.count)].tolist()
        found, at = [], 0
        for n in sizes:
            if n is None:
                found.append(None)
                continue
            text = b"".join(parts[at : at + n])
            at += n
            found.append((text[1:] if text[:1] == b" " else text).decode(errors="replace"))
        return found


def decode(encoded: DataFrame, known: Vocabulary, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add the text of piece ids.

    Null ids are null text; an id that is no piece gives nothing; bytes that are no UTF-8 give U+FFFD.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(known)  # a tokenizer's fixed vocabulary

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(ids_col)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            found = decoder(ids, pc.list_value_length(lists).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` string")
