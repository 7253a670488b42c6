"""Phrase collocations from sorted streams of n-gram counts.

1. One scan hashes each word and each pair of neighbouring words, in numpy; equal hashes are added up within a task, then by
   hash range. Those of ``min_count`` or more mark a bit of a filter of fixed size. A phrase can only be frequent if each of
   its pairs is, so a second scan hashes only longer phrases of pairs that pass, and makes a filter of them in the same way.
   Both filters let all frequent phrases through (and some others, which their exact counts remove).
2. A third scan counts the words and phrases that pass, as strings.
3. The counts of all lengths are one stream. It is laid out twice: sorted by the words from the front (prefix order)
   and from the back (suffix order). In prefix order a phrase follows all its prefixes and precedes its
   extensions to the right, so one pass over the sorted rows meets them in lockstep, without any look-up table; in suffix
   order the same holds for suffixes and extensions to the left. The layouts are cut anywhere, hot words included: what a
   part needs of its neighbours (a count for each open prefix) is carried by a table with one row per part.
4. Both layouts meet in a sort-merge join and give each phrase the counts of both sides of every cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import narrow, pieces, raw, written

LONGEST, MIN_COUNT, COVERED, TOP = 4, 30, 80, 2_000
#: Bits of each of two filters (16 MB, whatever the input) and of the hashes that are counted for them.
FILTER_BITS, HASH_BITS = 27, 48
#: Hashes a task holds before it adds them up; phrases it counts before it hands them on; bytes of one line taken at once.
HELD_HASHES, HELD_PHRASES, SLICE = 3_000_000, 600_000, 1 << 20
#: Remembered word hashes of a task.
KNOWN_WORDS = 200_000
#: The rows of a language are ranked in this many parts before the best of each are ranked together.
RANK_PARTS = 64

_U = np.uint64
#: Lower-cases A-Z; line ends and punctuation end a piece; tabs are spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def blocks(texts: Iterable[bytes], longest: int = LONGEST) -> Iterator[tuple[list[bytes], list[int], int]]:
    """``(words, words of each piece, seen)``: the words of many pieces at a time.

    A piece of over ``SLICE`` bytes comes in several blocks of its own. Each opens with the last words of the one
    before it; ``seen`` tells how many.
    """
    words: list[bytes] = []
    sizes: list[int] = []
    for text in texts:
        for piece in text.translate(_TABLE).split(b"\n"):
            if len(piece) <= SLICE:
                found = piece.split()
                if found:
                    words += found
                    sizes.append(len(found))
                continue
            carried: list[bytes] = []
            start = 0
            while start < len(piece):
                end = piece.find(b" ", start + SLICE)
                end = len(piece) if end < 0 else end
                found = piece[start:end].split()
                if found:
                    yield carried + found, [len(carried) + len(found)], len(carried)
                    carried = (carried + found)[1 - longest :]
                start = end
        if len(words) > SLICE // 8:
            yield words, sizes, 0
            words, sizes = [], []
    if words:
        yield words, sizes, 0


class _WordHash(dict):
    """64-bit hashes of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _inside(sizes: list[int], n: int, seen: int) -> np.ndarray:
    """Which pairs of neighbours lie within a piece and hold a word that was not seen before."""
    inside = np.ones(max(n - 1, 0), dtype=bool)
    ends = np.cumsum(sizes[:-1], dtype=np.int64) - 1
    inside[ends] = False
    if seen > 1:
        inside[: seen - 1] = False
    return inside


class Filter:
    """A bit for each value of the first bits of a hash: may it be frequent?"""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.unused = _U(64 - (8 * len(bits)).bit_length() + 1)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        at = found >> self.unused
        return ((self.bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool)


def hashes(words: list[bytes], known: _WordHash, lang: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words alone, of the words in their language and of each pair of neighbours, piece borders included."""
    plain = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    single = _mix(plain + _U(lang))
    return plain, single, _mix(single[:-1] * _U(3) + plain[1:])


def longer(plain: np.ndarray, pairs: np.ndarray, passed: np.ndarray, longest: int, also: Filter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(n, hashes, passed)`` for phrases of 3 and more words, by first word: those whose parts passed, and ``also`` lets through."""
    found = pairs
    for n in range(3, longest + 1):
        if len(passed) < 2:
            return
        found = _mix(found[:-1] * _U(3) + plain[n - 1 :])
        passed = passed[:-1] & passed[1:]
        if also is not None:
            passed = passed & also(found)
        yield n, found, passed


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        for piece in pieces(batch):
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(piece.column("lang").to_pylist(), raw(piece)):
                held.setdefault(lang, []).append(text)
            yield from held.items()


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.add.reduceat(counts, first)


def _packed(values: np.ndarray, counts: np.ndarray, base: int) -> tuple[bytes, bytes]:
    """Sorted hashes as steps of four bytes (of eight, should one be too large), and their counts."""
    steps = np.diff(values, prepend=_U(base))
    return steps.astype("<u4" if int(steps.max()) < 1 << 32 else "<u8").tobytes(), counts.astype("<u4").tobytes()


def _unpacked(steps: bytes, counts: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    width = len(steps) // len(n)
    return np.cumsum(np.frombuffer(steps, f"<u{width}"), dtype=np.uint64) + _U(base), n


def frequent_hashes(docs: DataFrame, longest: int, min_count: int, shorter: bytes | None = None) -> bytes:
    """The bits of a ``Filter`` of what occurs ``min_count`` times: words and pairs, or, given their filter, longer phrases of
    pairs that pass.

    Hashes are shortened to ``HASH_BITS``; two that fall together can only let too much through.
    """
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(max(6, (2 * shuffle - 1).bit_length()), 16)
    sent = spark.sparkContext.broadcast(shorter) if shorter is not None else None
    low = HASH_BITS - part_bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = _WordHash(), [], 0
        may_be = Filter(sent.value) if sent is not None else None

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            values, counts = np.unique(every >> _U(64 - HASH_BITS), return_counts=True)
            edges = np.searchsorted(values, np.arange(1, 1 << part_bits, dtype=np.uint64) << _U(low))
            cut = [(k, *_packed(v, c, k << low)) for k, (v, c) in enumerate(zip(np.split(values, edges), np.split(counts, edges))) if len(v)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cut), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "steps", "counts"])

        for lang, texts in _by_lang(batches):
            salt = xxhash.xxh64_intdigest(lang)
            for words, sizes, seen in blocks(texts, longest):
                plain, single, pairs = hashes(words, known, salt)
                if may_be is None:
                    held += [single[seen:], pairs[_inside(sizes, len(words), seen)]]
                    n += len(held[-2]) + len(held[-1])
                else:
                    passed = _inside(sizes, len(words), 0) & may_be(pairs)
                    for size, found, good in longer(plain, pairs, passed, longest):
                        good[: max(0, seen - size + 1)] = False
                        held.append(found[good])
                        n += len(held[-1])
                if n >= HELD_HASHES:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def gather() -> None:
            nonlocal held, n
            held = [_summed(np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held]))]
            n = 0

        def bits() -> pa.RecordBatch:
            gather()
            frequent = held[0][0][held[0][1] >= min_count]
            here = (frequent >> _U(HASH_BITS - FILTER_BITS)) - (_U(now) << _U(FILTER_BITS - part_bits))
            flags = np.zeros(1 << (FILTER_BITS - part_bits), dtype=np.uint8)
            flags[here.astype(np.int64)] = 1
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()])], names=["part", "bits"])

        for batch in batches:
            for part, steps, counts in zip(batch.column("part").to_pylist(), batch.column("steps"), batch.column("counts")):
                if held and part != now:
                    yield bits()
                    held, n = [], 0
                now = part
                held.append(_unpacked(steps.as_buffer(), counts.as_buffer(), part << low))
                n += len(held[-1][0])
                if n >= HELD_HASHES:
                    gather()
        if held:
            yield bits()

    dealt = docs.mapInArrow(hashed, "part int, steps binary, counts binary").repartition(shuffle, "part").sortWithinPartitions("part")
    out = np.zeros((1 << part_bits, 1 << (FILTER_BITS - part_bits - 3)), dtype=np.uint8)
    for row in dealt.mapInArrow(counted, "part int, bits binary").collect():  # 2^FILTER_BITS bits in all
        out[row.part] = np.frombuffer(row.bits, dtype=np.uint8)
    if sent is not None:
        sent.destroy()
    return out.tobytes()


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, words, a)``: every phrase of 1 to ``longest`` words with ``min_count`` occurrences or more.

    The row of a language without words (null) counts all its word occurrences.
    """
    spark = docs.sparkSession
    short = frequent_hashes(docs, longest, min_count)
    sent = spark.sparkContext.broadcast((short, frequent_hashes(docs, longest, min_count, short)))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces_of = 4 * shuffle

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, total = _WordHash(), {}, Counter()
        may_be, may_be_longer = (Filter(bits) for bits in sent.value)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                parts: dict[int, list[bytes]] = {}
                for phrase in found:
                    parts.setdefault(xxhash.xxh32_intdigest(phrase) % pieces_of, []).append(phrase)
                rows = [(lang, k, b"\n".join(own), np.array([found[p] for p in own], dtype="<i8").tobytes()) for k, own in parts.items()]
                if rows:
                    yield packed(rows)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["lang", "part", "phrases", "counts"])

        for lang, texts in _by_lang(batches):
            salt = xxhash.xxh64_intdigest(lang)
            found = held.setdefault(lang, Counter())
            for words, sizes, seen in blocks(texts, longest):
                total[lang] += len(words) - seen
                plain, single, pairs = hashes(words, known, salt)
                found.update([words[i] for i in (np.flatnonzero(may_be(single[seen:])) + seen).tolist()])
                # pairs seen before still open phrases that go on in new words
                passed = _inside(sizes, len(words), 0) & may_be(pairs)
                for n, good in [(2, passed), *((n, good) for n, _, good in longer(plain, pairs, passed, longest, may_be_longer))]:
                    starts = np.flatnonzero(good)
                    found.update([b" ".join(words[i : i + n]) for i in starts[starts + n > seen].tolist()])
            if sum(map(len, held.values())) > HELD_PHRASES:
                yield from flush()
                held = {}
        yield from flush()
        if total:
            yield packed([(lang, -1, b"", np.array([n], dtype="<i8").tobytes()) for lang, n in total.items()])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def frequent() -> Iterator[pa.RecordBatch]:
            lang, part = now
            keys = [p for p, n in held.items() if part < 0 or n >= min_count]
            phrases = pa.nulls(len(keys), pa.string()) if part < 0 else pa.array(keys, pa.binary()).cast(pa.string())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), phrases, pa.array([held[p] for p in keys], pa.int64())], names=["lang", "phrase", "a"])

        for batch in batches:
            for lang, part, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "phrases", "counts"))):
                if (lang, part) != now:
                    if held:
                        yield from frequent()
                    now, held = (lang, part), {}
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(counts, dtype="<i8").tolist()):
                    held[phrase] = held.get(phrase, 0) + n
        if held:
            yield from frequent()

    # counts travel packed, by language and a hash of the phrase
    dealt = docs.mapInArrow(counted, "lang string, part int, phrases binary, counts binary").repartition(shuffle, "lang", "part").sortWithinPartitions("lang", "part")
    frequent = dealt.mapInArrow(added, "lang string, phrase string, a long")
    out = written(frequent.select("lang", F.split("phrase", " ", -1).alias("words"), "a"), "phrases")
    sent.destroy()
    return out


def lockstep(counts: DataFrame, longest: int = LONGEST, backward: bool = False) -> DataFrame:
    """``(lang, words, a, parts, extension)`` for phrases of two words or more.

    ``parts`` holds the counts of the phrase's prefixes of 1, 2, … words, ``extension`` the greatest count of a phrase
    that is one word longer at the end (0: none). ``backward``: of its suffixes, and longer at the start. Needs all prefixes
    (suffixes) of a phrase in ``counts``; a count is never above that of a part.
    """
    spark = counts.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.reverse("words") if backward else F.col("words")
    stream = counts.where("words is not null").select("lang", key.alias("words"), "a")
    laid = stream.repartitionByRange(shuffle, "lang", "words").sortWithinPartitions("lang", "words")
    names = ["pid", "lang", "words", "a", "parts", "extension", "open"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        stack: list[list | None] = [None] * (longest + 1)  # by length: the open phrase
        lead = [0] * (longest + 1)  # by length: greatest extension here of a phrase that lies in an earlier part
        alive, before, lang_before = -1, None, None
        out: list[tuple] = []

        def close(above: int, still: bool = False) -> None:
            for n in range(longest, above, -1):
                if stack[n] is not None:
                    lang, words, a, parts, best = stack[n]
                    if n > 1:
                        out.append((pid, lang, words, a, parts, best, n if still else 0))
                    if not still:
                        stack[n] = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for lang, words, a in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "a"))):
                n = len(words)
                if before is None:
                    alive = n - 1
                else:
                    shared = 0
                    if lang == lang_before:
                        for x, y in zip(words, before):
                            if x != y:
                                break
                            shared += 1
                    close(min(shared, n - 1))
                    alive = min(alive, shared, n - 1)
                if n - 1 > alive:
                    if n > 1:
                        stack[n - 1][4] = max(stack[n - 1][4], a)
                else:
                    lead[n - 1] = max(lead[n - 1], a)
                parts = [stack[k][2] if stack[k] is not None else None for k in range(1, n)]
                stack[n] = [lang, words, a, parts, 0]
                before, lang_before = words, lang
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if before is not None:
            held = [None if e is None else e[2] for e in stack[1:]]
            close(0, still=True)
            out.append((pid, None, None, alive, held, None, None))
            out.append((pid, None, None, None, lead, None, None))
        if out:
            yield batch_of(out)

    scanned = written(laid.mapInArrow(walk, "pid int, lang string, words array<string>, a long, parts array<long>, extension long, open int"), "layout")
    # two rows per part: how far its opening phrases reach back and what is open at its end; extensions found for those before
    ends, leads = {}, {}
    for row in scanned.where("words is null").collect():
        if row.a is not None:
            ends[row.pid] = (row.a, list(row.parts))
        else:
            leads[row.pid] = list(row.parts)
    context, state = {}, [None] * longest
    for pid in sorted(ends):
        context[pid] = list(state)
        alive, held = ends[pid]
        state = [state[k] if k < alive else held[k] for k in range(longest)]
    following, state = {}, [0] * longest
    for pid in sorted(ends, reverse=True):
        following[pid] = list(state)
        alive, lead = ends[pid][0], leads[pid]
        state = [max(lead[k + 1], state[k]) if k < alive else lead[k + 1] for k in range(longest)]
    pids = sorted(ends)
    carried = pa.table({"pid": pa.array(pids, pa.int32()), "context": pa.array([context[p] for p in pids], pa.list_(pa.int64())), "following": pa.array([following[p] for p in pids], pa.list_(pa.int64()))})
    met = scanned.where("words is not null").join(F.broadcast(spark.createDataFrame(carried)), "pid")  # a row per part
    parts = F.transform("parts", lambda x, k: F.coalesce(x, F.get("context", k)))
    longer = F.when(F.col("open") > 0, F.greatest("extension", F.get("following", F.col("open") - 1))).otherwise(F.col("extension"))
    words = F.reverse("words") if backward else F.col("words")
    return met.select("lang", words.alias("words"), "a", parts.alias("parts"), longer.alias("extension"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    covered: int = COVERED,
    top: int = TOP,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language by score.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?]`` and line ends; words are what spaces and tabs part. Phrases
    of 2 to ``longest`` words with ``a >= min_count`` occurrences within pieces are candidates. A cut into a first part
    and a rest, with ``l`` and ``r`` occurrences, scores ``floor(2000000 * a / (l + r))``; the lowest cut counts, the
    shortest first part on ties. A candidate goes if a longer one that contains it has ``covered`` percent of its
    occurrences. Equal scores: more occurrences first, then the phrase in byte order. ``n``: words of the language.

    A null text has no words, a null language is ``und``; repeated rows count each time. No phrase, or an empty table: no rows.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    source = narrow(docs, text=text_col, lang=lang_col).select("text", lang.alias("lang"))
    counts = phrase_counts(source, longest, min_count)
    front, back = lockstep(counts, longest), lockstep(counts, longest, backward=True)
    back = back.select("lang", "words", F.col("parts").alias("rests"), F.col("extension").alias("longer_left"))
    both = front.hint("merge").join(back, ["lang", "words"])
    # the longest phrases that hold a phrase are its extensions by one word, as no count exceeds that of a part
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = both.where(F.greatest(wide("extension"), wide("longer_left")) * 100 < wide("a") * covered)
    cut = F.expr(
        """transform(sequence(1, size(parts)), k -> struct(
        cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(parts[k - 1] as decimal(20,0)) + cast(rests[size(parts) - k] as decimal(20,0))) as bigint) as score,
        k as k, parts[k - 1] as l, rests[size(parts) - k] as r))"""
    )
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.array_min(cut).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = scored.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words is null").select("lang", F.col("a").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
