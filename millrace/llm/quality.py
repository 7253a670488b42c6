"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Tokens (words and runs of punctuation, lower-cased) and pairs of neighbours are hashed into buckets. Two
multinomials over the buckets are counted: one over the whole corpus, one over trusted documents. A
document's score is the mean over its n-grams of ``log p_target - log p_raw``; it is kept if the score is
at least a threshold and the base rules pass.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, pieces, raw, tidy

#: Hash buckets: the size of the model, whatever the corpus.
BUCKETS = 16_384
#: Most trusted and most distrusted documents that a model is fitted on.
FIT_ROWS = 20_000
#: Prior count of each bucket.
PRIOR = 1.0
#: Words in a window of the repetition rule.
WINDOW = 8
#: What a trusted document below the threshold costs, against a distrusted one above it.
LOSS = 100
#: Least words, greatest share of repeated words.
MIN_WORDS, MAX_REPEATED = 20, 30

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SYMBOLS = b"#*$%&|<>"
#: Tokens whose hash a task keeps; frequent ones come early.
_REMEMBERED = 100_000


class Hasher:
    """Buckets of a text's tokens and token pairs."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.seen: dict[str, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        tokens = _TOKEN.findall(text.decode().lower())
        seen = self.seen
        codes = np.empty(len(tokens), dtype=np.uint64)
        for i, t in enumerate(tokens):
            h = seen.get(t)
            if h is None:
                h = crc32(t.encode())
                if len(seen) < _REMEMBERED:
                    seen[t] = h
            codes[i] = h
        pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
        return (np.concatenate([codes, pairs]) % np.uint64(self.buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``ratio[b]`` is ``log p_target(b) - log p_raw(b)``."""

    ratio: np.ndarray
    threshold: float

    def score(self, grams: np.ndarray) -> float:
        return float(self.ratio[grams].mean()) if len(grams) else 0.0


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    chars = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(hashes, twice))  # equal hashes; the words themselves decide
    found = [tuple(words[p : p + window]) for p in places]
    count = Counter(found)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.array([p for p, w in zip(places, found) if count[w] > 1], dtype=np.int64)
    inside[starts] += 1
    np.subtract.at(inside, starts + window, 1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def _trusted(labels: DataFrame, id_col: str, quality_col: str, rows: int, quality: int) -> DataFrame:
    """At most ``rows`` distinct ids of one label, picked by a hash of the id."""
    ids = narrow(labels, id=id_col, q=quality_col).where((F.col("q") == quality) & F.col("id").isNotNull()).select("id").distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    buckets: int = BUCKETS,
    fit_rows: int = FIT_ROWS,
    threshold: float | None = None,
) -> Model:
    """Count both multinomials in one pass over the corpus.

    The raw counts cover every document. The target counts cover documents labelled 1, at most ``fit_rows``
    of them. Without a given threshold it is placed between the labelled documents: where the share of
    distrusted ones below it, less ``LOSS`` times the share of trusted ones below it, is greatest. Without documents of both labels the threshold is minus infinity: the score rejects none.
    """
    source = narrow(docs, id=id_col, text=text_col)
    good = _trusted(labels, id_col, quality_col, fit_rows, 1).withColumn("label", F.lit(1))
    bad = _trusted(labels, id_col, quality_col, fit_rows, 0).withColumn("label", F.lit(0))
    both = good.unionAll(bad).groupBy("id").agg(F.max("label").alias("label"))
    marked = source.join(F.broadcast(both), "id", "left").select("text", "label")  # <= 2 * fit_rows ids

    def count(batches):
        hasher, totals = Hasher(buckets), np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch):
                for text, label in zip(raw(piece), piece.column("label").to_pylist()):
                    found = np.bincount(hasher(text), minlength=buckets)
                    totals[0] += found
                    if label == 1:
                        totals[1] += found
        used = np.flatnonzero(totals[0])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], names=["bucket", "corpus", "target"])

    counted = marked.mapInArrow(count, "bucket long, corpus long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target")).collect()  # <= buckets
    totals = np.zeros((2, buckets))
    for bucket, corpus, target in rows:
        totals[:, bucket] = corpus, target
    if not totals[1].any():
        return Model(np.zeros(buckets), float("-inf") if threshold is None else threshold)
    p = (totals + PRIOR) / (totals.sum(axis=1, keepdims=True) + PRIOR * buckets)
    model = Model(np.log(p[1]) - np.log(p[0]), float("-inf") if threshold is None else threshold)
    if threshold is not None:
        return model
    return Model(model.ratio, _threshold(source.join(F.broadcast(both), "id"), model, buckets))


def _threshold(labelled: DataFrame, model: Model, buckets: int) -> float:
    shared = labelled.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def run(batches):
        hasher = Hasher(buckets)
        for batch in batches:
            for piece in pieces(batch):
                scores = [shared.value.score(hasher(t)) for t in raw(piece)]
                columns = [piece.column("id"), pa.array(scores, pa.float64()), piece.column("label")]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "label"])

    kind = labelled.schema["id"].dataType.simpleString()
    scored = labelled.select("id", "text", "label").mapInArrow(run, f"id {kind}, score double, label int")
    found = scored.groupBy("id").agg(F.min("score"), F.max("label")).drop("id").collect()  # <= 2 * fit_rows ids
    good = np.sort([s for s, label in found if label == 1])
    bad = np.sort([s for s, label in found if label == 0])
    if not len(good) or not len(bad):
        return float("-inf")
    cuts = np.unique(np.concatenate([good, bad]))
    right = np.searchsorted(bad, cuts) / len(bad) - LOSS * np.searchsorted(good, cuts) / len(good)
    best = int(np.argmax(right))
    below = cuts[best - 1] if best else cuts[0]
    return float((cuts[best] + below) / 2)


def _judge(text: bytes, hasher: Hasher, model: Model) -> tuple:
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
    score = model.score(hasher(text))
    return *counts, failed, score, not failed and score >= model.threshold


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, ``base_failed``, ``llr``, ``kept``.

    A null or empty text has no words and fails the base rules. Rows of the same id are judged each on
    its own; a null id stays null; an empty table gives no rows.
    """
    source = narrow(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches):
        hasher = Hasher(len(shared.value.ratio))
        for batch in batches:
            for piece in pieces(batch):
                found = [_judge(t, hasher, shared.value) for t in raw(piece)]
                columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], names=["id", *names])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names[:5]) + ", base_failed boolean, llr double, kept boolean"
    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), *names)


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def run(batches):
        hasher = Hasher(len(shared.value.ratio))
        with tidy():
            for batch in batches:
                for piece in pieces(batch, text_col):
                    mask = [_judge(t, hasher, shared.value)[-1] for t in raw(piece, text_col)]
                    yield piece.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
