"""Counts by plain loops, the model by direct sums, separation on labelled documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from millrace.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            inside |= set(range(k, k + 8))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


TEXTS = [None, "", " \n\t ", "a", "a b c d e f g h " * 2, "x\ny\nx\n x\n\n\nx", "#|<> é\x85\xa0z \x1c w", "w " * 500, "one two " * 9 + "three", "\n".join(["same line of words here"] * 9), "é" * 3000]


def test_counts_equal_brute_force(spark, documents, data):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(0, None)]
    model = quality.Model(np.zeros(quality.BUCKETS), float("-inf"))
    rows = quality.quality(documents(docs), model).collect()
    assert len(rows) == len(docs)
    real = spark.read.parquet(f"{data}/documents.parquet")
    rows += quality.quality(real, model).collect()
    texts = dict(docs) | {}
    for r in rows[: len(docs)]:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
    by_id = {r.doc_id: r.text for r in real.collect()}
    for r in rows[len(docs) :]:
        assert tuple(r)[1:7] == brute(by_id[r.doc_id])
        assert r.kept == (not r.base_failed)


def test_model_equals_direct_sums(spark, documents):
    docs = [(k, t) for k, t in enumerate(["good words here", "good words there", "### !!! ###", "other ### words", None])]
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 0), (9, 1), (None, 1)], "doc_id long, quality long")
    model = quality.fit(documents(docs), labels, buckets=64)
    hasher = quality.Hasher(64)
    raw = Counter(b for _, t in docs for b in hasher((t or "").encode()).tolist())
    target = Counter(b for _, t in docs[:2] for b in hasher(t.encode()).tolist())
    for b in range(64):
        want = math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
        assert model.ratio[b] == pytest.approx(want)
    scores = {k: model.score(hasher((t or "").encode())) for k, t in docs}
    assert scores[2] < model.threshold < min(scores[0], scores[1])
    assert quality.fit(documents(docs), labels.limit(0)).threshold == float("-inf")
    assert quality.fit(documents([]), labels).threshold == float("-inf")
    assert quality.fit(documents(docs), labels, threshold=0.5).threshold == 0.5


def test_separates_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    marked = [(rows[r.doc_id], r.quality) for r in labels.collect()]
    good = [r.kept for r, q in marked if q == 1 and not r.base_failed]
    bad = [r.kept for r, q in marked if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}


def test_edges(documents):
    model = quality.Model(np.zeros(8), 0.0)
    assert quality.quality(documents([]), model).count() == 0 and quality.keep(documents([]), model).count() == 0
    long = " ".join(f"w{k}" for k in range(100_000))
    (row,) = quality.quality(documents([(None, long)]), model).collect()
    assert row.doc_id is None and row.n_words == 100_000 and row.n_repeat_words == 0 and row.kept
