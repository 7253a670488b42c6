"""Phrases against plain counting, with slices, parts and filters made tiny."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import collocations


def brute(rows, min_count, covered=80, top=2000, longest=4):
    counts, words_of = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            held = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not held:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "\x01x", "a" * 30, "x\x0by", "naïve", "b", "c"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["new york city ", "the of\t", rng.choice(words) + " ", rng.choice(words) + "  ", rng.choice(". , ; : ! ? \n \r \f".split(" "))])
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [("en", None), ("en", ""), ("fr", " . "), (None, "the of the of the of the of"), ("und", "the of"), ("", "new york new york")]


def table(spark, rows, partitions=3):
    full = [(lang, text, "x", 7, "n") for lang, text in rows]
    return spark.createDataFrame(full, "lang string, text string, phrase string, a long, words string").repartition(partitions)


@pytest.mark.parametrize(("seed", "min_count", "top"), [(1, 3, 2000), (2, 5, 4)])
def test_equals_plain_counting(spark, seed, min_count, top):
    rows = corpus(seed)
    got = collocations.collocations(table(spark, rows), min_count=min_count, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, min_count, top=top)
    assert len(want) > 10
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cut_everywhere(spark, monkeypatch):
    """Slices of a few words, flushes after a few pairs, a filter that lets most pairs pass, a hot first word over many parts."""
    for name, value in (("SLICE", 16), ("HELD_HASHES", 40), ("HELD_PHRASES", 30), ("FILTER_BITS", 9), ("HASH_BITS", 14), ("KNOWN_WORDS", 3), ("RANK_PARTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(3) + [("en", "the " + w + " city of the " * 3) for w in "abcdefghijklmnopqrstuvwxyz" for _ in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows, 5), min_count=2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(rows, 2)


def test_blocks_hold_every_phrase_once(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 8)
    text = b"Aa bb\tcc dd ee ff gg hh, ii jj\nkk. " + b"z" * 40 + b" ll"
    got = []
    for words, sizes, seen in collocations.blocks([text]):
        edges = [0, *np.cumsum(sizes)]
        for a, b in zip(edges, edges[1:]):
            piece = words[a:b]
            got += [tuple(piece[i : i + 3]) for i in range(len(piece) - 2) if a or i + 3 > seen]
    plain = [b"aa bb cc dd ee ff gg hh".split(), b"ii jj".split(), b"kk".split(), [b"z" * 40, b"ll"]]
    assert got == [tuple(p[i : i + 3]) for p in plain for i in range(len(p) - 2)]


def test_scores_beyond_64_bits_and_empty_tables(spark, monkeypatch):
    big = 5_000_000_000_000_000_000
    rows = [("en", None, big), ("en", ["a"], big), ("en", ["b"], big - 1), ("en", ["a", "b"], big - 3)]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, a long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: counts)
    (row,) = collocations.collocations(table(spark, [])).collect()
    assert (row.l, row.r, row.score) == (big, big - 1, 2000000 * (big - 3) // (2 * big - 1))
    monkeypatch.undo()
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("en", "one two")])).count() == 0
