"""Removal of repeated strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from millrace.llm import suffix


def brute(rows, width=suffix.WIDTH):
    """Removed bytes, spans and the rest, by a dictionary of every window's first place."""
    rows = sorted({(i, (t or "").encode()) for i, t in rows})
    first = {}
    for i, t in rows:
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], (i, p))
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] != (i, p):
                gone[p : p + width] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (i, len(t), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(40), say(12)[:60]
    out = []
    for i in range(n):
        kind = rng.randint(0, 6)
        t = say(rng.randint(0, 120))
        if kind == 0 and out:
            t = rng.choice(out)[1]
        elif kind == 1 and out:  # a near copy
            t = " ".join(w if rng.random() > 0.05 else rng.choice(words) for w in (rng.choice(out)[1] or "").split(" "))
        elif kind == 2:
            t = t + passage[rng.randint(0, 40) :] + say(5)
        elif kind == 3:
            t = "\n".join([line, say(9)] * rng.randint(1, 6))
        elif kind == 4:
            t = "ab" * rng.randint(0, 200) + t
        out.append((i * 3, t))
    return out + [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 300), (1004, "\0" * 150), (1005, "\0" * 149 + "a")]


def check(docs, rows):
    got = {r[0]: tuple(r) for r in suffix.remove_repeats(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    rows = texts(seed)
    check(documents(rows), rows)


def test_small_shards_and_blocks(documents, monkeypatch):
    """Anchors that go on over many shards, texts cut into parts, runs handed on early."""
    monkeypatch.setattr(suffix, "SHARD", 700)
    monkeypatch.setattr(suffix, "BLOCK", 400)
    monkeypatch.setattr(suffix, "HELD_RUNS", 20)
    rows = texts(3, 40)
    state, cut = suffix.Shards(), []
    found = []
    for i, t in sorted(rows):
        for data, ends, _, offsets in suffix._blocks([(t or "").encode()]):
            start, windows, anchor, key = suffix.runs(data, ends)
            found += [(int(a), i, int(s + offsets[0]), data[s : s + w + 99].tobytes(), int(w)) for s, w, a in zip(start, windows, anchor)]
    found.sort()
    gone = {}
    for k in range(0, len(found), 5):
        part = found[k : k + 5]
        anchors, ids, pos = (np.array([f[j] for f in part], dtype=np.uint64 if j == 0 else np.int64) for j in range(3))
        for i, p, w in state.shard(anchors, ids, pos, [f[3] for f in part]):
            for a, b, c in zip(i, p, w):
                gone.setdefault(int(a), set()).update(range(b, b + c + 99))
    want = {i: r[2] for i, r in brute(rows).items() if r[2]}
    assert {i: len(g) for i, g in gone.items()} == want
    check(documents(rows), rows)


def test_common_grams_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(suffix, "COMMON_SHARE", 0.002)
    rows = texts(4)
    check(documents(rows), rows)


def test_edge_rows(spark, documents):
    assert suffix.remove_repeats(documents([])).count() == 0
    long = "".join(chr(97 + k * k % 26) for k in range(30)) + "é" * 100
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None), (3, long + "tail")]
    got = sorted((str(r[0]), r.n_bytes, r.n_removed) for r in suffix.remove_repeats(documents(rows)).collect())
    assert got == [("1", 230, _self(long)), ("1", 230, _self(long)), ("2", 230, 230), ("3", 234, 230), ("None", 0, 0), ("None", 230, 230)]
    kept = suffix.remove_repeats(documents([(1, "ab"), (2, None)]), with_text=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in kept} == {1: b"ab", 2: b""}
    same_id = suffix.remove_repeats(documents([(5, long), (5, long + "z"), (5, "short")])).collect()
    assert sorted(r.n_bytes for r in same_id) == [5, 230, 231] and max(r.n_removed for r in same_id) == 230


def _self(text):
    return brute([(0, text)])[0][2]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    text[1000:1400] = text[200:600]
    order = suffix.suffix_array(text)
    data = text.tobytes()
    keys = [data[i:] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(3000))
    starts, lengths = np.array([0, 700, 2000]), np.array([700, 1300, 1000])
    shared = suffix.common_prefixes(text, order, starts, lengths, 50)
    for k in range(1, 3000, 7):
        a, b, n = data[order[k - 1] :], data[order[k] :], 0
        while n < 50 and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared[k] == n
