"""Tries against dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest

from millrace.llm import prefixes


def ordered(rows):
    """Conversations as lists of (role, text)."""
    out = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def grafted(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(conversations):
    nodes, kids = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        own = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in kids
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(seed, n=40, longest=30):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, longest])):
            text = rng.choice(["hi", "hé", "", None, "a much longer text " * 3]) if t < 2 else rng.choice(["x", "y"])
            rows.append((c * 3 % 101, rng.choice([t, t, None, t // 2]), rng.choice(["user", "assistant", None, ""]) if t % 5 == 4 else "user", text))
    return rows + [rows[0], rows[0], (None, 1, "user", "no conversation"), (900, None, None, None), (901, 5, None, ""), (902, 5, "u", "ser")]


def table(spark, rows):
    full = [(*r, "x", 3, b"y") for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, pos string, conv long, depth binary").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_dictionaries(spark, seed):
    rows = chats(seed)
    got = sorted((tuple(r) for r in prefixes.prefix_trie(table(spark, rows)).collect()), key=str)
    assert got == brute(ordered(rows))


def test_grafted_and_turnless(spark):
    rows = chats(3, 60)
    source = table(spark, rows)
    got = prefixes.trie(prefixes.grafted(prefixes.numbered_turns(source)), source)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(grafted(ordered(rows)))


def test_long_conversations_in_groups_of_blocks(spark, monkeypatch):
    """A conversation that holds most rows is spread over parts, blocks and groups of blocks; ids are joined in stretches."""
    monkeypatch.setattr(prefixes, "GROUP", 3)
    monkeypatch.setattr(prefixes, "IDS", 2)
    rng = random.Random(5)
    turns = [("user" if k % 2 else "assistant", rng.choice("ab")) for k in range(150)]
    rows = [(7, k, *t) for k, t in enumerate(turns)]
    for c, cut in ((8, 149), (3, 150), (11, 64), (12, 24), (13, 150), (14, 150), (15, 0)):
        rows += [(c, k, *t) for k, t in enumerate(turns[:cut])]
        if c == 11:
            rows += [(c, 1000 + k, "user", "other") for k in range(40)]
    got = sorted((tuple(r) for r in prefixes.prefix_trie(table(spark, rows)).collect()), key=str)
    assert got == brute(ordered(rows))


def test_empty_tables(spark):
    empty = table(spark, [(1, 1, "u", "t")]).where("false")
    assert prefixes.prefix_trie(empty).count() == 0
    members = spark.createDataFrame([(4,), (3,), (None,), (4,)], "conv_id long")
    (root,) = prefixes.prefix_trie(empty, members).collect()
    assert tuple(root)[:7] == (3, 0, None, 2, 0, 1, 0) and root.ends_sha256 == hashlib.sha256(b"3,4").hexdigest()
