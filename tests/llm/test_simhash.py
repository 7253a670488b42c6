"""Fingerprints bit by bit, links by all pairs, groups by a plain union."""

import random
import re

import pytest
from llm_fixtures import documents  # noqa: F401
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=3):
    """Smallest id reachable, by repeated merging over all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(prints))]


def near_texts(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice([2, 30, 400]))) for _ in range(12)]
    rows = []
    for k in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "Z" * rng.randint(1, 3)
        rows.append((k * 2 + 1, " ".join(words) if rng.random() < 0.9 else " ".join(words).upper()))
    return rows + [(500, None), (501, ""), (502, " \t"), (7, rows[0][1]), (None, rows[1][1]), (None, "quite alone"), (503, "one"), (504, "one  two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    rows = near_texts(seed)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(prints, brute_groups(prints)))
    got = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_one_of_each_group_stays(documents):
    rows = near_texts(3)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    groups = brute_groups(prints)
    table = documents(rows)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in groups if c is not None}) and ids.count(None) == 2
    assert simhash.keep_one(documents([])).count() == 0 and simhash.near_duplicates(documents([])).count() == 0


def test_links_of_random_balls(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(8):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = [p - (p >> 63 << 64) for p in sorted(prints)]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    with pytest.raises(ValueError, match="distances"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 200), (200, 300), (5, 5)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 130)} | {(200, 200), (300, 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
