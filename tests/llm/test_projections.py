"""Links and groups against all pairs."""

import math

import numpy as np
import pytest

from millrace.llm import projections


def brute(rows, cosine=0.93):
    def ok(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, dtype=float) / np.linalg.norm(v) if label is not None and ok(v) else None for _, v, label in rows]
    n = len(rows)
    near = [[b for b in range(n) if b != a and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine] for a in range(n)]
    group = [r[0] for r in rows]
    while True:
        new = [min([g, *(group[b] for b in near[a])], key=lambda x: math.inf if x is None else x) for a, g in enumerate(group)]
        if new == group:
            return sorted(((r[0], len(near[a]), group[a], r[0] == group[a]) for a, r in enumerate(rows)), key=str)
        group = new


def clustered(seed, groups=12, size=9, dim=16, noise=0.12):
    rng = np.random.default_rng(seed)
    rows, k = [], 100
    for g in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((k, (centre + noise * rng.standard_normal(dim)).astype(np.float32).tolist(), int(g % 3)))
            k = k * 7919 % 100_003
    rows += [(i, rng.standard_normal(dim).astype(np.float32).tolist(), 1) for i in range(200_000, 200_060)]
    same = rows[3]
    rows += [(300_000 + i, same[1], same[2]) for i in range(20)] + [(310_000, same[1], 9), (310_001, same[1], None), (310_002, [2 * x for x in same[1]], same[2])]
    rows += [(320_000, None, 1), (320_001, [], 1), (320_002, [0.0] * dim, 1), (320_003, [None] + same[1][1:], same[2]), (320_004, [math.nan] + same[1][1:], same[2])]
    return rows + [(320_005, [math.inf] + same[1][1:], same[2]), (320_006, same[1][:-1], same[2]), (320_007, same[1][:-1], same[2]), (None, rows[0][1], rows[0][2]), (None, [1.0] * dim, 77)]


def table(spark, rows):
    full = [(*r, "x", 7, 1.0) for r in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, node string, root long, vec double").repartition(5)


@pytest.mark.parametrize("noise", [0.02, 0.12, 0.25])
def test_equals_all_pairs(spark, noise):
    rows = clustered(int(noise * 100), noise=noise)
    got = projections.near_vectors(table(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_small_windows_parts_and_sides(spark, monkeypatch):
    """Parts smaller than a window and components over many blocks: the groups of 150 are found and counted whole."""
    for name, value in (("PART_ROWS", 7), ("STEP", 3), ("SIDE", 16), ("AT_ONCE", 2)):
        monkeypatch.setattr(projections, name, value)
    rows = clustered(4, groups=3, size=150, noise=0.08)[:450]
    got = projections.near_vectors(table(spark, rows), window=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_windows_do_not_depend_on_the_layout(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(rng.standard_normal((400, 3)).astype(np.float32))]
    vectors = spark.createDataFrame([(i, "0", 3, v) for i, v, _ in rows], "node long, label string, dim int, vec array<float>")

    def groups(part_rows, step):
        monkeypatch.setattr(projections, "PART_ROWS", part_rows)
        monkeypatch.setattr(projections, "STEP", step)
        found = projections.pass_links(vectors, [0, 1], 400, window=3, cosine=0.9)
        return {(r.node, r.root) for r in projections.components(found).collect()}

    whole = groups(10_000, 10_000)
    assert len(whole) > 50 and whole == groups(5, 2) == groups(2, 100) == groups(90, 7)


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just over the threshold among many others: at least nine of ten are found, nothing below it."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1_500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1_500, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    twins = 0.932 * base + math.sqrt(1 - 0.932**2) * side
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([base, twins]))]
    got = {r.vec_id: r for r in projections.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {r[0]: r for r in brute(rows)}
    links, found = sum(r[1] for r in want.values()), sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= want[k][1] for k in want) and found >= 0.95 * links


def test_passes_follow_the_table():
    assert projections.passes_for(0) == projections.passes_for(64) == 1
    assert projections.passes_for(1_000) < projections.passes_for(100_000) < projections.passes_for(10_000_000) < 100


def test_empty_table(spark):
    assert projections.near_vectors(table(spark, clustered(1)).where("false")).count() == 0
    assert [tuple(r) for r in projections.near_vectors(table(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]
