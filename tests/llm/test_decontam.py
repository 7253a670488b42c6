"""Retrieval and verification against a search of every item in every text."""

import random

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from millrace.llm import decontam


def brute(docs, items, share=decontam.OVERLAP):
    """Every item against every passage of every text, without an index."""
    found = set()
    parts = [(i, *map(list, decontam.question_and_answer(t)), decontam.words(t)) for i, t in set(items)]
    parts = [p for p in parts if p[3]]
    step = max((len(p[3]) for p in parts), default=1)
    for d, text in docs:
        tokens = decontam.words(text)
        for at in range(0, max(1, len(tokens)), step):
            near = tokens[at : at + 2 * step]
            for i, question, answer, _ in parts:
                ok = True
                for part in (question, answer):
                    size = min(decontam.SHINGLE, len(part))
                    held = {tuple(near[k : k + size]) for k in range(len(near) - size + 1)}
                    own = decontam.shingles(part)
                    ok &= len(own & held) >= share * len(own) - 1e-9
                if ok:
                    found.add((d, i))
    return found


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(250)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(1, 20)) + rng.choice([". ", "? ", " "]) + say(rng.randint(0, 20))) for k in range(40)]
    items += [(40, "ab cd"), (41, ""), (42, None), (43, "?!"), items[0], (44, items[1][1]), (45, "Is it? " + say(8))]
    docs = []
    for k in range(150):
        text = say(rng.randint(0, 150))
        if rng.random() < 0.5:
            leak = rng.choice(items)[1] or ""
            if rng.random() < 0.5:  # with some words changed or left out
                leak = " ".join(w if rng.random() > 0.06 else rng.choice(vocabulary) for w in leak.split())
            text += " " + leak.upper() + ", " + say(rng.randint(0, 60))
        docs.append((k, text))
    return docs + [(900, None), (901, ""), (902, "!!"), (0, docs[0][1]), (903, items[5][1]), (904, (say(30) + " " + items[6][1] + " ") * 40)], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, documents, seed):
    docs, items = tables(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(docs)
    got = decontam.contaminated(table, bench).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 40
    assert len([r for r in got if r.doc_id == 0]) == 2 * len([w for w in want if w[0] == 0])
    assert min(r.score for r in got) >= 1 - 1e-6
    dirty = {d for d, _ in want}
    kept = decontam.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_several_indexes_and_empty_tables(spark, documents, monkeypatch):
    """Many small indexes find the same rows, with the same scores, as one."""
    docs, items = tables(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(documents(docs), bench).collect()))
    assert {(r[0], r[1]) for r in whole} == brute(docs, items)
    monkeypatch.setattr(decontam, "INDEX_WORDS", 60)
    assert len(list(decontam._indexes(bench, "item_id", "text", 0.8))) > 8
    parts = sorted(map(tuple, decontam.contaminated(documents(docs), bench).collect()))
    assert [r[:3] for r in parts] == [r[:3] for r in whole]
    assert np.allclose([r[3:] for r in parts], [r[3:] for r in whole])
    assert decontam.clean(documents(docs), bench).count() == len([d for d, _ in docs if d not in {r[0] for r in whole}])
    assert decontam.contaminated(documents([]), bench).count() == 0
    assert decontam.contaminated(documents(docs), bench.limit(0)).count() == 0
    assert decontam.clean(documents(docs), bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("step", [1, 300, 1 << 19])
def test_bounds_lose_nothing(monkeypatch, step):
    """Block-max retrieval equals scoring every item, in steps of any size."""
    monkeypatch.setattr(decontam, "EXPANDED", step)
    _, items = tables(5)
    index = decontam.Index([decontam.Item(i, *map(tuple, decontam.question_and_answer(t)), tuple(decontam.words(t))) for i, t in items if decontam.words(t)])
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, 30, 3000) * len(index.number) + rng.integers(0, len(index.number), 3000))
    p, t = code // len(index.number), code % len(index.number)
    full = np.zeros((30, len(index.items)))
    for a, b in zip(p, t):
        s = slice(index.postings[index.starts[b]], index.postings[index.starts[b + 1]])
        full[a, index.docs[s]] += index.weights[s]
    got = {(a, b): s for a, b, s in zip(*index.retrieve(p, t))}
    assert set(got) == set(zip(*map(list, np.nonzero(full >= 1 - 1e-9))))
    assert all(abs(full[k] - s) < 1e-9 for k, s in got.items())


def test_changes_in_a_short_last_sentence(spark, documents):
    """Without a question mark the whole item counts, however short its last sentence is."""
    words = [f"w{k}" for k in range(60)]
    first = " ".join(words[:50])
    bench = spark.createDataFrame([(1, f"{first}. {' '.join(words[50:54])}."), (2, f"{first}? {' '.join(words[50:54])}")], "item_id long, text string")
    docs = [(1, f"so {first}. w50 w51 typo w53. end"), (2, f"so {first}. end"), (3, f"so {' '.join(words[:40])}. end"), (4, f"{first} {' '.join(words[50:54])}")]
    got = decontam.contaminated(documents(docs), bench).collect()
    # 50 shingles, of which 40 are needed; an item with a question keeps its answer apart
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (4, 1), (4, 2)}
    assert {r.doc_id: (r.question_overlap, r.answer_overlap) for r in got if r.item_id == 1} == {1: (0.96, 0.96), 2: (0.92, 0.92), 4: (1.0, 1.0)}
    assert [r.doc_id for r in decontam.clean(documents(docs), bench).collect()] == [3]
