"""The relational lattice against a plain Viterbi search over the whole text, and exact round trips."""

import hashlib
import random

import pytest
from llm_fixtures import documents  # noqa: F401

from millrace.llm import sentencepieces as sp

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def viterbi(text, known):
    """Best path over the whole text at once, without units. Ties: the longest last piece."""
    if not text:
        return []
    text = " " + text
    table = dict(zip(known.surfaces, zip(known.ids, known.scores)))
    worst = min(known.scores) - sp.UNKNOWN_COST
    best = [(0.0, 0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for size in range(min(known.longest, end), 0, -1):
            id_, score = table.get(text[end - size : end], (-1, worst if size == 1 else None))
            if score is not None and (found is None or best[end - size][0] + score > found[0]):
                found = (best[end - size][0] + score, size, id_)
        best.append(found)
    out, at = [], len(text)
    while at:
        _, size, id_ = best[at]
        out.append([id_] if id_ >= 0 else [known.byte_ids[b] for b in text[at - 1].encode()] if known.byte_ids else [known.unknown])
        at -= size
    return [i for ids in reversed(out) for i in ids]


TEXTS = [
    None, "", " ", "a", "The and attion to thanedble the, anea.", "  two  spaces ", "   ", "a   ", "x\u00a0y\x1cz  \n \n", "line\nbreak\r\n\ttab ", "▁ itself", "日本語 😀 ñandú",
    "x" * 5000, "e" * 70 + " " + "0" * 33, "same same same", "same same same", "\0nul\x7f",
]


@pytest.fixture(scope="module")
def known():
    return sp.load(PIECES)


def test_equals_plain_viterbi_and_decodes(documents, known):
    rng = random.Random(5)
    letters = "aeinorst éüñ,.\n日"
    rows = list(enumerate(TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(40)]))
    rows += [(3, "a repeated id"), (None, "no id")]
    out = sp.decode(sp.encode(documents(rows), known), known).collect()
    want = sorted((str(i), viterbi(t, known), t or "") for i, t in rows if not t or len(t) < 4096)
    assert sorted((str(r.doc_id), list(r.ids), r.text) for r in out if len(r.text) < 4096) == want
    both = sp.encode(documents(rows), known, decoded=True, digest=True).collect()
    assert sorted(str(tuple(r)[:3]) for r in both) == sorted(str(tuple(r)) for r in out)
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in both)
    long = next(r for r in out if len(r.text) == 5000)
    assert long.text == "x" * 5000
    assert sp.encode(documents([]), known).count() == 0


def test_every_unit_by_shuffle(documents, known, monkeypatch):
    """No frequent units: all meet their encodings by shuffle, with the same result."""
    monkeypatch.setattr(sp, "FREQUENT", 0)
    monkeypatch.setattr(sp, "BLOCK_DOCS", 3)
    rows = list(enumerate(t for t in TEXTS if not t or len(t) < 4096))
    got = {r.doc_id: list(r.ids) for r in sp.encode(documents(rows), known).collect()}
    assert got == {i: viterbi(t, known) for i, t in rows}


def test_small_vocabulary_without_bytes(documents):
    surfaces = [" ", "a", "b", "ab", " ab", "aba", "c"]
    known = sp.vocabulary(surfaces, list(range(1, 8)), [-3.0, -2.0, -2.0, -3.5, -4.0, -4.0, -9.0], [], 0)
    rows = list(enumerate(["ab", "aba abab", "abcab", "zab", "b a  ab"]))
    got = {r.doc_id: list(r.ids) for r in sp.encode(documents(rows), known).collect()}
    assert got == {i: viterbi(t, known) for i, t in rows}
    with pytest.raises(ValueError, match="over a space"):
        sp.vocabulary(["a b"], [1], [0.0], [], 0)


def test_decoding_of_odd_ids(spark, known):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [5, -1, 10**6]), (4, [known.byte_ids[0xFF], None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sp.decode(rows, known).collect()} == {1: None, 2: "", 3: "\x02", 4: "\ufffd"}


def test_few_kept_words(documents, known, monkeypatch):
    monkeypatch.setattr(sp, "KEPT", 2)
    monkeypatch.setattr(sp, "BLOCK_DOCS", 2)
    rows = [(k, f"word{k % 7} other{k} the The") for k in range(30)] + [(50, ""), (51, None)]
    assert {r.doc_id: list(r.ids) for r in sp.encode(documents(rows, 1), known).collect()} == {i: viterbi(t, known) for i, t in rows}


def test_long_units_take_the_best_path(documents, known):
    """Stretches without a natural cut, beyond ``UNIT_CHARS``, have the ids of the whole."""
    rng = random.Random(9)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["".join(say("acgt", 9000)), "=" * 5000, " " * 5001, "x" * 5000, say("abcdefghijklmnopqrstuvwxyz", 9000)]
    texts += [say("a=\u0378", 4095), say("acgt", 4096), say("acgt", 4097), "the " + "=" * 5000 + " end", say("ab\u0378", 9000) + " " + say("acgt", 5000) + " of"]
    rows = list(enumerate(t for t in [*texts, *texts[:2]]))
    out = sp.encode(documents(rows), known, decoded=True).collect()
    assert {r.doc_id: list(r.ids) for r in out} == {i: viterbi(t, known) for i, t in rows}
    assert {r.doc_id: r.text for r in out} == dict(rows)


def test_both_ways_of_search_agree(documents, monkeypatch):
    """Equal sums and characters without a piece go the same way whether a unit is exploded or not."""
    surfaces = [" ", "a", "b", "ab", " ab", "aba", "c", "bb", "abab"]
    known = sp.vocabulary(surfaces, list(range(1, 10)), [-3.0, -2.0, -2.0, -4.0, -4.0, -6.0, -9.0, -4.0, -8.0], [], 0)
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abbac z") for _ in range(rng.randint(1, 60)))) for k in range(60)]
    monkeypatch.setattr(sp, "FREQUENT", 0)
    want = {i: viterbi(t, known) for i, t in rows}
    for chars in (0, 5, 4096):
        monkeypatch.setattr(sp, "UNIT_CHARS", chars)
        assert {r.doc_id: list(r.ids) for r in sp.encode(documents(rows), known).collect()} == want


def test_pieces_on_no_best_path_make_no_edges(known):
    """A piece worse than another cut of its characters is left out; paths, ties and unknown characters stay."""
    rng = random.Random(4)
    for _ in range(60):
        surfaces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))})
        every = sp.vocabulary(surfaces, list(range(1, len(surfaces) + 1)), [-float(rng.randint(1, 9)) for _ in surfaces], [], 0)
        some = sp.useful(every)
        assert some.worst == every.worst == min(every.scores) - sp.UNKNOWN_COST
        assert {s for s in surfaces if len(s) == 1} <= set(some.surfaces)
        found, found_in_some = sp.LongUnits(every), sp.LongUnits(some)
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(20)]
        assert [found(t) for t in texts] == [found_in_some(t) for t in texts]
    tied = sp.useful(sp.vocabulary(["a", "b", "ab", "abb", "abab"], [1, 2, 3, 4, 5], [-2.0, -2.0, -4.0, -7.0, -8.0], [], 0))
    assert tied.surfaces == ["a", "b", "ab", "abab"]  # "abb" is worse than "ab", "b"
    assert len(sp.useful(known).surfaces) < len(known.surfaces) // 2
    assert sp.useful(sp.vocabulary([], [], [], [], 0)).surfaces == []


def test_words_of_texts_in_a_row():
    """Of several spaces the others stay with the word that follows; an empty text has no words."""
    texts = ["", "a b", "  a  b ", "   ", " ", "é 日本 é", "", "b  ", "x\u00a0y\n z"]
    want = [[], ["a", "b"], ["  a", " b", ""], ["   "], [" "], ["é", "日本", "é"], [], ["b", " "], ["x\u00a0y\n", "z"]]
    listed, counts, order = sp.Units.words(texts)
    assert counts.tolist() == list(map(len, want))
    assert [listed.to_pylist()[k] for k in order.tolist()] == [w for words in want for w in words]
    assert len(set(listed.to_pylist())) == len(listed)
    assert [len(x) for x in sp.Units.words(["", ""])] == [0, 2, 0]
