"""The automaton against plain greedy matching."""

import random
import re

import pytest
from llm_fixtures import documents  # noqa: F401

from millrace.llm import tokens


def greedy(word, pieces, prefix):
    """Longest piece first; a character that no piece fits counts its bytes."""
    text, n = prefix + word, 0
    longest = max(map(len, pieces), default=1)
    while text:
        for size in range(min(longest, len(text)), 0, -1):
            if text[:size] in pieces:
                n, text = n + 1, text[size:]
                break
        else:
            n, text = n + len(text[0].encode()), text[1:]
    return n


@pytest.mark.parametrize("seed", range(4))
def test_equals_greedy(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randint(1, n)))
    pieces = {word(6) for _ in range(60)} | {"_" + word(4) for _ in range(20)} | {""}
    for prefix in ("", "_"):
        automaton = tokens.Automaton(pieces, prefix)
        for w in [word(30) for _ in range(400)] + ["", "zz", "azb", "日本", "é" * 500]:
            assert automaton.length(w) == greedy(w, pieces, prefix)


def test_real_vocabulary_and_rows(spark, documents, data):
    vocabulary = tokens.sentencepiece_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    known = set(vocabulary)
    rows = [(1, "The and of\nnichts"), (1, "The and of\nnichts"), (2, None), (3, ""), (None, "x" * 20_000), (4, " ".join(["Überraschung"] * 9000))]
    real = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40).collect()
    rows += [(r.doc_id + 100, r.text) for r in real]
    got = tokens.token_counts(documents(rows), vocabulary).collect()
    want = []
    for i, t in rows:
        sizes = [greedy(w, known, "▁") for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] if not t or len(t) < 20_000 else None
        if sizes is not None:
            want.append((i, len(sizes), sum(sizes), max(sizes, default=0)))
    assert sorted(tuple(r) for r in got if r.doc_id is not None and r.doc_id != 4) == sorted(want)
    assert tokens.token_counts(documents([]), vocabulary).count() == 0
    assert {r.n_tokens for r in tokens.token_counts(documents([(1, "ab")]), [], prefix="").collect()} == {2}


def test_memory_of_words_is_bounded(documents, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    rows = [(k, " ".join(f"w{j}" for j in range(k))) for k in range(30)]
    got = {r.doc_id: r.n_words for r in tokens.token_counts(documents(rows), ["w", "1"], prefix="").collect()}
    assert got == {k: k for k in range(30)}
