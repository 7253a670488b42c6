"""Fixed patterns by plain reading, the field by enumeration, and accuracy on held-out stretches."""

import itertools
import re
import time

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from millrace.llm import pii


def brute_base(text):
    """The patterns as stated, matched from every place by hand."""
    out = []
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and check(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for kind, (pattern, good) in rules.items():
        at = 0
        while m := re.compile(pattern).search(text, at):
            if good(m[0]):
                out.append((kind, *m.span()))
            at = m.end()
    return sorted(out, key=lambda s: (s[1], list(rules).index(s[0])))


def check(digits):
    doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


TEXTS = [
    "", "a.b@c.d e@f g@h.i.", "1.2.3.4.5.6.7.8", "300.1.1.1 0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111 1111 1111 1111 4111 1111 1111 1111",
    "+1 (017) 555-7713.", "+49 4111111111111111", "+1 4111 1111 1111 1111 x@1.2.3.4", "+ 1", "+12", "é+1 974 555 3436é 1.2.3.4", "9" * 6000, "١٢٣.1.2.3", "a@b.c\n+1-974-555-3436\n1-2",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_patterns(text):
    if len(text) < 4000:  # int() takes no longer numbers
        assert pii.base_spans(text) == brute_base(text)
    else:
        assert pii.base_spans(text) == []


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + "@b", "@" + "a" * 10**6, "a@" * 300_000, "1." * 500_000, "+1" + " ." * 500_000, "1 " * 500_000, "a.b@c" * 200_000])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 5


def test_addresses_and_numbers_on_any_text():
    """Each at sign and each run of digits is looked at once; the patterns as stated find the same."""
    rng = np.random.default_rng(6)
    for _ in range(4_000):
        text = "".join(rng.choice(list("a@b.-1 +é2"), rng.integers(0, 24)))
        assert pii.base_spans(text) == brute_base(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_decoding_and_likelihood_equal_enumeration():
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, (pii.BUCKETS, len(pii.KINDS)))
    field = pii.Field(weights, rng.normal(0, 1, (5, 5)))
    s = pii.candidates("a 1 b2 (3)", 0, 10)
    n, score = len(s.at) - 1, field.scores(s)
    segments = {(int(i), int(j)): k for k, (i, j) in enumerate(zip(s.first, s.last))}

    def paths(i):
        if i == n:
            yield []
            return
        for rest in paths(i + 1):
            yield [(i, i, 0)] + rest
        for (a, b), _ in segments.items():
            if a == i:
                for rest in paths(b + 1):
                    for t in range(1, 5):
                        yield [(a, b, t)] + rest

    def value(path):
        types = [0] + [t for _, _, t in path]
        return sum(field.follow[a, b] for a, b in itertools.pairwise(types)) + sum(score[segments[i, j], t - 1] for i, j, t in path if t)

    every = list(paths(0))
    values = np.array([value(p) for p in every])
    best = every[int(values.argmax())]
    assert field.decode(s) == [(pii.KINDS[t - 1], s.at[i], s.at[j + 1]) for i, j, t in best if t]
    chance, pairs = pii._expectations(field, s)
    share = np.exp(values - values.max())
    share /= share.sum()
    want = np.zeros_like(chance)
    for p, x in zip(every, share):
        for i, j, t in p:
            if t:
                want[segments[i, j], t - 1] += x
    assert np.allclose(chance, want) and np.isclose(pairs.sum(), sum(x * len(p) for p, x in zip(every, share)))


def test_held_out_accuracy(spark, field):
    """Stretches of another table, unmasked: the field finds what the patterns find, and little that they would not
    take even if it stood alone (of two numbers side by side the patterns see one and drop it)."""
    hits = wrong = missed = 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 2000").select("text").collect():
        for a, b in pii.stretches(text):
            got = set(field.decode(pii.candidates(text, a, b)))
            want = {s for s in pii.base_spans(text) if a <= s[1] and s[2] <= b}
            hits, wrong, missed = hits + len(got & want), wrong + sum(pii.base_spans(text[i:j]) != [(k, 0, j - i)] for k, i, j in got - want), missed + len(want - got)
    assert hits > 500 and hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95


def test_added_spans(field):
    def added(text):
        base, spans = pii.find(text, field)
        assert set(base) <= set(spans)
        return {(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base}

    assert added("call (974) 555-3436 now") == {("phone", "(974) 555-3436")}
    assert ("email", "bob.smith [at] mail.example.com") in added("write to bob.smith [at] mail.example.com please")
    for plain in ("nothing here", "version 2.0.1 of 2024-05-06", "Licensed under CC BY-NC 4.0.", "it cost $1,000.00 in 1999", "page 12 of 300"):
        assert added(plain) == set()


def test_long_stretches_are_searched_whole(field):
    """Added spans in words and runs of words far longer than one part, also across the parts' borders."""
    phone = "(974) 555-3436"
    for filler in ("x1-" * 200, "1.5 " * 300, "z9 " * 131):
        text = f"{filler} {phone} {filler} {phone} {filler}"
        spans = [(k, text[a:b]) for k, a, b in pii.find(text, field)[1]]
        assert spans.count(("phone", phone)) == 2
        places = pii.find(text, field)[1]
        assert all(x[2] <= y[1] for x, y in zip(places, places[1:]))
    for start, end, size in ((0, 5000, 5000), (3, 900, 900)):
        parts = pii._parts("ab1." * 1300, start, end)
        covered = {k for a, b in parts for k in range(a, b)}
        assert covered == set(range(start, end)) and max(b - a for a, b in parts) <= 400 and size


def test_rows_and_redaction(documents, field):
    rows = [(1, "mail a.b@c.de now"), (1, "mail a.b@c.de now"), (2, None), (3, ""), (None, "+1 974 555 3436"), (4, "1.2.3.4 " * 9000), (5, "x" * 5000 + "1" * 5000)]
    table = documents(rows)
    got = pii.personal_data(table, field).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_phone) for r in got) == [
        ("1", 1, 0, 0), ("1", 1, 0, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 0, 9000, 0), ("5", 0, 0, 0), ("None", 0, 0, 1),
    ]
    assert next(r for r in got if r.doc_id == 1).spans == "email:5:13"
    out = pii.redact(table, field)
    assert out.columns == table.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == "mail [EMAIL] now" and texts[2] is None and texts[3] == "" and texts[None] == "[PHONE]" and texts[4] == "[IP] " * 9000
    assert pii.personal_data(documents([]), field).count() == 0
    assert pii.redacted("+1 4111 1111", [("phone", 0, 7), ("card", 3, 12)]) == "[PHONE]"


def test_long_stretches_are_decoded_jointly():
    """Parts of a stretch are units of work only: the spans are those of one decoding over the whole."""
    rng = np.random.default_rng(8)
    for _ in range(5):
        field = pii.Field(rng.normal(0, 1, (pii.BUCKETS, len(pii.KINDS))), rng.normal(0, 1, (5, 5)))
        text = "1" + "".join(rng.choice(list("1234567 .ab("), 1500)) + "1"
        base, both = pii.find(text, field)
        want = []
        for a, b in pii.stretches(text):
            want += field.decode(pii.candidates(text, a, b, base))
        assert max(b - a for a, b in pii.stretches(text)) > 400
        assert both == sorted(base + want, key=lambda s: (s[1], pii.KINDS.index(s[0])))
