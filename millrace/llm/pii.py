"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments by features of the whole span (its shape, digit groups, check digits,
what stands beside it) and of the types that follow each other. A search over segments of bounded length
chooses boundaries and types together. Only words that hold a digit or an at sign, in figures or in
brackets, can be part of an entity; stretches without one are not searched.

Its training data are a bounded number of stretches of the corpus, labelled by the fixed patterns, with variants
that those patterns miss (numbers without a plus, bracketed at signs) and figures that are no personal data.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, per_piece, pieces

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of an entity, buckets of the hashed features.
MAX_TOKENS, BUCKETS = 24, 1 << 14
#: Documents that training stretches are taken from, most stretches, rounds over them.
FIT_DOCS, FIT_STRETCHES, ROUNDS = 4_000, 240, 8
RATE, DECAY = 0.5, 1e-4
#: Characters on both sides of a training stretch.
AROUND = 24

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that opened inside a run of digits would have opened at its start
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds, from each at sign on: what stands before it back to the
    match before, then a host."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = done


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind, by start and then kind."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- stretches and segments

#: A sign that a word may be part of an entity: a digit, an at sign or one spelled in brackets.
_TRIGGER = re.compile(r"[0-9@]|[\[({] ?(?:at|AT) ?[\])}]")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.DOTALL)


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal runs of words with a trigger, joined over words of at most three characters."""
    found: list[list[int]] = []
    end = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        rest = _CHUNK.match(text, m.end() - 1)
        end = max(m.end(), rest.end() if rest else 0)
        if found and start - found[-1][1] <= 5 and all(len(w) <= 3 for w in text[found[-1][1] : start].split()) and "\n" not in text[found[-1][1] : start]:
            found[-1][1] = end
        elif found and "(at)" in re.sub(r"[\[{]", "(", text[start:end].lower()) and start - found[-1][1] <= 1:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    """Take in a word on both sides where a spelled at sign stands alone between spaces."""
    if re.search(r"[\[({] ?(?:at|AT) ?[\])}]", text[start:end]):
        left = re.search(r"\S+\s?$", text[max(0, start - 80) : start])
        right = re.match(r"\s?\S+", text[end : end + 120])
        start -= len(left[0]) if left else 0
        end += len(right[0]) if right else 0
    return start, end


def _shape(text: str) -> str:
    """Runs of digits, letters and spaces as one sign each; other characters stay."""
    out = []
    for c in text:
        s = "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c
        if not out or out[-1] != s or s not in "9a_":
            out.append(s)
    return "".join(out)


def _side(c: str) -> str:
    return "none" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


def features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of one whole span."""
    span = text[start:end]
    digits = _digits(span)
    n = len(digits)
    shape = _shape(span)
    groups = re.findall(r"[0-9]+", span)
    octets = len(groups) == 4 and all(map(_octet, groups)) and span.count(".") == 3 and n + 3 == len(span)
    host = re.search(r"(?:@|[\[({] ?(?:at|AT) ?[\])}] ?)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)$", span)
    pure = not re.search(r"[^0-9 ().+/-]", span)
    long = n if n < 10 else 10 if n < 13 else 13 if n < 14 else 14 if n < 17 else 17 if n < 20 else 20
    left, right = _side(text[start - 1 : start]), _side(text[end : end + 1])
    word = re.search(r"([^\W\d_]+)\W*$", text[max(0, start - 20) : start])
    names = [
        "bias",
        f"shape={shape if len(shape) < 24 else 'long'}",
        f"digits={long}",
        f"pure={pure} digits={long} groups={min(len(groups), 6)}",
        f"luhn={pure and 14 <= n <= 19 and luhn(digits)}",
        f"octets={octets}",
        f"host={bool(host)} one={span.count('@') + len(re.findall('at', span)) == 1} open={span[:1].isalnum()}",
        f"plus={span[:1] == '+'} digits={long}",
        f"phone={pure} {long in (10, 13)} {shape[:6]}",
        f"left={left}",
        f"right={right}",
        f"cut={left in '9a' or right in '9a' or (right in '.-@' and text[end + 1 : end + 2].isalnum()) or left in '+@-.'}",
        f"ends={_side(span[0])}{_side(span[-1])} pure={pure}",
        f"sizes={','.join(str(min(len(g), 5)) for g in groups[:6]) if pure else 'no'}",
        f"word={word[1].lower() if word else ''}",
    ]
    return [crc32(x.encode()) % BUCKETS for x in names]


@dataclass
class Stretch:
    """Candidate segments of one stretch: token places and features."""

    at: list[int]  # where tokens start, and the end
    first: np.ndarray
    last: np.ndarray
    rows: np.ndarray


def candidates(text: str, start: int, end: int, taken: Iterable[Span] = ()) -> Stretch:
    """Segments of up to ``MAX_TOKENS`` tokens that hold a trigger, begin with a letter, a digit, ``+`` or ``(``, end
    with a letter, a digit or ``)``, and touch no span that is taken."""
    at = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
    n = len(at) - 1
    opens = [text[at[k]].isalnum() or text[at[k]] in "+(" for k in range(n)]
    closes = [text[at[k]].isalnum() or text[at[k]] == ")" for k in range(n)]
    barred = [any(a < at[k + 1] and at[k] < b for _, a, b in taken) for k in range(n)]
    trigger = np.zeros(n + 1, dtype=np.int64)
    for m in _TRIGGER.finditer(text, start, end):
        trigger[int(np.searchsorted(at, m.start(), side="right")) - 1 + 1] += 1
    trigger = np.cumsum(trigger)
    first, last, rows = [], [], []
    for i in range(n):
        if not opens[i] or barred[i]:
            continue
        for j in range(i, min(n, i + MAX_TOKENS)):
            if barred[j]:
                break
            if closes[j] and trigger[j + 1] > trigger[i] and (j > i or at[j + 1] - at[i] > 6):
                first.append(i)
                last.append(j)
                rows.append(features(text, at[i], at[j + 1]))
    return Stretch(at, np.array(first, dtype=np.int64), np.array(last, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(len(rows), len(rows[0]) if rows else 0))


@dataclass
class Field:
    """Weights of span features by type, and of a type (0: none) before a type."""

    weights: np.ndarray
    follow: np.ndarray

    def scores(self, s: Stretch) -> np.ndarray:
        return self.weights[s.rows].sum(axis=1) if len(s.rows) else np.zeros((0, len(KINDS)))

    def decode(self, s: Stretch) -> list[Span]:
        """The segmentation of the highest score; single tokens of no type score 0."""
        return self.decode_blocks(s.at, [s])

    def decode_blocks(self, at: list[int], blocks: Iterable[Stretch]) -> list[Span]:
        """``decode`` of the tokens ``at`` with the candidates of all blocks, in order of their first tokens."""
        n, kinds = len(at) - 1, len(KINDS) + 1
        best = np.full((n + 1, kinds), -np.inf)
        best[0, 0] = 0
        back = np.zeros((n + 1, kinds, 2), dtype=np.int64)
        done = 0

        def reach(place: int) -> None:
            nonlocal done
            while done < place:
                step = best[done] + self.follow[:, 0]
                done += 1
                best[done, 0] = step.max()
                back[done, 0] = done - 1, step.argmax()

        for s in blocks:
            for i, j, score in zip(s.first.tolist(), (s.last + 1).tolist(), self.scores(s)):
                reach(i)
                for t in range(1, kinds):
                    step = best[i] + self.follow[:, t]
                    value = step.max() + score[t - 1]
                    if value > best[j, t]:
                        best[j, t] = value
                        back[j, t] = i, step.argmax()
        reach(n)
        out, j, t = [], n, int(best[n].argmax()) if n else 0
        while j:
            i, before = back[j, t].tolist()
            if t:
                out.append((KINDS[t - 1], at[i], at[j]))
            j, t = i, before
        return out[::-1]


def _logsum(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top, axis=axis)


def _expectations(field: Field, s: Stretch) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each segment and type, and expected counts of type pairs (forward-backward)."""
    n, kinds = len(s.at) - 1, len(KINDS) + 1
    score = field.scores(s)
    ahead = np.full((n + 1, kinds), -np.inf)
    ahead[0, 0] = 0
    behind = np.full((n + 1, kinds), -np.inf)
    behind[n] = 0
    ends: dict[int, list[int]] = {}
    begins: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(zip(s.first.tolist(), s.last.tolist())):
        ends.setdefault(j + 1, []).append(k)
        begins.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j, 0] = _logsum(ahead[j - 1] + field.follow[:, 0])
        for k in ends.get(j, ()):
            into = _logsum(ahead[int(s.first[k])][:, None] + field.follow[:, 1:], axis=0) + score[k]
            ahead[j, 1:] = np.logaddexp(ahead[j, 1:], into)
    for i in range(n - 1, -1, -1):
        behind[i] = field.follow[:, 0] + behind[i + 1, 0]
        for k in begins.get(i, ()):
            on = field.follow[:, 1:] + score[k] + behind[int(s.last[k]) + 1, 1:]
            behind[i] = np.logaddexp(behind[i], _logsum(on, axis=1))
    total = _logsum(ahead[n])
    pairs = np.zeros((kinds, kinds))
    for j in range(1, n + 1):
        pairs[:, 0] += np.exp(ahead[j - 1] + field.follow[:, 0] + behind[j, 0] - total)
    chance = np.zeros((len(s.first), len(KINDS)))
    for k, (i, j) in enumerate(zip(s.first.tolist(), s.last.tolist())):
        both = np.exp(ahead[i][:, None] + field.follow[:, 1:] + score[k] + behind[j + 1, 1:] - total)
        pairs[:, 1:] += both
        chance[k] = both.sum(axis=0)
    return chance, pairs


Example = tuple[str, int, int, list[Span]]


def train(examples: list[Example], rounds: int = ROUNDS) -> Field:
    """Maximise the likelihood of labelled segmentations by gradient steps, one stretch at a time.

    An example is a text, the stretch of it that is segmented, and the spans in that.
    """
    kinds = len(KINDS) + 1
    field = Field(np.zeros((BUCKETS, len(KINDS))), np.zeros((kinds, kinds)))
    field.weights[crc32(b"bias") % BUCKETS] = -2.0
    prepared = []
    for text, start, end, spans in examples:
        s = candidates(text, start, end)
        place = {p: k for k, p in enumerate(s.at)}
        number = {(int(i), int(j)): k for k, (i, j) in enumerate(zip(s.first, s.last))}
        gold = np.zeros((len(s.first), len(KINDS)))
        path, at = [], 0
        for kind, a, b in sorted(spans, key=lambda x: x[1]):
            key = (place.get(a, -1), place.get(b, 0) - 1)
            if key not in number or key[0] < at:
                break
            gold[number[key], KINDS.index(kind)] = 1
            path += [0] * (key[0] - at) + [KINDS.index(kind) + 1]
            at = key[1] + 1
        else:
            path += [0] * (len(s.at) - 1 - at)
            pairs = np.zeros((kinds, kinds))
            np.add.at(pairs, ([0, *path[:-1]], path), 1)
            if len(s.first):
                prepared.append((s, gold, pairs))
    sums = [np.full_like(field.weights, 1e-6), np.full_like(field.follow, 1e-6)]
    for turn in range(rounds):
        for k in np.random.default_rng(turn).permutation(len(prepared)):
            s, gold, pairs = prepared[k]
            chance, expected = _expectations(field, s)
            step = gold - chance
            live = np.flatnonzero(np.abs(step).max(axis=1) > 1e-4)
            rows, inverse = np.unique(s.rows[live], return_inverse=True)
            grad = np.zeros((len(rows), len(KINDS)))
            np.add.at(grad, inverse.reshape(len(live), s.rows.shape[1]), step[live][:, None, :])
            grad -= DECAY * field.weights[rows]
            sums[0][rows] += grad**2
            field.weights[rows] += RATE * grad / np.sqrt(sums[0][rows])
            grad = pairs - expected - DECAY * field.follow
            sums[1] += grad**2
            field.follow += RATE * grad / np.sqrt(sums[1])
    return field


def variants(example: Example) -> list[Example]:
    """A labelled stretch in forms that the fixed patterns miss."""
    text, start, end, spans = example
    out = []
    for kind, old, new in (("phone", "+", ""), ("email", "@", " [at] "), ("email", "@", " (at) "), ("email", "@", "(at)")):
        changed, moved, shift = text, [], 0
        for k, a, b in spans:
            a, b = a + shift, b + shift
            span = changed[a:b]
            if k == kind:
                span = re.sub(r"^\+[0-9]{1,2}[ -]*", "", span) if old == "+" else span.replace(old, new)
                if k == "phone" and not 10 <= len(_digits(span)) <= 15:
                    continue
                changed = changed[:a] + span + changed[b:]
                shift += len(span) - (b - a)
            moved.append((k, a, a + len(span)))
        if changed != text:
            out.append((changed, start, end + shift, moved))
    return out


#: Figures that are no personal data, as patterns in which 9 stands for any digit.
PLAIN = (
    "version 9.9.9", "9999-99-99", "99:99:99", "$9,999.99", "99.9%", "page 999", "no. 99999999", "999999999999", "9999999999999999",
    "9.99 x 99", "999.999.999.999", "2.9", "9.9,", "CC BY-NC 9.9.", "(9999)", "9/9/9999", "@handle", "x@y", "v9.9.9.9.9", "99-99", "9 999 999", "of 9999-99-99", "in 9999-9999", "$9,999,999.99", "9999999999", "999-99-999", "9999-9999-9999-9999", "9999 9999 9999 9999",
)


#: Forms of personal data that a corpus may lack, labelled by the fixed patterns; w stands for a word.
FORMS = (
    "w@w.org", "w.w@w.w.com", "w_99@w-w.net", "w99@w.de", "w.w@w.example.com", "+99 99 9999 9999", "+9-999-999-9999", "+9 999 999 9999",
    "+99 (999) 999-9999", "+9 (999) 999-9999", "99.9.99.9", "9.99.99.9", "199.199.199.199", "99.199.9.199", "199.9.199.99",
)


def form_examples(like: list[str], seed: int = 1, each: int = 3) -> list[Example]:
    """Such forms between words of the given texts, and their variants."""
    rng = np.random.default_rng(seed)
    around = sorted({w for t in like for w in re.findall(r"[a-z]{2,}", t)}) or ["a"]
    out: list[Example] = []
    for form in FORMS * each:
        body = re.sub("w", lambda _: around[rng.integers(len(around))], re.sub("9", lambda _: str(rng.integers(0, 10)), form))
        before, after = (around[rng.integers(len(around))] for _ in range(2))
        text = f"{before} {body} {after}"
        example = (text, len(before) + 1, len(before) + 1 + len(body), base_spans(text))
        out += [example, *variants(example)]
    return out


def plain_examples(like: list[str], seed: int = 0, each: int = 4) -> list[Example]:
    """Such figures, alone and in twos, between words of the given texts."""
    rng = np.random.default_rng(seed)
    around = sorted({w for t in like for w in re.findall(r"[^\W\d_]{2,}", t)}) or ["a"]
    out = []
    for pattern in PLAIN * each:
        other = PLAIN[rng.integers(len(PLAIN))] if rng.random() < 0.5 else ""
        body = "".join(str(rng.integers(0, 10)) if c == "9" else c for c in f"{pattern} {other}".strip())
        before, after = (around[rng.integers(len(around))] for _ in range(2))
        text = f"{before} {body} {after}"
        if not base_spans(text):
            out.append((text, len(before) + 1, len(before) + 1 + len(body), []))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on at most ``FIT_STRETCHES`` stretches of at most ``FIT_DOCS`` documents, both taken by hash."""
    source = narrow(docs, id=id_col, text=text_col)
    some = source.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(FIT_DOCS)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                found = [
                    (text[max(0, a - AROUND) : b + AROUND], min(a, AROUND), min(a, AROUND) + b - a)
                    for text in piece.column("text").to_pylist()
                    for a, b in stretches(text or "")
                    if b - a <= 200
                ]
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(("text", "start", "end"), map(list, zip(*found)))))

    found = source.join(F.broadcast(some), "id").select("text").mapInArrow(run, "text string, start long, end long").distinct()
    rows = found.orderBy(F.xxhash64("text", "start"), "text", "start", "end").limit(FIT_STRETCHES).collect()  # <= FIT_STRETCHES
    return train(examples([tuple(r) for r in rows]))


def examples(found: list[tuple[str, int, int]]) -> list[Example]:
    labelled: list[Example] = []
    for text, start, end in found:
        spans = [s for s in base_spans(text) if start <= s[1] and s[2] <= end]
        if all(a[2] <= b[1] for a, b in zip(spans, spans[1:])):
            example = (text, start, end, spans)
            labelled += [example, *variants(example)]
    texts = [t for t, _, _ in found]
    return labelled + plain_examples(texts) + form_examples(texts)


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order of start and kind: the field adds some where no base span is."""
    base = base_spans(text)
    starts = [s[1] for s in base]
    reach = list(accumulate((s[2] for s in base), max))  # how far the spans up to each one go
    added: list[Span] = []
    for a, b in stretches(text):
        a, b = _widened(text, a, b)
        # nothing is left to find where base spans hold every trigger
        held = ((bisect_right(starts, m.start()), m.start()) for m in _TRIGGER.finditer(text, a, b))
        if all(k and reach[k - 1] > at for k, at in held):
            continue
        at = [a + m.start() for m in _TOKEN.finditer(text[a:b])] + [b]

        def blocks(parts: list[tuple[int, int]], at: list[int], end: int) -> Iterable[Stretch]:
            for (first, last), (following, _) in zip(parts, [*parts[1:], (end, end)]):
                near = base[bisect_right(reach, first) : bisect_left(starts, last)]
                s, shift = candidates(text, first, last, near), bisect_left(at, first)
                own = s.first < bisect_left(at, following) - shift  # the others are the next part's
                yield Stretch(at, s.first[own] + shift, s.last[own] + shift, s.rows[own])

        before = added[-1][2] if added else 0
        added += [s for s in field.decode_blocks(at, blocks(_parts(text, a, b), at, b)) if s[1] >= before]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def _parts(text: str, start: int, end: int, most: int = 400) -> list[tuple[int, int]]:
    """A stretch in parts of at most ``most`` characters that share ``MAX_TOKENS`` tokens, so that every segment
    lies whole in one of them. A longer token can be part of no entity."""
    if end - start <= most:
        return [(start, end)]
    tokens = [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]
    out, first = [], 0
    while first < len(tokens):
        last = first
        while last < len(tokens) and tokens[last][1] - tokens[first][0] <= most:
            last += 1
        if last > first:
            out.append((tokens[first][0], tokens[last - 1][1]))
        if last == len(tokens):
            break
        first = max(first + 1, last - MAX_TOKENS)
    return out


def written_spans(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(<id_col>, n_email, n_ip, n_card, n_phone, base, spans)``.

    The counts and ``base`` are those of the fixed patterns, ``spans`` holds these and the field's, each as
    ``kind:start:end`` in code points, by start and then kind, joined by commas. A null text is empty; rows of the
    same id are searched each on its own; a null id stays null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # fixed number of weights
    source = narrow(docs, id=id_col, text=text_col)
    names = ["id", *[f"n_{k}" for k in KINDS], "base", "spans"]

    def build(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t or "", shared.value) for t in piece.column("text").to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        both = [pa.array([written_spans(f[n]) for f in found], pa.string()) for n in range(2)]
        return pa.RecordBatch.from_arrays([piece.column("id"), *counts, *both], names=names)

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return source.mapInArrow(per_piece(build), schema).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in its text; all columns and rows stay, a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # fixed number of weights

    def build(piece: pa.RecordBatch) -> pa.RecordBatch:
        at = piece.schema.get_field_index(text_col)
        texts = [t if t is None else redacted(t, find(t, shared.value)[1]) for t in piece.column(at).to_pylist()]
        return piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type))

    return docs.mapInArrow(per_piece(build, text_col), docs.schema)

