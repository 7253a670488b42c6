"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every document is cut into passages of words that overlap, so that each stretch as long as the longest item
lies whole in one passage. A passage asks the index with its distinct words. Three bounds come before a score:
the sum of the words' largest weights anywhere, their largest weights in a block of items, then the items' scores.
An item is retrieved if the score passes its threshold: the least score that a passage can have which holds
enough of the item's question and answer. Each retrieved pair is then verified by word shingles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, pieces, tidy

#: Words of a shingle, and the share of an item's shingles that a passage must hold.
SHINGLE, OVERLAP = 5, 0.8
#: BM25 parameters, items of a block.
K1, B, BLOCK = 1.2, 0.75, 16
#: Words of the items in an index that is sent to the tasks (about 100 bytes each), blocks looked at in one step.
INDEX_WORDS, EXPANDED = 400_000, 1 << 19

_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the two parts of an item: up to the last question mark and what follows. An item that has but one
    part, as one without a question mark, is its own question and answer."""
    head, _, tail = (text or "").rpartition("?")
    question, answer = words(head), words(tail)
    return (question or answer), (answer or question)


def shingles(tokens: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of ``size`` words; of fewer words, all of them."""
    if not tokens:
        return set()
    return {tuple(tokens[k : k + size]) for k in range(max(1, len(tokens) - size + 1))}


def needed(parts: int, share: float = OVERLAP) -> int:
    """Shingles that must be found of ``parts``."""
    return -int(-parts * share // 1)


@dataclass(frozen=True)
class Item:
    id: object
    question: tuple[str, ...]
    answer: tuple[str, ...]
    tokens: tuple[str, ...]


@dataclass
class Corpus:
    """What scores need to know of all test items together, however many indexes hold them."""

    items: int
    mean: float
    longest: int
    seen: Counter  # items that hold a word

    @staticmethod
    def of(items: Iterable[Item]) -> "Corpus":
        n, words_, longest, seen = 0, 0, 1, Counter()
        for item in items:
            n += 1
            words_ += len(item.tokens)
            longest = max(longest, len(item.tokens))
            seen.update(set(item.tokens))
        return Corpus(n, max(1.0, words_ / max(1, n)), longest, seen)


def _sums(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their weights."""
    order = np.argsort(code, kind="stable")
    code, weight = code[order], weight[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
    return code[first], np.add.reduceat(weight, first) if len(first) else np.empty(0)


def _spread(starts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the places from ``starts[key]`` to ``starts[key + 1]``: ``(which key, place)``."""
    first, size = starts[key], starts[key + 1] - starts[key]
    which = np.repeat(np.arange(len(key)), size)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(size) + size, size)


class Index:
    """Postings of normalised weights: a score of 1 reaches the item's threshold. Items stand in blocks; of each word only
    the blocks that hold it are listed, with its largest weight there."""

    def __init__(self, items: list[Item], share: float = OVERLAP, corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(items)
        self.items, self.longest = items, corpus.longest
        counts = [Counter(i.tokens) for i in items]
        self.number = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        terms, docs, weights = [], [], []
        for d, (item, count) in enumerate(zip(items, counts)):
            norm = K1 * (1 - B + B * len(item.tokens) / corpus.mean)
            scores = {t: np.log1p((corpus.items - corpus.seen[t] + 0.5) / (corpus.seen[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in count.items()}
            # a passage that holds enough shingles lacks at most so many words of each part
            lost = 0
            for part in {item.question, item.answer}:
                size = len(shingles(list(part)))
                lost += size - needed(size, share)
            threshold = sum(sorted(scores.values())[: max(1, len(scores) - lost)])
            for t, s in scores.items():
                terms.append(self.number[t])
                docs.append(d)
                weights.append(s / threshold)
        order = np.lexsort((docs, terms))
        terms, self.docs, self.weights = np.array(terms, dtype=np.int64)[order], np.array(docs, dtype=np.int64)[order], np.array(weights)[order]
        self.blocks = -(-len(items) // BLOCK)
        self.most = np.zeros(len(self.number) + 1)
        np.maximum.at(self.most, terms, self.weights)
        code = terms * self.blocks + self.docs // BLOCK
        entry = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
        self.block = code[entry] % max(1, self.blocks)  # by word and block: the block, its largest weight, its postings
        self.block_most = np.maximum.reduceat(self.weights, entry) if len(entry) else np.empty(0)
        self.postings = np.append(entry, len(code))
        self.starts = np.searchsorted(code[entry], np.arange(len(self.number) + 1) * self.blocks)  # by word: its blocks

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From pairs ``(passage, term)``, distinct and sorted: ``passage, item, score`` of all scores from 1 up."""
        slack = 1 - 1e-9
        alive, bound = _sums(passage, self.most[term])
        keep = np.isin(passage, alive[bound >= slack])
        passage, term = passage[keep], term[keep]
        out = []
        # so many passages at a time that their words' blocks take bounded room
        load = np.cumsum(self.starts[term + 1] - self.starts[term])
        at = 0
        while at < len(passage):
            end = int(np.searchsorted(load, (load[at - 1] if at else 0) + EXPANDED, side="right"))
            end = int(np.searchsorted(passage, passage[min(end, len(passage) - 1)], side="left")) if end < len(passage) else end
            end = max(end, int(np.searchsorted(passage, passage[at], side="right")))
            pair, entry = _spread(self.starts, term[at:end])
            code = passage[at:end][pair] * self.blocks + self.block[entry]
            blocks, bound = _sums(code, self.block_most[entry])
            entry, code = (x[np.isin(code, blocks[bound >= slack])] for x in (entry, code))
            which, posting = _spread(self.postings, entry)
            found, score = _sums(code[which] // self.blocks * len(self.items) + self.docs[posting], self.weights[posting])
            good = score >= slack
            out.append((found[good] // len(self.items), found[good] % len(self.items), score[good]))
            at = end
        if not out:
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0)
        return tuple(np.concatenate(c) for c in zip(*out))


def _verified(item: Item, near: list[str], share: float) -> tuple[float, float] | None:
    held = shingles(near) | {tuple(near[k : k + n]) for n in {len(p) for p in (item.question, item.answer)} if n < SHINGLE for k in range(len(near) - n + 1)}
    found = []
    for part in dict.fromkeys((item.question, item.answer)):
        own = shingles(list(part))
        hits = len(own & held)
        if hits < needed(len(own), share):
            return None
        found.append(hits / len(own))
    return found[0], found[-1]


def _search(index: Index, share: float):
    step = index.longest  # passages of twice the longest item, one item apart

    def found_in(texts: list[str]) -> list[tuple[int, int, int, float, float, float]]:
        get, numbers, rows = index.number.get, [], []
        for text in texts:
            own = words(text)
            numbers.append(np.fromiter((get(w, -1) for w in own), dtype=np.int32, count=len(own)))
        lengths = np.array([len(t) for t in numbers], dtype=np.int64)
        if not lengths.sum():
            return rows
        counts = np.maximum(1, -(-lengths // step))  # passages of a text
        base = np.cumsum(counts) - counts
        term = np.concatenate(numbers)
        del numbers
        text_of = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        known = term >= 0
        term, text_of, place = term[known], text_of[known], place[known] // step
        passage = base[text_of] + place
        also = place > 0  # the passage before reaches here as well
        code = np.unique(np.concatenate([passage, passage[also] - 1]) * len(index.number) + np.concatenate([term, term[also]]))
        del term, text_of, place, passage, also
        best: dict[tuple[int, int], tuple] = {}
        tokens, held = [], -1
        for p, d, score in zip(*index.retrieve(code // len(index.number), code % len(index.number))):
            row = int(np.searchsorted(base, p, side="right") - 1)
            at = int(p - base[row]) * step
            if row != held:  # passages come in order
                tokens, held = words(texts[row]), row
            overlap = _verified(index.items[d], tokens[at : at + 2 * step], share)
            if overlap and (row, d) not in best:
                best[row, d] = (row, int(d), at, float(score), *overlap)
        return [best[k] for k in sorted(best)]

    return found_in


def read_items(items: DataFrame, item_col: str, text_col: str) -> Iterator[Item]:
    """The test items, one after another; those without a word are left out, repeated rows are one."""
    rows = narrow(items, id=item_col, text=text_col).distinct().orderBy("id", "text")
    for r in rows.toLocalIterator():
        if found := words(r.text):
            yield Item(r.id, *map(tuple, question_and_answer(r.text)), tuple(found))


def _indexes(items: DataFrame, item_col: str, text_col: str, share: float) -> Iterator[Index]:
    """Indexes of items of together ``INDEX_WORDS`` words, made one at a time; scores are those of one index of all items."""
    held = narrow(items, id=item_col, text=text_col).persist()
    try:
        corpus = Corpus.of(read_items(held, "id", "text"))
        group, size = [], 0
        for item in read_items(held, "id", "text"):
            if group and size + len(item.tokens) > INDEX_WORDS:
                yield Index(group, share, corpus)
                group, size = [], 0
            group.append(item)
            size += len(item.tokens)
        if group:
            yield Index(group, share, corpus)
    finally:
        held.unpersist()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = OVERLAP,
) -> DataFrame:
    """One row per document and item found in it:
    ``(<id_col>, <item_col>, passage, score, question_overlap, answer_overlap)``.

    ``passage`` is the word at which the first passage begins that holds the item, ``score`` its BM25 score over the
    item's threshold, the overlaps the shares of the parts' shingles. Null and empty texts hold nothing; an
    item without words is found nowhere, one of fewer words than a shingle as a whole; repeated documents
    are searched each on its own. The items pass through the driver; an index of ``INDEX_WORDS`` words of them at a
    time goes to the tasks, each with its own pass over the documents. How items fall into indexes has no bearing on the result.
    """
    spark = docs.sparkSession
    source = narrow(docs, id=id_col, text=text_col)
    kinds = [source.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"id {kinds[0]}, item {kinds[1]}, passage long, score double, question_overlap double, answer_overlap double"
    names = ["id", "item", "passage", "score", "question_overlap", "answer_overlap"]
    out = spark.createDataFrame([], schema)
    for index in _indexes(items, item_col, item_text_col, share):
        shared = spark.sparkContext.broadcast(index)  # <= INDEX_WORDS words

        def run(batches, shared=shared):
            search = _search(shared.value, share)
            with tidy():
                for batch in batches:
                    for piece in pieces(batch):
                        found = search(piece.column("text").to_pylist())
                        if found:
                            ids = piece.column("id")
                            columns = [ids.take(pa.array([f[0] for f in found])), [shared.value.items[f[1]].id for f in found], *zip(*[f[2:] for f in found])]
                            yield pa.RecordBatch.from_arrays([columns[0], *[pa.array(c) for c in columns[1:]]], names=names)

        out = out.unionAll(source.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col}) if item_col != id_col else out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; nothing is shuffled."""
    for index in _indexes(items, item_col, item_text_col, share):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # <= INDEX_WORDS words

        def run(batches, shared=shared):
            search = _search(shared.value, share)
            with tidy():
                for batch in batches:
                    for piece in pieces(batch, text_col):
                        mask = np.ones(piece.num_rows, dtype=bool)
                        mask[[f[0] for f in search(piece.column(text_col).to_pylist())]] = False
                        yield piece.filter(pa.array(mask))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
