"""Greedy word-piece lengths without pieces: a trie with failure links and popped-token counts.

One pass over a word follows trie edges. Where no edge fits, the failure link leads to the node of what is
left after the longest matches are cut off, and the tokens that this cuts off were counted beforehand. Each
character is read once and no piece is built, so the time is linear in the word.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, per_piece, raw

#: Distinct words whose length a task remembers; beyond that it starts anew.
REMEMBERED = 400_000


class Automaton:
    """Longest-match lengths over a vocabulary.

    ``words`` of a text are matched as ``prefix + word``. A character in no piece counts as one token per
    UTF-8 byte, and so does one that only occurs inside longer pieces where no piece fits.
    """

    def __init__(self, vocabulary: Iterable[str], prefix: str = ""):
        self.prefix = prefix
        known = {p for p in vocabulary if p}
        weight = {c: len(c.encode()) for p in known for c in p} | dict.fromkeys(known, 1)
        self.edges: list[dict[str, int]] = [{}]
        tokens, parent, label = [0], [0], [""]
        for piece, tokens_of in weight.items():
            node = 0
            for c in piece:
                step = self.edges[node].get(c)
                if step is None:
                    step = len(self.edges)
                    self.edges[node][c] = step
                    self.edges.append({})
                    tokens.append(0)
                    parent.append(node)
                    label.append(c)
                node = step
            tokens[node] = tokens_of
        # fail[v]: the node left once the longest matches of v's string are cut off; popped[v]: their tokens
        count = len(self.edges)
        self.fail, self.popped = [-1] * count, [0] * count
        queue = deque(self.edges[0].values())
        while queue:
            v = queue.popleft()
            queue.extend(self.edges[v].values())
            if tokens[v]:
                self.fail[v], self.popped[v] = 0, tokens[v]
                continue
            u = parent[v]
            node, popped = self.fail[u], self.popped[u]
            while node >= 0 and label[v] not in self.edges[node]:
                popped += self.popped[node]
                node = self.fail[node]
            self.fail[v], self.popped[v] = self.edges[node][label[v]], popped  # every single character is an edge of the root

    def length(self, word: str) -> int:
        """Number of tokens of ``prefix + word``."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for c in self.prefix + word:
            step = edges[node].get(c)
            while step is None:
                if node == 0:
                    total += len(c.encode())  # in no piece at all
                    step = 0
                    break
                total += popped[node]
                node = fail[node]
                step = edges[node].get(c)
            node = step
        while node:
            total += popped[node]
            node = fail[node]
        return total


def sentencepiece_vocabulary(path: str) -> list[str]:
    """Pieces of a SentencePiece model without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def token_counts(
    docs: DataFrame, vocabulary: Iterable[str], prefix: str = "▁", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``(<id_col>, n_words, n_tokens, longest_word)``, words ``[^\\x20\\x09-\\x0D]+``.

    ``longest_word`` is the largest number of tokens of one word. A null or empty text has no words: all
    zero. Rows of the same id are counted each on its own; an empty table gives no rows. The vocabulary
    is a list of fixed size and goes to every task.
    """
    source = narrow(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(sorted(set(vocabulary)))  # a tokenizer's fixed vocabulary

    def run(batches):
        automaton, seen = Automaton(shared.value, prefix), {}

        def lengths(text: bytes) -> list[int]:
            out = []
            for word in text.split():
                n = seen.get(word)
                if n is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    n = seen[word] = automaton.length(word.decode())
                out.append(n)
            return out

        def build(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = [lengths(t) for t in raw(piece)]
            columns = [[len(x) for x in found], [sum(x) for x in found], [max(x, default=0) for x in found]]
            return pa.RecordBatch.from_arrays(
                [piece.column("id"), *[pa.array(np.array(c, dtype=np.int64)) for c in columns]],
                names=["id", "n_words", "n_tokens", "longest_word"],
            )

        yield from per_piece(build)(batches)

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, longest_word long")
    return out.select(F.col("id").alias(id_col), "n_words", "n_tokens", "longest_word")
