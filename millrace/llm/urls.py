"""URL rules: a trie over reversed host labels, then path segments; the longest fitting rule decides.

A rule ``(host, path)`` fits its host and every subdomain, for urls whose path starts with the rule's. Full
segments of the rule's path are edges of the trie; what follows its last ``/`` fits the start of a segment.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow

#: Most characters of rules that are sent to every executor; a longer list is cut into tries of this size.
TRIE_CHARS = 16_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class _Node:
    __slots__ = ("labels", "segments", "starts", "sizes")

    def __init__(self):
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.starts: dict[str, Rule] = {}
        self.sizes: list[int] = []  # of the keys in ``starts``, ascending


class Trie:
    """Rules by host and path. Of equal rules with both verdicts, block stands."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *full, rest = rule.path.split("/")
            for segment in full:
                node = node.segments.setdefault(segment, _Node())
            held = node.starts.get(rest)
            if held is None or rule.verdict == "block":
                node.starts[rest] = rule
                node.sizes = sorted({*node.sizes, len(rest)})

    def _best_path(self, node: _Node, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            for k in node.sizes:
                if k > len(segment):
                    break
                best = node.starts.get(segment[:k], best)
            node = node.segments.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits: the longest host first, then the longest path."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._best_path(node, segments) or best
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
    there up to ``?``, ``#`` or the end. A null url or one without ``://``: both empty."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def _tries(rules: Iterable[Rule]) -> list[list[Rule]]:
    groups, size = [[]], 0
    for rule in sorted(set(rules)):
        if groups[-1] and size + len(rule.name) > TRIE_CHARS:
            groups.append([])
            size = 0
        groups[-1].append(rule)
        size += len(rule.name)
    return groups


def judge(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``(<id_col>, host, path, rule, verdict)``.

    ``rule`` is the longest fitting one (host, then path) or null; ``verdict`` is its verdict or the default.
    Rows of the same id are judged each on its own; a null id stays null; an empty table gives no rows.
    The rules are given on the driver. A trie holds at most ``TRIE_CHARS`` characters of them; a longer
    list goes through several tries one after another, and the longest rule of all stands.
    """
    host, path = host_and_path(F.col("url"))
    out = narrow(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    out = out.select("*", *[F.lit(None).cast("string").alias(c) for c in ("rule_host", "rule_path", "verdict")])
    kind = out.schema["id"].dataType.simpleString()
    for group in _tries(rules):
        shared = out.sparkSession.sparkContext.broadcast(group)  # <= TRIE_CHARS

        def match(batches, shared=shared):
            trie = Trie(shared.value)
            for batch in batches:
                columns = {n: batch.column(n).to_pylist() for n in batch.schema.names[1:]}
                found = []
                for h, p, old_host, old_path, old in zip(*columns.values()):
                    rule = trie.find(h, p)
                    if rule and (old is None or (len(rule.host), len(rule.path)) > (len(old_host), len(old_path))):
                        found.append((rule.host, rule.path, rule.verdict))
                    else:
                        found.append((old_host, old_path, old))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("host"), batch.column("path")]
                    + [pa.array([f[k] for f in found], pa.string()) for k in range(3)],
                    names=batch.schema.names,
                )

        out = out.mapInArrow(match, f"id {kind}, host string, path string, rule_host string, rule_path string, verdict string")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
