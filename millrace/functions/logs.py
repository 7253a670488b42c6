"""Structured rows out of raw log lines by an ordered list of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.functions.dates import expand_date, parse_time

#: (pattern id, regular expression, comma list of column names where ``*`` skips a group)
Rule = tuple[int, str, str]


def read_rules(table: DataFrame, limit: int = 1_000) -> list[Rule]:
    """The rule table (pattern_id, regex, variables), which must be short, in pattern order."""
    rows = table.orderBy(table.columns[0]).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return [(int(r[0]), r[1], r[2]) for r in rows]


def rule_columns(rules: Sequence[Rule]) -> list[str]:
    """Column names of all rules in first-seen order."""
    names = [v.strip() for _, _, variables in rules for v in variables.split(",")]
    return list(dict.fromkeys(n for n in names if n and n != "*"))


def _typed(name: str, text: Column) -> Column:
    if name == "date":
        return expand_date(text)
    if name == "time":
        return parse_time(text)
    return text


def parse_log(lines: DataFrame, rules: Sequence[Rule], text: str = "value") -> DataFrame:
    """Add the rules' columns and ``pattern_id``; a line takes the first rule that fits from its start.

    Case does not matter. A line no rule fits keeps its row with NULLs. Columns called ``date`` and
    ``time`` are read as such; the rest is trimmed text.
    """
    anchored = [f"(?i)^(?:{regex})" for _, regex, _ in rules]
    which = F.coalesce(*[F.when(col(text).rlike(p), F.lit(i)) for i, p in enumerate(anchored)])
    placed = lines.withColumn("__rule", which)
    values = {}
    for name in rule_columns(rules):
        picks = [
            F.when(F.col("__rule") == i, F.trim(F.regexp_extract(col(text), anchored[i], group)))
            for i, (_, _, variables) in enumerate(rules)
            for group, v in enumerate(variables.split(","), start=1)
            if v.strip() == name
        ]
        values[name] = _typed(name, F.coalesce(*picks))
    ids = [F.when(F.col("__rule") == i, F.lit(pattern)) for i, (pattern, _, _) in enumerate(rules)]
    values["pattern_id"] = F.coalesce(*ids).cast("long")
    return placed.withColumns(values).drop("__rule")
