"""Vocabularies of tokenised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.functions.text import tokens
from millrace.skew import SMALL_ROWS, numbered

#: Ids kept for unknown words and for padding.
UNKNOWN_ID, PADDING_ID = 0, 1


def token_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(tokens(col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def text_vocab(train: DataFrame, text: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(token, n, id) of the training texts: ids from 2 on, by count downward and then by token."""
    ranked = numbered(token_counts(train, text), [F.col("n").desc(), F.col("token")], "id", small_rows)
    return ranked.withColumn("id", F.col("id") + PADDING_ID + 1)


def label_vocab(train: DataFrame, label: str) -> DataFrame:
    """(label, n, id) by count downward; labels have no reserved ids."""
    counts = train.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, [F.col("n").desc(), F.col("label")], "id")


def vocab_sizes(words: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: words including the two reserved ids, and labels."""
    return words.agg((F.count(F.lit(1)) + PADDING_ID + 1).alias("vocab_size")).withColumn(
        "label_size", labels.agg(F.count(F.lit(1))).scalar()
    )
