"""A training corpus from raw documents, in five stages.

1. Quality rules: documents that the rules or the n-gram ratio reject go.
2. SimHash: of each group of near-duplicates the document of the smallest id stays.
3. Decontamination: documents that hold a benchmark item go.
4. Personal data in the texts is replaced by its kind in brackets.
5. SentencePiece: the documents as piece ids, with a digest of the text that the ids decode to.

Stages 1 to 4 return the columns of their input. Each stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, pii, quality, sentencepieces, simhash
from millrace.llm.common import table, written

#: The tokenizer of the last stage.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.redact(docs, pii.fit(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read = sentencepieces.encode(docs, sentencepieces.load(PIECES), digest=True)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: No SQL: fitted models, near-duplicate components and lattices. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes to the shared folder, and the next reads from there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
