"""Registered queries against SQL; the pipeline against its stages worked out by brute force."""

import hashlib

import pytest
from check_oracle import differences, duck
from test_decontam import brute as leaked
from test_quality import brute as counts
from test_sentencepieces import viterbi
from test_simhash import brute_fingerprint, brute_groups

import corpus_pipeline
from millrace.llm import pii, quality, queries, sentencepieces, simhash


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_sql(spark, data, key):
    got = queries.QUERIES[key](spark, data).toPandas()
    assert differences(got, duck(data).sql(queries.ORACLES[key]).df()) is None


@pytest.mark.parametrize("key", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_covers_its_table(spark, data, key):
    out = queries.QUERIES[key](spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert "doc_id" in out.columns
    found = {r[0] for r in out.select("doc_id").collect()}
    every = {r[0] for r in docs.select("doc_id").collect()}
    assert found <= every and (found == every or key == "op7_decontaminate")


def test_personal_data_digests(spark, data):
    """What the query derives from the operator's spans: digests and counts of the patterns as stated, and of all spans."""
    from test_pii import brute_base

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, data).collect():
        base = brute_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) >= len(base)


def test_pipeline_by_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.fit(table, labels)
    hasher = quality.Hasher()
    docs = [(i, t) for i, t in docs if not counts(t)[5] and model.score(hasher(t.encode())) >= model.threshold]
    kept = spark.createDataFrame(docs, "doc_id long, text string")
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    docs = [(i, t) for (i, t), c in zip(docs, brute_groups(prints)) if i == c]
    assert sorted(i for i, _ in docs) == sorted(r.doc_id for r in simhash.keep_one(kept).collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {d for d, _ in leaked(docs, items)}
    docs = [(i, t) for i, t in docs if i not in dirty]
    field = pii.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    docs = [(i, pii.redacted(t, pii.find(t, field)[1])) for i, t in docs]
    known = sentencepieces.load(queries.PIECES)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, t in docs:
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[i].n_pieces == len(got[i].ids)
    for i, t in sorted(docs, key=lambda d: len(d[1]))[:40]:
        assert list(got[i].ids) == viterbi(t, known)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "sentence_pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).schema.names == docs.columns
        assert stage(spark, docs.limit(0), data).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), data).count() == 0
