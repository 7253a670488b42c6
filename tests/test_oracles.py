"""Every registered query that SQL can express agrees with its SQL; the others return rows."""

import pytest
from check_oracle import differences, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import anomaly, meanshift, models, search, sessions

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FITTED = {
    "classifier_families", "train_score_regression", "grid_search_losses", "permutation_importance", "drift_classifier", "isolation_scores", "anomaly_by_record",
    "one_class_machine", "kernel_rings", "search_halving", "log_anomaly", "train_score_clustering", "mean_shift",
}
FITTED_DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, data, con, key):
    if key in FITTED:  # properties of a fit that a few rows do not show
        data, con = FITTED_DATA, duck(FITTED_DATA)
    got = QUERIES[key](spark, data).toPandas()
    want = con.sql(ORACLES[key]).df()
    assert differences(got, want) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, data, key):
    assert QUERIES[key](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


class Constant:
    """A model that says the same of every row."""

    def __init__(self, said):
        self.said = said

    def transform(self, df):
        return df.withColumn("predictions", F.lit(self.said))

    scores = lambda self, df, out="anomaly_score": df.withColumn(out, F.lit(0.5))


@pytest.mark.parametrize(("key", "said"), [("classifier_families", "1"), ("train_score_clustering", 0), ("grid_search_losses", "1"), ("kernel_rings", "0")])
def test_a_constant_model_turns_rows_red(spark, monkeypatch, key, said):
    for where in (models, search):
        monkeypatch.setattr(where, "train", lambda *_, **__: Constant(said))
    assert differences(QUERIES[key](spark, FITTED_DATA).toPandas(), duck(FITTED_DATA).sql(ORACLES[key]).df()) is not None


@pytest.mark.parametrize("key", ["isolation_scores", "log_anomaly"])
def test_random_flags_turn_rows_red(spark, monkeypatch, key):
    class Random(Constant):
        def transform(self, df):
            return df.withColumn("predictions", F.when(F.rand(1) < 0.02, -1).otherwise(1))

    monkeypatch.setattr(anomaly, "train_isolation_forest", lambda *_, **__: Random(1))
    assert differences(QUERIES[key](spark, FITTED_DATA).toPandas(), duck(FITTED_DATA).sql(ORACLES[key]).df()) is not None


def test_one_cluster_for_all_turns_rows_red(spark, monkeypatch):
    monkeypatch.setattr(meanshift, "train_mean_shift", lambda *_, **__: Constant(0))
    assert differences(QUERIES["mean_shift"](spark, FITTED_DATA).toPandas(), duck(FITTED_DATA).sql(ORACLES["mean_shift"]).df()) is not None


def test_log_lines_are_parsed_once(spark, tmp_path, monkeypatch):
    """Sessions are few and lines are many: the vectors that a forest reads again and again are made once."""
    events = [(i, i % 120, "error" if i % 7 == 0 else "click", float(i % 90)) for i in range(1_200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen, real = spark.sparkContext.accumulator(0), sessions.session_features

    def counted(*args, **options):
        df = real(*args, **options)

        def note(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(note, df.schema)

    monkeypatch.setattr(sessions, "session_features", counted)
    flags = QUERIES["log_anomaly"](spark, str(tmp_path)).collect()
    assert {r["id"] for r in flags if r["predictions"]} == {"u7", "u57", "u107"} and len(flags) == 120
    assert seen.value == 120
