import pytest


@pytest.fixture
def documents(spark):
    """``documents(rows)``: a table like the sample's, with columns that clash with the operators' own."""

    def build(rows, partitions=3):
        schema = "doc_id long, text string, id string, fp long, kept string, source string"
        full = [(i, t, "x", 7, "y", None) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build
