import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text), with columns whose names clash with those that operators add."""

    def make(rows):
        from pyspark.sql import functions as F

        extra = {c: F.lit("clash") for c in ("score", "shard", "fp", "id", "label", "rows", "slot", "__id")}
        return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).withColumns(extra)

    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
