import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def frame(spark):
    """Make a documents table from texts, (id, text) pairs or whole rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            if not isinstance(r, tuple):
                r = (i, r)
            if len(r) == 2:
                r = (*r, "en", f"src{i % 3}", len(r[1]) if r[1] is not None else None)
            full.append(r)
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
