import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Columns whose names are used inside the operators.
CLASHES = ("key", "piece", "rid", "n", "score", "slot", "shard", "m", "start", "component_id", "kept", "host", "batch")


@pytest.fixture
def docs(spark):
    """docs([texts]) or docs([(doc_id, text)]): a documents table; clash=True adds columns with clashing names."""

    def make(rows, clash=False, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOCS).repartition(parts)
        if clash:
            for c in CLASHES:
                df = df.selectExpr("*", f"doc_id % 3 AS {c}")
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest scale."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
