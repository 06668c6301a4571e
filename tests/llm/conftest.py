import pytest
from brute import ODD
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Unusual texts, clashing further columns, more rows from the smallest test table."""
    rows = [(100_000 + i, t) for i, t in enumerate(ODD)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return real.unionByName(odd).withColumns({c: F.lit("x") for c in ("kept", "component_id", "blob", "digest", "part", "host", "n", "source", "score")})


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
