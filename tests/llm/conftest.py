import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("row_key", T.IntegerType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)

    return make
