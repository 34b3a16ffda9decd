import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("blob", T.StringType()),
        T.StructField("_text", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); the last three columns clash with names used inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOC)

    return make
