import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def make_docs(spark):
    def make(rows, extra=None):
        """rows: texts, or (doc_id, text), or (doc_id, text, lang, source)."""
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else tuple(r)
            r = r + ("en", "src0")[len(r) - 2 :]
            full.append((*r, None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOCS)
        for k, v in (extra or {}).items():
            df = df.withColumn(k, v)
        return df

    return make
