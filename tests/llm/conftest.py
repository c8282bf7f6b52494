import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)


@pytest.fixture(scope="session")
def make(spark):
    """make(texts) -> documents with ids 0, 1, ...; pairs are (doc_id, text)."""

    def build(texts, lang="en"):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return build
