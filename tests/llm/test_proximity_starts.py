"""Proximity does not depend on which term is rarest."""

import pytest
from pyspark.sql import functions as F

from reelspark.llm import decontam


@pytest.mark.parametrize("common", ["b c b c", "a c a c", "a b a b"])
def test_any_term_may_be_rarest(spark, make, common):
    docs = make(["a x b x c", common, "a x x x b c"])
    asked = decontam.phrases(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), 13).select("phrase", "terms")
    keys = {r.k: r.doc_id for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    assert {keys[r.k1] for r in decontam.proximity_matches(docs, asked, 1).collect()} == {0}
