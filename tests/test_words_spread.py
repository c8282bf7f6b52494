from pyspark.sql import functions as F

from reelspark.operators import keyword_join as K
from reelspark.operators import text


def test_distinct_words_meet_the_keywords_in_many_tasks(spark):
    words = spark.range(3000).select(F.concat(F.lit("w"), F.col("id") % 700).alias("norm")).distinct()
    kws = K.prepare(spark.createDataFrame([(0, "w12"), (1, "w345")], "kw_idx int, keyword string"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert K.similar(words, kws, 0.6).rdd.getNumPartitions() >= partitions
    assert text._distinct_texts(words).rdd.getNumPartitions() >= partitions


def test_bound_before_the_ratio_loses_no_pair(spark):
    texts = ["abcdef", "badcfe", "abc", "xaxbxc", "fedcba", "aabbcc", "abcxyz", "a", "ab"]
    keys = ["abcdef", "abc", "aabbcc", "ba", "cabbage"]

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for ch in a:
            last = row[:]
            for j, c in enumerate(b):
                row[j + 1] = last[j] + 1 if c == ch else max(last[j + 1], row[j])
        return 2 * row[-1] / (len(a) + len(b))

    kws = K.prepare(spark.createDataFrame(list(enumerate(keys)), "kw_idx int, keyword string"))
    found = K.similar(spark.createDataFrame([(t,) for t in texts], "norm string"), kws, 0.5)
    want = {(t, k) for t in texts for k in keys if ratio(t, k) >= 0.5}
    assert {(r.norm, r.keyword) for r in found.collect()} == want
