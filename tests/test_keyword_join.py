"""The similarity join against every pair, on lists with long, short, empty and repeated keywords."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import keyword_join as K
from reelspark.operators import text
from tests.test_functions import lcs

KEYWORDS = ["KILL", "kill", "skills", "击杀", "li", "", "ekil" * 25, "lé", None, "aaaa", "assisted"]


@functools.lru_cache(None)
def ratio(a, b):
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(9)
    kws = KEYWORDS + ["".join(rng.choice("kilaés") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts = {"".join(rng.choice("kilaész击") for _ in range(rng.randint(0, 9))) for _ in range(200)}
    texts |= {"", "ekil" * 24, "ekil" * 25, "zz", "9", "kill " * 40, "a" * 3000}
    table = spark.createDataFrame(list(enumerate(kws)), "kw_idx int, keyword string")
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "norm string")
    return kws, texts, table, rows


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("travel", [K.TRAVEL_BYTES, 0])
def test_all_similar_pairs(sides, threshold, travel):
    kws, texts, table, rows = sides
    prepared = K.prepare(table, travel)
    assert prepared.travels == (travel > 0)
    got = [(r.norm, r.kw_idx, r.similarity) for r in K.similar(rows, prepared, threshold).collect()]
    want = {(t, i): ratio(t, k.lower()) for t in texts for i, k in enumerate(kws) if k is not None}
    want = {p: s for p, s in want.items() if s >= threshold and s > 0}
    assert len(got) == len(want) and {(t, i): s for t, i, s in got} == pytest.approx(want)


def test_best_without_threshold_settles_every_text(sides):
    kws, texts, table, rows = sides
    got = {r.norm: (r.keyword, r.similarity) for r in K.best(rows, K.prepare(table), None).collect()}
    for t in texts:
        top = max((ratio(t, k.lower()), -i) for i, k in enumerate(kws) if k is not None)
        assert got.get(t) == ((kws[-top[1]], pytest.approx(top[0])) if top[0] > 0 else None)


def test_table_and_list_agree(spark):
    rows = [(1, 0, 0, " KIILL ", 0.7), (1, 0, 1, "kill", 0.4), (1, 1, 0, "HEALTH", 0.99), (1, 2, 0, "", 0.5), (1, 3, 0, None, 0.5)]
    dets = spark.createDataFrame(rows, "video_id int, ts_ms bigint, det_idx int, text string, confidence double")
    centers = spark.createDataFrame([(1, 500), (1, 9000)], "video_id int, center_ms bigint")
    table = spark.createDataFrame([(0, "KILL"), (1, "kill"), (2, "heal")], "kw_idx int, keyword string")
    listed, joined = text.keywords_from(table), K.prepare(table)
    order = ["ts_ms"]
    assert text.match_keywords(dets, joined, 0.8).orderBy(*order).collect() == text.match_keywords(dets, listed, 0.8).orderBy(*order).collect()
    a, b = (sorted(text.scan_keywords(dets, centers, k, 500, 500, 0.8).collect()) for k in (listed, joined))
    assert a == b


def test_empty_sides(spark):
    none = spark.createDataFrame([], "kw_idx int, keyword string")
    some = spark.createDataFrame([("kill",)], "norm string")
    assert K.similar(some, K.prepare(none), 0.5).count() == 0 and K.best(some, K.prepare(none), None).count() == 0
    assert K.similar(some.limit(0), K.prepare(spark.createDataFrame([(0, "kill")], none.schema)), 0.5).count() == 0


def test_frequent_words_share_no_join_key_of_the_whole_list(spark):
    """Keys are (mark, length): of words with a rare and many common characters only the rare ones meet."""
    table = spark.createDataFrame([(i, "aeiou" + c) for i, c in enumerate("bcdfghjklmnpqrstvwxyz")], "kw_idx int, keyword string")
    kws = K.prepare(table)
    one = K.similar(spark.createDataFrame([("aeioux",)], "norm string"), kws, 0.9)
    assert [(r.keyword, r.similarity) for r in one.collect()] == [("aeioux", 1.0)]
    assert kws.rows.filter(F.size("marks") != 6).count() == 0
