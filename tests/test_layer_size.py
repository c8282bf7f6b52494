from reelspark.operators import config as CF
from reelspark.operators import lineage


def kv(spark, rows):
    return spark.createDataFrame(rows, "game int, path string, value string")


def layers(spark, n=40):
    games = spark.createDataFrame([(i, i % 2) for i in range(n)], "game int, base int").coalesce(1)
    defaults = spark.createDataFrame([(b, f"{s}.k{i}", str(b)) for b in (0, 1) for s in ("detection", "video") for i in range(6)], "base int, path string, value string")
    own = kv(spark, [(i, "detection.k0", "7") for i in range(n)] + [(i, "video", "{}") for i in range(0, n, 4)])
    return games, defaults, own, kv(spark, [(i, "video", "null") for i in range(0, n, 8)])


def test_one_small_file_of_games_is_merged_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(CF, "ROWS", 10)
    games, defaults, own, over = layers(spark)
    rows = 40 * 12 + own.count() + over.count()
    out = CF.resolve(games, defaults, own, over)
    assert out.rdd.getNumPartitions() >= rows // 10
    got = {(r.game, r.path): r.value for r in out.collect()}
    want = {(i, f"{s}.k{k}"): str(i % 2) for i in range(40) for s in ("detection", "video") for k in range(6) if s != "video" or i % 8}
    want |= {(i, "detection.k0"): "7" for i in range(40)} | {(i, "video"): "null" for i in range(0, 40, 8)}
    assert got == want


def test_merge_and_fingerprints_shuffle_once(spark):
    games, defaults, own, over = layers(spark)
    prints = lineage.fingerprints(CF.resolve(games, defaults, own, over))
    plan = prints._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert {r.section for r in prints.collect()} == {"video", "detection", "config"}


def test_rows_without_game_or_twice(spark):
    games = spark.createDataFrame([(1, 0), (1, 0), (None, 0)], "game int, base int")
    defaults = spark.createDataFrame([(0, "a", "1"), (0, "a-b", "2"), (0, "c", "{}")], "base int, path string, value string")
    own = kv(spark, [(1, "a", "{}"), (1, "a.x", "3"), (1, "c", "{}"), (1, "c", "4"), (None, "a", "5"), (None, "a.y", "6")])
    got = sorted(((r.game or 0), r.path, r.value) for r in CF.resolve(games, defaults, own).collect())
    assert got == [(0, "a", "5"), (0, "a-b", "2"), (0, "a.y", "6"), (0, "c", "{}"), (1, "a-b", "2"), (1, "a.x", "3"), (1, "c", "{}")]
