"""How little of the lines is dealt out, and that what is left out could not meet."""

import random

import numpy as np
from pyspark.sql import functions as F

from reelspark.llm import lines
from test_line_bounds import brute, changed


def entries(keys, line, asked, buckets):
    key = ((keys >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(48 - lines.KEY_BITS)
    return (((key << np.uint64(lines.LINE_BITS)) | line.astype(np.uint64)) << np.uint64(1)) | (~asked).astype(np.uint64)


def test_each_run_of_a_line_is_dealt_once_in_nine_bytes():
    rng = np.random.default_rng(1)
    n, buckets = 200_000, 12
    keys, line, asked = rng.integers(0, 1 << 63, n, np.int64).view(np.uint64) * np.uint64(2), rng.integers(0, 4000, n), rng.random(n) < 0.2
    names = rng.integers(-(1 << 63), 1 << 63, 4000, np.int64) >> lines.ID_SHIFT
    twice = [np.concatenate([x, x]) for x in (keys, line, np.zeros(n, bool))]
    packed = list(lines._deal([entries(keys, line, asked, buckets), entries(*twice, buckets)], names))
    assert sum(len(b) for row in packed for b in row[1:]) < 9 * n
    got = set()
    for bucket, *row in packed:
        got |= {(bucket, k, i, a) for k, i, a in zip(*(x.tolist() for x in lines._dealt(*row)))}
    key = entries(keys, line, asked, buckets) >> np.uint64(lines.LINE_BITS + 1)
    want = zip((key >> np.uint64(lines.KEY_BITS)).tolist(), (key & np.uint64((1 << lines.KEY_BITS) - 1)).tolist(), names[line].tolist(), asked.tolist())
    assert got == set(want)


def test_a_run_repeated_in_a_line_is_one_row(make):
    texts = ["spam " * 300, "spam " * 299 + "ham", "a b c d e f g h i j k l"]
    shared = lines._shared_runs(make(texts), 8, 5, 612, 3).collect()
    assert len(shared) == len({(r.key, r.id) for r in shared}) <= 6


def test_sketches_allow_what_lies_within_the_bound(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        x = [f"w{rng.choice((0, rng.randrange(90)))}" for _ in range(rng.randrange(10, 200))]
        k = rng.randrange(len(x) // 5 + 1)
        y = changed(rng, x, k)
        pairs.append((x, y, k) if len(x) >= len(y) else (y, x, k))
    word = {w: int(h) for w, h in zip(sorted({w for x, y, _ in pairs for w in x + y}), np.random.default_rng(2).integers(0, 1 << 63, 10_000))}

    def sketches(at):
        rows = [p[at] for p in pairs]
        return np.stack(lines._sketches(np.array([word[w] for r in rows for w in r], np.uint64), np.array([len(r) for r in rows])), 1).tolist()

    rows = [(*x, *y, k) for x, y, (_, _, k) in zip(sketches(0), sketches(1), pairs)]
    names = [*lines.SKETCH, *(f"o{c}" for c in lines.SKETCH), "k"]
    over = lines.beyond([F.col(c) for c in lines.COUNTERS], [F.col(f"o{c}") for c in lines.COUNTERS])
    turned = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in lines.TURNED), F.lit(0))
    got = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names)).select(over.alias("over"), turned.alias("turned"), "k", "c0", "c1", "oc0", "oc1").collect()
    assert all(r.over <= r.k and r.turned <= 2 * r.k for r in got)
    for r in got:
        mine, other = ([c >> 4 * i & 15 for c in (a, b) for i in range(16)] for a, b in ((r.c0, r.c1), (r.oc0, r.oc1)))
        assert r.over == sum(max(0, a - b) for a, b in zip(mine, other))


def test_distance_stops_beyond_the_bound():
    rng = random.Random(8)
    for _ in range(2000):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        for most in range(5):
            assert (lines.distance(x, y, most) <= most) == (lines.distance(x, y) <= most)


def test_shuffle_files_go_with_the_stored_table(spark, make):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen = []
    before, real = spark.conf.get(name), lines.common.stored
    lines.common.stored = lambda df, label: seen.append(spark.conf.get(name)) or real(df, label)
    try:
        lines.stored(make(["a b"]).groupBy("text").count(), "table").count()
    finally:
        lines.common.stored = real
    assert seen == ["true"] and spark.conf.get(name) == before


def test_long_spam_and_near_copies_against_brute_force(make):
    rng = random.Random(11)
    texts = ["spam " * n + "end" for n in (8, 9, 10, 40, 41, 48, 50)] + ["ham eggs " * n for n in (6, 12, 13, 15)]
    base = [f"v{rng.randrange(30)}" for _ in range(120)]
    texts += [" ".join(changed(rng, base, k)) for k in (0, 5, 20, 24, 25, 40)] + ["spam " * 20 + " ".join(base[:40])]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert {r.row.doc_id: r.row.text for r in lines.dedup(make(docs)).collect()} == brute(docs, min_words=2)


def test_a_group_of_near_copies_is_settled_by_its_earliest_line(make, monkeypatch):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(40)]
    texts = [" ".join(base)] + [" ".join([*base[:-8], *(f"x{rng.random()}" for _ in range(8))]) for _ in range(60)]
    kept, real = {}, lines.stored

    def stored(df, label):
        out = real(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(lines, "stored", stored)
    got = lines.dedup(make(list(enumerate(texts)))).collect()
    assert sum(r.n_removed for r in got) == 60
    assert kept["first_pairs"] == 60 and kept["pairs"] == 0
