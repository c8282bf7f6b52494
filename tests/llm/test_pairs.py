"""Operators on pairs and sets of documents: contamination, codes, packing, lines, near-duplicates, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reelspark.llm import decontam, hamming, lines, packing, simhash
from reelspark.llm.components import components
from reelspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def judged(docs, items):
    """{doc_id: (n_words, n_hit, items, contaminated)} by looking at every place."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - 12) if w and item is not None else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[k]
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


# decontamination


def test_op2_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = judged(docs, items)
    for r in QUERIES["op2_decontamination"](spark, SF).collect():
        n, hit, found, bad = want[r.doc_id]
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, bad)


def test_decontamination_edges(spark, make):
    thirteen = " ".join(f"w{i}" for i in range(13))
    texts = ["the the the", "The, THE; the a b", None, "", "!!!", f"x {thirteen} y", thirteen.replace("w5", "q"), "a b", "a b", "b a " * 20_000, "É b é"]
    items_ = [(1, "the the"), (10, "THE the"), (2, thirteen + " w13"), (3, None), (4, "..."), (None, "b"), (5, "a b"), (5, "a b"), (6, "é")]
    docs = make(texts).withColumn("pos", F.lit(1)).withColumn("term", F.lit("t"))
    items = spark.createDataFrame(items_, "item_id long, text string")
    want = judged(list(enumerate(texts)), items_)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items), r.contaminated) for r in decontam.judge(docs, items).collect()}
    assert got == want
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[3]}
    assert decontam.judge(docs.limit(0), items).count() == 0 and decontam.keep_clean(docs, items.limit(0)).count() == len(texts)


def test_proximity(spark, make):
    docs = make(["alpha beta gamma", "alpha x beta gamma", "alpha x x x x beta gamma", "gamma"])
    asked = decontam.phrases(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), 13).select("phrase", "terms")
    keys = {r.k: r.doc_id for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    found = lambda slop: {keys[r.k1] for r in decontam.proximity_matches(docs, asked, slop).collect()}
    assert found(0) == {0} and found(1) == {0, 1} and found(4) == {0, 1, 2}


# nearest codes


def test_op3_matches_sql(spark):
    assert compare(QUERIES["op3_nearest_codes"](spark, SF), connect(SF), ORACLE["op3_nearest_codes"]) == ""


@pytest.mark.parametrize("n,spread", [(300, 64), (3000, 6)])
def test_nearest_codes_against_brute_force(spark, n, spread):
    rng = random.Random(n)
    base = rng.getrandbits(64)
    codes = [base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(spread))) & (2**64 - 1) for _ in range(n)]
    codes = [c - 2**64 if c >= 2**63 else c for c in codes]
    codes[: n // 3] = [codes[0]] * (n // 3)
    rows = spark.createDataFrame([*enumerate(codes), (None, 5), (7, None), (0, codes[0])], "id long, code long")
    got = {}
    for r in hamming.nearest(rows, rows.filter("id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    for q in range(0, n, 50):
        best = sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in enumerate(codes))[:10]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(best)]


def test_nearest_codes_edges(spark):
    table = spark.createDataFrame([(0, [1.0] * 64), (20, [1.0] * 64), (1, None), (2, [1.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.id) for r in hamming.search(table, 10, 20).collect()) == [(0, 1, 0), (0, 2, 20), (20, 1, 0), (20, 2, 20)]
    assert hamming.search(table.limit(0), 10, 20).count() == 0


# packing


def check_packed(rows, ids, limits):
    """Every id in exactly one piece, offsets gapless, limits held, no padding but by power of two."""
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(own) and r.length > 0
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == Counter({k: len(v) for k, v in ids.items()})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        total = sum(r.length for r in parts)
        assert total <= limits.tokens and len(parts) <= limits.segments and (total & (total - 1)) == 0


def test_op7_against_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs}
    check_packed(QUERIES["op7_packing"](spark, SF).collect(), ids, packing.Limits())


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64), packing.Limits(64, 16, 32), packing.Limits(32, 1, 32)])
def test_packing_edges(spark, make, limits):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "a b c", "x " * 500, *["tiny"] * 40, *(" ".join(["word"] * k) for k in range(1, 90, 7))]
    docs = make(texts).withColumn("start", F.lit("s"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack(docs, path, 2, limits).collect()
    if limits.loss >= limits.tokens:
        check_packed(rows, ids, limits)
    loss = Counter()
    for r in rows:
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= limits.loss
    assert packing.pack(docs.limit(0), path, 2, limits).count() == 0


def test_prompts_bear_no_loss(spark, make):
    docs = make(["an answer", None]).withColumn("head", F.lit("a long question"))
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, prompt="head", with_ids=True).collect()
    assert sum(r.loss_tokens for r in rows) == 4 and sum(r.doc_tokens for r in rows if r.start == 0) == 10
    assert all(len(r.ids) == 4 * r.length for r in rows)


# lines


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return len(y) - len(x) <= 1 and (x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :])


def cleaned(docs):
    order = list(dict.fromkeys(w for _, text in docs for w in (tuple(s.split()) for s in (text or "").split("\n")) if len(w) >= 2))
    near = {w for i, w in enumerate(order) if len(w) >= 5 and any(len(v) >= 5 and one_edit(v, w) for v in order[:i])}
    seen, out = set(), {}
    for doc, text in docs:
        kept = []
        for s in (text or "").split("\n"):
            w = tuple(s.split())
            if len(w) >= 2 and (w in near or w in seen):
                continue
            seen.add(w)
            kept.append(s)
        out[doc] = None if text is None else "\n".join(kept)
    return out


def test_lines_against_brute_force(spark, make):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "dd"]
    docs = [(i, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    got = {r.row.doc_id: r.row.text for r in lines.dedup(make(docs)).collect()}
    assert got == cleaned(docs)


def test_line_edges(spark, make):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(0, "one two three four five\nshort\n\nshort"), (1, "one two three four six\nkept line"), (2, "one two three four five"), (3, None), (4, ""), (5, long), (6, long + " more"), (7, "one  two\tthree four five \n\nx")]
    frame = make([*docs, (None, "null id line")]).withColumn("gone", F.lit(1)).withColumn("k", F.lit("k"))
    got = {r.row.doc_id: (r.row.text, r.row.n_chars, r.emptied) for r in lines.dedup(frame).collect()}
    assert {k: v[0] for k, v in got.items() if k is not None} == cleaned(docs)
    assert got[1][:2] == ("kept line", 9) and got[2][2] and got[6][2] and not got[4][2] and got[7][0] == "\nx"
    kept = lines.keep_lines(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {0, 1, 3, 4, 5, 7, None}
    assert lines.dedup(frame.limit(0)).count() == 0


def test_repeated_rows_change_alike(make):
    got = lines.dedup(make([(1, "a b c"), (1, "a b c"), (2, "a b c")])).collect()
    assert sorted((r.row.doc_id, r.row.text) for r in got) == [(1, "a b c"), (1, "a b c"), (2, "")]


def test_neighbourhood_meets_exactly_within_one_edit():
    rng = random.Random(4)
    for _ in range(2000):
        x, y = ([rng.choice("ab") for _ in range(rng.randint(1, 6))] for _ in range(2))
        a, b = lines.neighbourhood(x), lines.neighbourhood(y)
        met = a[-1] == b[-1] or a[-1] in b[:-1] or b[-1] in a[:-1] or any(p == q for p, q in zip(a[:-1], b[:-1]))
        assert met == (edits(x, y) <= 1)


# near-duplicates


def test_fingerprint_by_definition():
    import xxhash

    rng = random.Random(2)
    for n in (0, 1, 2, 3, 50, 400):
        text = " ".join(rng.choice(["A", "bé", "c\x1f", "d e"]) for _ in range(n))
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) & (2**64 - 1) == want


def brute_components(fps):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("block", [2048, 5])
def test_links_lose_no_component(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps = {0, -1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x - 2**64 if x >= 2**63 else x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    assert {f: found.get(f, f) for f in fps} == brute_components(fps)


def test_op10_against_brute_force(spark):
    rows = QUERIES["op10_simhash"](spark, SF).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) - (2**64 if int(r.fingerprint, 16) >= 2**63 else 0) for r in rows}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(fps[i] == simhash.fingerprint(t) for i, t in texts.items())
    roots, least = brute_components(set(fps.values())), {}
    for doc in sorted(fps, reverse=True):
        least[roots[fps[doc]]] = doc
    assert all(r.component_id == least[roots[fps[r.doc_id]]] for r in rows)


def test_near_duplicate_edges(spark, make):
    docs = make([(5, None), (3, ""), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "alone in its group"), (1, "z " * 100_000)]).withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 9), (9, 9), (None, 9), (None, None), (1, 1)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, ""), (9, "a b c d"), (None, "alone in its group"), (1, "z " * 100_000)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 501
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    judge = {
        "language": lambda rows: {i for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)},
        "line_dedup": lambda rows: {i for i, t in cleaned(sorted(rows.items())).items() if t is None or t.strip() or t == rows[i]},
        "decontamination": lambda rows: {i for i, x in judged(rows.items(), items).items() if not x[3]},
    }
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_duplicates":
            fps = {i: simhash.fingerprint(t) for i, t in before.items()}
            roots, least = brute_components(set(fps.values())), {}
            for doc in sorted(fps, reverse=True):
                least[roots[fps[doc]]] = doc
            assert set(after) == set(least.values())
        else:
            assert set(after) == judge[name](before)
        assert len(after) > 0.5 * len(before)
        before = after


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
