"""Line deduplication with a bound that grows with the line's length."""

import random

import numpy as np
import pytest

from reelspark.llm import lines
from reelspark.llm.queries import QUERIES
from test_pairs import edits


def brute(docs, min_words=1, near_words=5, per_words=5):
    """Every line against every earlier one by the full edit distance."""
    order = list(dict.fromkeys(w for _, text in docs for w in (tuple(s.split()) for s in (text or "").split("\n")) if len(w) >= min_words))
    near = set()
    for i, w in enumerate(order):
        for v in order[:i]:
            n = max(len(v), len(w))
            if min(len(v), len(w)) >= near_words and abs(len(v) - len(w)) <= n // per_words and edits(v, w) <= n // per_words:
                near.add(w)
                break
    seen, out = set(), {}
    for doc, text in docs:
        kept = []
        for s in (text or "").split("\n"):
            w = tuple(s.split())
            if len(w) >= min_words and (w in near or w in seen):
                continue
            seen.add(w)
            kept.append(s)
        out[doc] = None if text is None else "\n".join(kept)
    return out


def changed(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, what = rng.randrange(len(words)), rng.choice(("put", "cut", "swap"))
        words[at : at + (what != "put")] = [] if what == "cut" else [f"n{rng.randrange(50)}"]
    return words


@pytest.mark.parametrize("share", [1 / 500, -1.0])
def test_bound_grows_with_length(spark, make, monkeypatch, share):
    monkeypatch.setattr(lines, "HOT_SHARE", share)
    rng = random.Random(7)
    texts, common = [], [f"c{i}" for i in range(6)]
    for _ in range(14):
        base = [f"v{rng.randrange(40)}" for _ in range(rng.choice((8, 9, 10, 11, 12, 15, 17, 20, 26, 40)))]
        base[2:2] = common * rng.randrange(2)
        texts += [" ".join(base)] + [" ".join(changed(rng, base, rng.randrange(len(base) // 4 + 2))) for _ in range(9)]
    rng.shuffle(texts)
    docs = [(i, "\n".join(texts[2 * i : 2 * i + 2])) for i in range(len(texts) // 2)]
    got = {r.row.doc_id: r.row.text for r in lines.dedup(make(docs)).collect()}
    assert got == brute(docs, min_words=2)


def test_distance_by_definition():
    rng = random.Random(8)
    for _ in range(2000):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert lines.distance(x, y) == edits(x, y)


def test_asked_runs_are_disjoint_and_avoid_hot_ones():
    rng = random.Random(9)
    texts = [[rng.choice("abcdefghij") for _ in range(n)] for n in range(5, 60)]
    none = np.array([], np.uint64)
    keys = runs_of = lines.runs(texts, 5, none)[0]
    for hot in (none, np.unique(keys[:40])):
        runs_of, line, at, asked = lines.runs(texts, 5, hot)
        for i, words in enumerate(texts):
            mine = sorted(at[(line == i) & asked].tolist())
            assert len(mine) == (len(words) // 5 + 1 if len(words) >= 10 else 0)
            width = lines._run_words(len(words), 5)
            assert all(b - a >= width for a, b in zip(mine, mine[1:] + [len(words)]))


def test_lines_of_one_word(spark, make, tmp_path):
    texts = ["Les.\nLes.\n字字字字字\nhttp://x.org/y", "字字字字字\nkept here", "http://x.org/y", "a b\n\n Les.", None, "", "x"]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(list(enumerate(texts)))
    got = {r.doc_id: r.text for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == want and want[1] == "kept here"
    assert {r.doc_id for r in lines.keep_lines(make(texts), lines.ANY_WORDS).collect()} == {0, 1, 3, 4, 5, 6}


def test_near_words_hold_for_more_edits(make):
    words = [f"w{i}" for i in range(15)]
    docs = [(0, " ".join(words)), (1, " ".join(["x", *words[1:-1], "y"]))]
    assert [sum(r.n_removed for r in lines.dedup(make(docs), near_words=n).collect()) for n in (5, 16)] == [1, 0]
