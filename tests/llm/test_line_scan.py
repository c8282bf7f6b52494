"""Lines taken apart in whole columns of bytes, and what of them is written and run."""

import random

import numpy as np
import pyarrow as pa
import pytest

from reelspark.llm import lines


def test_runs_are_dealt_once():
    rng = random.Random(5)
    texts = [[rng.choice("abcdefghij") for _ in range(n)] for n in range(5, 60)]
    keys, line, at, asked = lines.runs(texts, 5, np.array([], np.uint64))
    rows = list(zip(keys.tolist(), line.tolist(), at.tolist()))
    assert asked.any() and len(rows) == len(set(rows))


def test_lines_are_removed_in_one_pass(make):
    plan = lines.keep_lines(make(["a b c\nd e f", "a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_without(") == 1 or plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_words_of_lines(monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rng = random.Random(6)
    texts = ["", "\n", " a\r\n\ta  b", "\x1ca b c", "", "字 字\n字\x0b字", "a b"]
    texts += ["".join(rng.choices("ab \t\n字", k=rng.randrange(40))) for _ in range(200)]
    array = pa.array([None, "cut off", *texts])[2:]
    got, hash_of, line_of = [], {}, {}
    for text, number, identity, n, hashes in lines._chunks(array, 0):
        for i, (a, b) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
            words = tuple(texts[text[i]].split("\n")[number[i]].encode().split())
            assert len(words) == n[i] and all(hash_of.setdefault(w, h) == h for w, h in zip(words, hashes[a:b].tolist()))
            assert line_of.setdefault(words, identity[i].tobytes()) == identity[i].tobytes()
            got.append((int(text[i]), int(number[i])))
    assert got == [(i, j) for i, t in enumerate(texts) for j in range(t.count("\n") + 1)]
    assert len(set(hash_of.values())) == len(hash_of) and len(set(line_of.values())) == len(line_of)


def test_half_keys_meet_for_shared_halves():
    rng = random.Random(7)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(3, 9))] for _ in range(300)]
    (_, _, _, n, hashes), = lines._chunks(pa.array(["\n".join(" ".join(w) for w in texts)]), 1)
    keys, many = lines.half_keys(hashes, n, 5)
    assert many.tolist() == [4 if len(w) >= 5 else 0 for w in texts]
    named = {}
    for w, four in zip([w for w in texts if len(w) >= 5], keys.reshape(-1, 4).tolist()):
        for longer in (0, 1):
            m = (len(w) + longer - 1) // 2
            for side, half in ((0, w[:m]), (1, w[len(w) - m :])):
                assert named.setdefault((side, len(w) + longer, *half), four[2 * longer + side]) == four[2 * longer + side]
    assert len(set(named.values())) == len(named)
