"""Piece ids by backtracking against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from reelspark.llm import piece_merges
from reelspark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return piece_merges.Encoder(PATH)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def made_up(r, own, k):
    letters = sorted({c for p in own.ids for c in p})
    return [
        lambda: "".join(r.choice("ab cdeiou\n\r\t▁ ") for _ in range(r.randrange(40))),
        lambda: "".join(r.choice(letters) for _ in range(r.randrange(20))),
        lambda: "".join(r.choice(own.pieces) for _ in range(r.randrange(12))).replace("▁", " "),
        lambda: " " * r.randrange(40) + "x" * r.randrange(60) + " " * r.randrange(40),
        lambda: "".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000), r.randrange(32, 300)])) for _ in range(r.randrange(20))),
    ][k % 5]()


def test_ids_and_text_as_the_library(own, library):
    r = random.Random(3)
    for text in [made_up(r, own, k) for k in range(3000)] + ["", " ", "<s>", "<0x41>", "\x00a", " \r\n ", "▁▁a▁"]:
        want = library.encode(text)
        assert ids(own, text) == want
        assert own.decode(want) == library.decode(want)


def test_any_row_of_ids_is_decoded(own, library):
    r = random.Random(4)
    for _ in range(3000):
        row = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(131, 259), 0, 1, 2, 28705, 259]) for _ in range(r.randrange(9))]
        assert own.decode(row) == library.decode(row), row


def test_backtracking_agrees_with_merging(own):
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("aeinrst") for _ in range(r.randrange(1, 25)))
        assert own.backtrack(text) == own.merge(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 100_000, " " * 100_000, "中" * 50_000, "🙂" * 20_000, "word, " * 60_000])
def test_very_long_texts(own, library, text):
    assert ids(own, text) == library.encode(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_merges, "PARTS", 3)
    monkeypatch.setattr(piece_merges, "PAIRS", 5)
    own = piece_merges.Encoder(PATH)
    for text in ["the quick brown fox jumps over it", "over it jumps the quick fox"] * 3:
        assert ids(own, text) == library.encode(text)


@pytest.mark.parametrize(("kind", "rules"), [(1, b"\x18\x01\x20\x00"), (2, b"\x12\x01x\x20\x00"), (2, b"\x20\x01"), (2, b"\x20\x00\x28\x00")])
def test_other_models_are_refused(tmp_path, kind, rules):
    piece = b"\x0a\x01a\x15\x00\x00\x80\xbf"
    data = b"".join(tag + bytes([len(part)]) + part for tag, part in ((b"\x0a", piece), (b"\x0a", b"\x0a\x05<unk>\x18\x02"), (b"\x12", bytes([24, kind])), (b"\x1a", rules)))
    (tmp_path / "m").write_bytes(data)
    with pytest.raises(ValueError):
        piece_merges.Model(str(tmp_path / "m"))
    (tmp_path / "m").write_bytes(data.replace(bytes([0x12, 2, 24, kind]), bytes([0x12, 2, 24, 2])).replace(bytes([0x1A, len(rules)]) + rules, b"\x1a\x02\x20\x00"))
    assert ids(piece_merges.Encoder(str(tmp_path / "m")), "aab bb") == [1, 0, 0, 1]


def test_tables(spark, make, library):
    docs = make([None, "", "a b", "a b", (None, "x\ny"), (2**60 + 1, "é🙂")]).withColumn("coded", F.lit("x")).withColumn("ids", F.lit(1))
    coded = docs.select("*", piece_merges.round_trip(docs["text"], PATH).alias("r"), piece_merges.encode(docs["text"], PATH).alias("e"))
    rows = coded.withColumn("d", piece_merges.decode(F.col("e"), PATH)).collect()
    for row in rows:
        assert row.r.ids == row.e == library.encode(row.text or "") and row.r.decoded == row.d == (row.text or "")
    assert coded.limit(0).count() == 0 and {r.doc_id for r in rows} >= {None, 2**60 + 1}


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_piece_ids"](spark, sf).collect()
    assert len(rows) == len(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        want = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), digest(",".join(map(str, want))), digest(library.decode(want)))
