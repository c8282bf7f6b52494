"""Ids beside nulls, as they came."""

import public_tokenizers

from reelspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_large_ids_beside_a_null(make):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1, 0, 2**60 + 1]
    rows = packing.pack(make([(i, f"text {k}") for k, i in enumerate(ids)]).coalesce(1), PATH, 2).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == sorted(map(str, ids))


def test_very_long_text_is_cut(make):
    rows = packing.pack(make(["word " * 60_000]).coalesce(1), PATH, 2).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens == 60_001 and max(r.length for r in rows) == 4096
