"""Operators on single texts: language, token counts, quality, urls, pseudonyms."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import language, pseudonyms, quality, token_cache, urls
from reelspark.llm.queries import QUERIES
from reelspark.llm.queries_text import RULES
from reelspark.llm.tokenizing import Pieces

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000


# language


@pytest.fixture(scope="module")
def profiles(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_held_out(spark):
    found = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_trigrams_do_not_depend_on_the_piece(monkeypatch):
    text = "Ärger über Öl, façade! " * 50
    want = language.trigram_counts(text)
    monkeypatch.setattr(language, "PIECE", 37)
    got = language.trigram_counts(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_language_edges(spark, make, profiles):
    docs = make([None, "", "123 !?", "the and of", "the and of", (None, "und der die"), LONG]).withColumn("score", F.lit("x")).withColumn("p", F.lit(1))
    rows = docs.select("doc_id", language.identify(docs["text"], profiles, spark).alias("p")).collect()
    assert [r.p.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[0].p.score == 0
    assert rows[3].p == rows[4].p and rows[6].p.n_grams > 200_000
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns and kept.filter("text is null or text = ''").count() == 0
    assert language.keep_known(docs.limit(0), profiles).count() == 0


def test_language_with_nothing_learned(spark, make):
    empty = language.learn(make([]))
    docs = make(["the and of"])
    assert docs.select(language.identify(docs["text"], empty, spark).alias("p")).first().p.lang_pred == "und"


def test_mixture_of_two_languages(spark, make, profiles):
    by = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 2000 and 9000").collect()}
    both = by["en"][:1500] + " " + by["de"][:1500]
    docs = make([both, by["fr"][:1500]])
    rows = [r.p.proportions for r in docs.select(language.identify(docs["text"], profiles, spark).alias("p")).collect()]
    assert set(rows[0]) >= {"en", "de"} and abs(rows[0]["en"] - 0.5) < 0.2 and list(rows[1]) == ["fr"]


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name):
    path = public_tokenizers.path(name)
    library, rng = Tokenizer.from_file(path), random.Random(5)
    signs = "ab Éß1'!s<|.\n\t  é½日İΣᠮ"
    texts = ["", " ", "a  b", "it's don't I'LL 'S", "a <|endoftext|> b<|endoftext|>", "日本語 ½ ²", "a᠎ b", "ŉ ĳ", " a ", "́a"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Pieces(path, False).encode(texts)] == want
    assert Pieces(path, True).encode(texts) == [len(w) for w in want]


def test_cache_encodes_only_misses(spark, make, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/cache"
    first = make(["a b", "a b", None, "", "<|endoftext|>"]).withColumn("digest", F.lit("x"))
    rows = {r.row.doc_id: (r.n_bytes, r.n_tokens) for r in token_cache.count_tokens(first, path, cache).collect()}
    assert rows == {0: (3, 2), 1: (3, 2), 2: (0, 0), 3: (0, 0), 4: (13, 1)}
    assert spark.read.parquet(cache).count() == 3
    token_cache.count_tokens(make(["a b", "new"]), path, cache).collect()
    assert spark.read.parquet(cache).count() == 4
    assert token_cache.count_tokens(make([]), path, cache).count() == 0 and spark.read.parquet(cache).count() == 4


def test_op4_against_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_token_counts"](spark, SF).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


# quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    docs = make(["good text here", "BAD!! BAD!!", None, "", LONG, (None, "x")])
    model = quality.learn(docs, labels)
    scores = [r.s for r in docs.select(quality.score(docs["text"], model, spark).alias("s")).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    nothing = quality.learn(docs, labels.limit(0))
    assert docs.select(quality.score(docs["text"], nothing, spark).alias("s")).first().s == 0.5
    assert docs.limit(0).select(quality.score(docs["text"], model, spark)).count() == 0


def test_pairwise_interaction_is_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 3) in model.pairs and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95


# urls


def expected_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def expected_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_urls_against_plain_rules(spark):
    urls_ = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://a.example.com/en/", "http://example.com", "x://b.net/es/1://c", "http://c.net/fr#", "http://com/", "http://xcom/", "http://a.org?/en", "http://É.com/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls_)] + [(None, "http://a.com/x", 1)], "page_id long, url string, signs int")
    for r in urls.judge(pages, RULES).collect():
        if r.page_id is not None:
            host, path = expected_parts(urls_[r.page_id])
            rule = expected_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
            assert rule is None or r.verdict == rule[1]
            assert r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_url_ratios_against_recursion(spark):
    good, bad = ["http://ab.com/x", "http://ab.com/y", "abab"], ["http://zz.net/q", "zzzz"]
    labelled = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "signs string, good boolean")
    texts = spark.createDataFrame([("http://ab.net/x",), ("abzq",)], "signs string")
    got = sorted(r.score for r in urls.scored(texts, urls.gram_counts(labelled)).collect())

    def chance(corpus, context, c):
        if context is None:
            return 1 / urls.ALPHABET
        low = chance(corpus, context[1:] if context else None, c)
        follow = [s[i] for s in corpus for i in range(urls.ORDER, len(s)) if s[i - len(context) : i] == context]
        t = len(set(follow))
        return (follow.count(c) + t * low) / (len(follow) + t) if follow else low

    pad = urls.PAD * urls.ORDER
    want = []
    for text in ("http://ab.net/x", "abzq"):
        s = pad + text
        each = [np.log(chance([pad + g for g in good], s[i - 4 : i], s[i]) / chance([pad + b for b in bad], s[i - 4 : i], s[i])) for i in range(4, len(s))]
        want.append(np.mean(each))
    assert got == pytest.approx(sorted(want))


def test_url_query_is_whole(spark):
    rows = QUERIES["op6_url_filter"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


# pseudonyms


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, make):
    card = "4539 1488 0343 6467"
    text = f"Pay {card}, not 4539148803436468; mail a.B9@x.org or a.B9@x.org from 10.20.30.40, 999.1.1.1, on 2024-02-29 or 31/12/1999, not 2023-02-30; 078-05-1120, 000-12-1234; +1 (386) 555-3733."
    docs = make([text, f"again {card} 2024-02-29", None, "", "nothing", (None, text)]).withColumn("found", F.lit(1))
    out = pseudonyms.pseudonymise(docs, "k").collect()
    new = out[0].text
    assert len(new) == len(text) or abs(len(new) - len(text)) <= 9
    for kept in ("4539148803436468", "999.1.1.1", "2023-02-30", "000-12-1234", "@x.org"):
        assert kept in new
    for gone in (card, "a.B9@x.org", "10.20.30.40", "2024-02-29", "31/12/1999", "078-05-1120", "555-3733"):
        assert gone not in new
    moved = re.search(r"Pay ([\d ]+),", new).group(1)
    assert luhn(moved.replace(" ", "")) and moved[0] == "4" and [len(p) for p in moved.split(" ")] == [4] * 4
    assert moved in out[1].text and len(set(re.findall(r"[\w.]+@x.org", new))) == 1
    assert (out[2].text, out[3].text, out[4].text, out[5].text) == (None, "", "nothing", new)
    assert [f.kind for f in out[0].found] == ["card", "email", "email", "address", "date", "slash_date", "social", "phone"]
    assert pseudonyms.pseudonymise(docs.limit(0), "k").count() == 0


def test_pseudonyms_can_be_revealed_and_are_distinct(spark):
    values = [f"10.0.{i}.{i + 1}" for i in range(40)] + [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in (1, 15, 28)] + [f"u{i}@x.org" for i in range(20)] + [f"123-45-{i:04d}" for i in range(1, 30)]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    moved = rows.select("v", pseudonyms.pseudonym(F.col("v"), "k")["text"].alias("p"))
    back = moved.select("v", "p", pseudonyms.reveal(F.col("p"), "k").alias("b")).collect()
    assert all(r.v == r.b for r in back) and len({r.p for r in back}) == len(values) and sum(r.p != r.v for r in back) > len(values) - 3
    other = rows.select(pseudonyms.pseudonym(F.col("v"), "other")["text"].alias("p")).collect()
    assert sum(a.p != b.p for a, b in zip(back, other)) > len(values) - 5


def test_op8_leaves_no_valid_card(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = 0
    for r in QUERIES["op8_pseudonyms"](spark, "/root/testdata/sf0.01").collect():
        cards = [c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", texts[r.doc_id] or "") if luhn(c)]
        found += len(cards)
        assert not any(c in r.text for c in cards)
    assert found
