"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

A test item gives phrases: every ``WINDOW`` consecutive words, or the whole item if it is shorter. Training texts are
cut into words once and stored as words at their positions; postings (term, text, position) are read from there. Terms of phrases are counted in the corpus; a phrase's two rarest terms are looked up,
their positions less their offsets in the phrase are start positions, and only starts that both lists name
go on. Those are verified word by word on the text. A phrase with a term that the corpus lacks is never looked up.

A text is named by a 128-bit key, so copies are verified once and doc_id may be null or repeated. Defined results: null
and wordless texts have no words and are clean; items without words or id are ignored; repeated items count once by id;
other columns pass through; empty tables on either side give clean documents or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import ascii_lower, small, stored, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if hit words make up at least one in this many.
SHARE = 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, phrase, terms) of every window of every item; phrase is the terms joined by spaces."""
    rows = items.filter(items["item_id"].isNotNull()).select(items["item_id"].cast("string").alias("item"), words(items["text"]).alias("w"))
    n = F.size("w")
    starts = F.when(n > window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0)))
    rows = rows.select("item", "w", F.explode(starts).alias("s"))
    terms = F.slice("w", F.col("s") + 1, F.lit(window))
    return rows.select("item", F.array_join(terms, " ").alias("phrase"), terms.alias("terms")).distinct()


def index(docs: DataFrame, *kept: str) -> DataFrame:
    """(kept..., k1, k2, w, n_words) of every row of ``docs``: its text's words at their positions, stored in the shared folder."""
    k1, k2 = text_key(docs["text"])
    rows = docs.select(*[docs[c] for c in kept], k1.alias("k1"), k2.alias("k2"), words(docs["text"]).alias("w"))
    return stored(rows.withColumn("n_words", F.greatest(F.size("w"), F.lit(0)).cast("long")), "index")


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The entries (term, k1, k2, pos) of the index ``texts`` for the terms asked for (term)."""
    return texts.select("k1", "k2", F.posexplode("w").alias("pos", "term")).join(terms, "term")


def rarest(texts: DataFrame, asked: DataFrame, lists: int = 2) -> DataFrame:
    """(phrase, len, term, off, rank): the places of each phrase whose terms the corpus has fewest of, rarest first.

    ``asked`` has phrase and terms. Phrases with a term that no text has are left out.
    """
    placed = asked.select("phrase", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    vocabulary = small(stored(placed.select("term").distinct(), "terms"))
    seen = texts.select(F.explode("w").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    by = placed.join(seen, "term", "left").groupBy("phrase", "len").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("by")
    )
    by = by.filter(F.element_at("by", 1)["n"] > 0)
    return by.select("phrase", "len", F.posexplode(F.slice("by", 1, lists)).alias("rank", "p")).select("phrase", "len", "rank", "p.off", "p.term")


def aligned(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(k1, k2, phrase, start): where the offset-adjusted lists of a phrase's rarest terms meet."""
    anchors = small(stored(rarest(texts, asked), "anchors"))
    need = F.when(F.col("len") > 1, 3).otherwise(1)
    # Anchors carry phrase, offset and rank, so the index is intersected as it is read.
    listed = postings(texts, anchors).filter("pos >= off")
    listed = listed.groupBy("k1", "k2", "phrase", (F.col("pos") - F.col("off")).alias("start"), "len").agg(
        F.bit_or(F.when(F.col("rank") == 0, 1).otherwise(2)).alias("met")
    )
    return listed.filter(F.col("met") == need).select("k1", "k2", "phrase", "start", "len")


def exact_matches(texts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, phrase, start, len) of the verified occurrences in the index ``texts``, and (k1, k2, n_words) of the texts looked at.

    Every word of an aligned phrase is looked up at its place, so work follows the number of alignments, not their texts.
    """
    spots = stored(aligned(texts, asked), "spots")
    keys = small(stored(spots.select("k1", "k2").distinct(), "keys"))
    near = texts.join(keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("w").alias("w"), F.first("n_words").alias("n_words"))
    near = stored(near, "texts")
    placed = asked.select("phrase", F.posexplode("terms").alias("off", "term"))
    wanted = spots.join(small(stored(placed, "placed")), "phrase").withColumn("pos", F.col("start") + F.col("off"))
    said = near.select("k1", "k2", F.posexplode("w").alias("pos", "term"))
    met = wanted.join(said, ["k1", "k2", "pos", "term"]).groupBy("k1", "k2", "phrase", "start", "len").agg(F.count(F.lit(1)).alias("n"))
    return met.filter("n = len").select("k1", "k2", "phrase", "start", "len"), near.select("k1", "k2", "n_words")


def proximity_matches(docs: DataFrame, asked: DataFrame, slop: int) -> DataFrame:
    """(k1, k2, phrase, start): starts around which every term of a phrase lies within ``slop`` words of its place.

    The rarest term leaves the starts up to ``slop`` words around its own; the others are looked up in the index of the texts that have it.
    """
    texts = index(docs)
    placed = asked.select("phrase", F.posexplode("terms").alias("off", "term"))
    first = rarest(texts, asked, 1).select("phrase", "term", "off", "len")
    own, shifts = F.col("pos") - F.col("off"), F.sequence(F.lit(-slop), F.lit(slop))
    begin = postings(texts, first).select("k1", "k2", "phrase", "len", F.explode(F.transform(shifts, lambda x: own + x)).alias("start")).distinct()
    rest = postings(texts, placed).select("k1", "k2", "phrase", "off", (F.col("pos") - F.col("off")).alias("at"))
    met = begin.join(rest, ["k1", "k2", "phrase"]).filter(F.abs(F.col("at") - F.col("start")) <= slop)
    met = met.groupBy("k1", "k2", "phrase", "start", "len").agg(F.count_distinct("off").alias("n"))
    return met.filter("n = len").select("k1", "k2", "phrase", "start")


def contamination(texts: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, n_words, n_hit, items) of the texts of the index in which a phrase of an item occurs; items are sorted as strings."""
    listed = stored(phrases(items, window), "phrases")
    found, sizes = exact_matches(texts, listed.select("phrase", "terms").distinct())
    found = stored(found, "found")
    spans = found.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    # A text's spans are bounded by its words.
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - reached))
    hits = spans.groupBy("k1", "k2").agg(F.sum("new").cast("long").alias("n_hit"))
    named = found.select("k1", "k2", "phrase").distinct().join(listed.select("item", "phrase"), "phrase")
    named = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sizes.join(hits, ["k1", "k2"]).join(named, ["k1", "k2"]).select("k1", "k2", "n_words", "n_hit", "items")


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items, contaminated."""
    texts = index(docs, "doc_id")
    found = stored(contamination(texts, items), "contamination")
    rows = texts.select("doc_id", "k1", "k2", "n_words")
    rows = rows.join(small(found.drop("n_words"), 100_000), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were."""
    found = contamination(index(docs), items).filter(is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = small(stored(found.select("k1", "k2"), "contaminated"))
    k1, k2 = text_key(docs["text"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(bad, ["k1", "k2"], "left_anti").select("row.*")
