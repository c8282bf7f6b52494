"""Alignment, text search and frame naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import align as A
from reelspark.operators import text as T
from reelspark.operators.keyword_join import similar
from reelspark.operators.ordered import HOUR_MS
from reelspark.plans.inputs import HOUR, KEYWORDS, KILLS, TOKENS, keywords, kills, query, table, tokens
from reelspark.session import durable
from reelspark.sources import ingest

WIDTH = 24 * HOUR_MS
TOL = 6 * HOUR


def _of(spark, sf, kind):
    return kills(spark, sf).filter(F.col("event_type") == kind)


NEAREST = f"""{KILLS},
l AS (SELECT DISTINCT video_id, ts_ms FROM kills WHERE event_type = 'click'),
r AS (SELECT DISTINCT video_id, ts_ms AS m FROM kills WHERE event_type = 'signup'),
bk AS (SELECT l.video_id, l.ts_ms, r.m FROM l ASOF JOIN r ON l.video_id = r.video_id AND l.ts_ms >= r.m),
ah AS (SELECT l.video_id, l.ts_ms, r.m FROM l ASOF JOIN r ON l.video_id = r.video_id AND l.ts_ms <= r.m),
both_sides AS (SELECT *, abs(m - ts_ms) AS gap_ms FROM (SELECT * FROM bk UNION SELECT * FROM ah)),
pairs AS (SELECT video_id, ts_ms, arg_min(m, (gap_ms, m)) AS match_ms, min(gap_ms) AS gap_ms
          FROM both_sides WHERE gap_ms <= {TOL} GROUP BY video_id, ts_ms)"""


def nearest(spark, sf):
    return A.nearest(_of(spark, sf, "click"), _of(spark, sf, "signup"), TOL, width=WIDTH)


@query("nearest_pairs", f"WITH {NEAREST} SELECT * FROM pairs")
def nearest_pairs(spark, sf):
    return nearest(spark, sf)


DIFFS = """px AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS a,
  list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 777) AS BIGINT) % 256) AS b, label FROM embeddings),
d AS (SELECT vec_id, label, list_avg(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) AS mae,
      list_avg(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS mse FROM px),
dd AS (SELECT *, 100 - mae / 255 * 100 AS similarity FROM d)"""


def diffs(spark, sf):
    """Two 8-bit renderings of every vector as a pair of frames."""
    grey = lambda scale: F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * scale) % 256).cast("int"))
    pairs = table(spark, sf, "embeddings").select("vec_id", "label", grey(1000).alias("a"), grey(777).alias("b"))
    return A.frame_diff(pairs).drop("a", "b")


@query("frame_diff", f"WITH {DIFFS} SELECT vec_id, label, mae, mse, round(similarity, 9) AS similarity FROM dd")
def frame_diff(spark, sf):
    return diffs(spark, sf).withColumn("similarity", F.round("similarity", 9))


@query(
    "pair_diff_stats",
    f"""WITH {DIFFS} SELECT count(*) AS n, round(avg(mae), 9) AS mean, round(quantile_cont(mae, 0.95), 9) AS quantile,
    max(mae) AS max FROM dd""",
)
def pair_diff_stats(spark, sf):
    out = A.diff_stats(diffs(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "quantile")})


@query(
    "gap_stats",
    f"""WITH {NEAREST} SELECT count(*) AS n, round(avg(gap_ms), 6) AS mean,
    round(quantile_cont(CAST(gap_ms AS DOUBLE), 0.95), 6) AS quantile, CAST(max(gap_ms) AS DOUBLE) AS max FROM pairs""",
)
def gap_stats(spark, sf):
    """The same statistics over the gaps of the nearest pairs."""
    out = A.diff_stats(durable(nearest(spark, sf)), "gap_ms")  # read three times
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "quantile")})


@query("worst_pairs", f"WITH {DIFFS} SELECT vec_id, mae FROM dd ORDER BY mae DESC, vec_id LIMIT 6")
def worst_pairs(spark, sf):
    return A.worst_pairs(diffs(spark, sf).select("vec_id", "mae"), 6, tie=["vec_id"])


@query(
    "timing_verdict",
    f"""WITH {KILLS}, s AS (SELECT CASE WHEN k % 17 = 0 THEN NULL ELSE 80 + (c % 2001) / 100.0 END AS similarity FROM kills),
    v AS (SELECT CASE WHEN similarity > 95 THEN 'match' WHEN similarity > 85 THEN 'warning' ELSE 'mismatch' END AS v FROM s)
    SELECT count(*) AS total, count(*) FILTER (WHERE v = 'match') AS n_match, count(*) FILTER (WHERE v = 'warning') AS n_warning,
           count(*) FILTER (WHERE v = 'mismatch') AS n_mismatch FROM v""",
)
def timing_verdict(spark, sf):
    return A.timing_counts(similarities(spark, sf))


def similarities(spark, sf):
    sim = F.when(F.col("k") % 17 != 0, 80 + (F.col("c") % 2001) / 100.0)
    return kills(spark, sf).select("video_id", "ts_ms", "event_id", "k", sim.alias("similarity"))


@query(
    "offset_probe",
    f"""WITH {KILLS}, p AS (SELECT video_id, event_id * 1000 AS ts_ms, 80 + (c % 2001) / 100.0 AS similarity
       FROM (SELECT * REPLACE (0 AS video_id) FROM kills)),
    o AS (SELECT p.video_id, p.ts_ms, p.similarity, unnest([-2000, -1000, 1000, 2000]) AS o, unnest([0, 1, 2, 3]) AS pos FROM p),
    t AS (SELECT o.video_id, o.ts_ms, o.o, o.pos, q.similarity AS s FROM o JOIN p q ON q.video_id = o.video_id AND q.ts_ms = o.ts_ms + o.o
          WHERE o.similarity < 95 AND q.similarity > o.similarity),
    b AS (SELECT video_id, ts_ms, arg_max(o, (s, -pos)) AS best, max(s) AS s FROM t GROUP BY ALL)
    SELECT video_id, ts_ms, similarity, CAST(coalesce(best, 0) AS BIGINT) AS best_offset_ms, coalesce(s, similarity) AS best_similarity
    FROM p LEFT JOIN b USING (video_id, ts_ms)""",
)
def offset_probe(spark, sf):
    """Frames one second apart: the event id is the second."""
    pairs = kills(spark, sf).select(
        F.lit(0).cast("bigint").alias("video_id"),
        (F.col("event_id") * 1000).alias("ts_ms"),
        (80 + (F.col("c") % 2001) / 100.0).alias("similarity"),
    )
    return A.offset_probe(pairs, pairs)


BAND = 2 * HOUR


@query(
    "band_annotate",
    f"""WITH {KILLS}, f AS (SELECT video_id, ts_ms, event_id FROM kills WHERE event_type = 'click'),
    e AS (SELECT video_id, ts_ms, min(event_id) AS seq FROM kills WHERE event_type = 'purchase' GROUP BY ALL),
    j AS (SELECT f.event_id, min(e.seq) AS event_seq, arg_min(e.ts_ms, e.seq) AS event_ts_ms FROM f JOIN e
          ON f.video_id = e.video_id AND e.ts_ms > f.ts_ms - {BAND} AND e.ts_ms < f.ts_ms + {BAND} GROUP BY f.event_id)
    SELECT f.video_id, f.ts_ms, f.event_id, event_seq, event_ts_ms FROM f LEFT JOIN j USING (event_id)""",
)
def band_annotate(spark, sf):
    frames = _of(spark, sf, "click").select("video_id", "ts_ms", "event_id")
    events = _of(spark, sf, "purchase").select("video_id", "ts_ms", F.col("event_id").alias("event_seq"))
    return A.within(frames, events, BAND, width=WIDTH)


@query(
    "event_frames",
    f"""WITH {KILLS}, f AS (SELECT video_id, ts_ms - ts_ms % 60000 AS ts_ms, event_id AS frame_seq FROM kills),
    g AS (SELECT video_id, ts_ms, 'frame_' || min(frame_seq) AS frame_path FROM f WHERE frame_seq % 3 > 0 GROUP BY ALL)
    SELECT f.video_id, f.ts_ms, f.frame_seq AS event_id, g.frame_path FROM f LEFT JOIN g USING (video_id, ts_ms)""",
)
def event_frames(spark, sf):
    """Events and frames rounded to the minute, so several share an instant."""
    minute = kills(spark, sf).withColumn("ts_ms", F.col("ts_ms") - F.col("ts_ms") % 60_000)
    frames = minute.filter(F.col("event_id") % 3 > 0).select(
        "video_id", "ts_ms", F.col("event_id").alias("frame_seq"), F.concat(F.lit("frame_"), "event_id").alias("frame_path")
    )
    return A.event_frames(minute.select("video_id", "ts_ms", "event_id"), frames)


@query(
    "frame_names",
    f"""WITH {KILLS}, f AS (SELECT video_id % 5 AS video_id, ts_ms - ts_ms % 600000 AS ts_ms, event_id AS n FROM kills),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY n) - 1 AS k FROM f)
    SELECT video_id, ts_ms, n, 'frame_' || ts_ms || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.jpg' AS frame_name FROM r""",
)
def frame_names(spark, sf):
    frames = kills(spark, sf).select(
        (F.col("video_id") % 5).alias("video_id"),
        (F.col("ts_ms") - F.col("ts_ms") % 600_000).alias("ts_ms"),
        F.col("event_id").alias("n"),
    )
    return A.frame_names(frames)


@query(
    "frame_ts_from_name",
    f"""WITH {KILLS} SELECT event_id, CASE WHEN k % 9 = 0 THEN 0 ELSE ts_ms END AS ts_ms FROM kills""",
)
def frame_ts_from_name(spark, sf):
    from reelspark.functions import parse

    name = F.when(F.col("k") % 9 == 0, F.lit("cover.jpg")).otherwise(
        F.concat(F.lit("out/frame_"), "ts_ms", F.when(F.col("k") % 2 == 0, "_3").otherwise(""), F.lit(".jpg"))
    )
    return kills(spark, sf).select("event_id", parse.frame_ts_from_name(name).alias("ts_ms"))


@query(
    "frame_grid",
    f"""WITH {KILLS}, v AS (SELECT video_id, count(*) * 250 + video_id * 100 AS d FROM kills GROUP BY video_id)
    SELECT video_id, unnest(range(0, d, 1000)) AS ts_ms FROM v""",
)
def frame_grid(spark, sf):
    videos = kills(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).select(
        "video_id", ((F.col("n") * 250 + F.col("video_id") * 100) / 1000).alias("duration_s")
    )
    return ingest.frame_grid(videos, 1000)


@query(
    "scan_grid",
    f"""WITH {KILLS} SELECT event_id, ts_ms AS center_ms,
    unnest(range(greatest(0, ts_ms - 2500), ts_ms + 2500 + 1, 1000)) AS ts_ms FROM kills""",
)
def scan_grid(spark, sf):
    return T.scan_grid(kills(spark, sf).select("event_id", F.col("ts_ms").alias("center_ms")), 2500, 1000)


# Characters in common bound the LCS; the LCS itself by folding the text over a row of the dynamic programme
LETTERS = f"""{TOKENS}, {KEYWORDS},
words AS (SELECT DISTINCT lower(text) AS a FROM tokens),
wa AS (SELECT a, ch, count(*) AS k FROM (SELECT a, unnest(string_split(a, '')) AS ch FROM words) GROUP BY ALL),
kb AS (SELECT b, ch, count(*) AS k FROM (SELECT keyword AS b, unnest(string_split(keyword, '')) AS ch FROM keywords) GROUP BY ALL)"""


def _ratios(name: str, pairs: str) -> str:
    """SQL of table ``name`` (a, b, sim) for the pairs (a, b) of the given select."""
    return f"""{name}_lcs AS (
        SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS row FROM ({pairs})
        UNION ALL
        SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, j:
                 list_append(acc, CASE WHEN substring(b, j[1], 1) = substring(a, i + 1, 1) THEN row[j[1]] + 1
                                       ELSE greatest(row[j[1] + 1], acc[-1]) END), [CAST(0 AS BIGINT)])
        FROM {name}_lcs WHERE i < length(a)),
{name} AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 2.0 * row[-1] / (length(a) + length(b)) END AS sim
           FROM {name}_lcs WHERE i = length(a))"""


RATIO = 0.6
RATIOS = f"""{LETTERS}, {_ratios("scored", f"""SELECT a, b FROM wa JOIN kb USING (ch) WHERE 2 * least(length(a), length(b)) >= {RATIO} * (length(a) + length(b))
          GROUP BY a, b HAVING 2 * sum(least(wa.k, kb.k)) >= {RATIO} * (length(a) + length(b))""")},
ratios AS (SELECT * FROM scored WHERE sim >= {RATIO})"""
# words without a keyword that close meet all that share a character
ALL_RATIOS = f"""{RATIOS}, {_ratios("others", "SELECT DISTINCT a, b FROM wa JOIN kb USING (ch) WHERE a NOT IN (SELECT a FROM ratios)")},
all_ratios AS (SELECT * FROM ratios UNION ALL SELECT * FROM others)"""


@query(
    "keyword_matches",
    f"""WITH RECURSIVE {RATIOS}, m AS (
      SELECT t.*, k.keyword, k.kw_idx, r.sim FROM tokens t JOIN ratios r ON r.a = lower(t.text) JOIN keywords k ON r.b = k.keyword),
    n AS (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY sim DESC, det_idx, kw_idx) AS n FROM m)
    SELECT video_id, ts_ms, keyword, text, CAST(confidence AS DOUBLE) AS confidence, round(sim, 9) AS similarity FROM n WHERE n = 1""",
)
def keyword_matches(spark, sf):
    found = T.match_keywords(tokens(spark, sf), keywords(spark, sf), RATIO)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    "keyword_scan_window",
    f"""WITH RECURSIVE {ALL_RATIOS}, tops AS (
      SELECT a, arg_max(keyword, (sim, -kw_idx)) AS keyword, max(sim) AS sim FROM all_ratios JOIN keywords ON b = keyword GROUP BY a),
    m AS (SELECT t.*, r.keyword, r.sim FROM tokens t JOIN tops r ON r.a = lower(t.text)),
    ctr AS (SELECT DISTINCT conv_id AS video_id, turn * 1000 AS center_ms FROM conversations WHERE turn % 2 = 1),
    grid AS (SELECT video_id, center_ms, unnest(range(greatest(0, center_ms - 1000), center_ms + 1001, 500)) AS ts_ms FROM ctr),
    cnt AS (SELECT video_id, ts_ms, count(*) AS n_det FROM tokens GROUP BY ALL),
    agg AS (SELECT g.video_id, g.center_ms, count(*) AS grid_instants, count(*) FILTER (WHERE n_det > 0) AS frames_with_detections,
              CAST(coalesce(sum(n_det), 0) AS BIGINT) AS total_detections FROM grid g LEFT JOIN cnt USING (video_id, ts_ms) GROUP BY ALL),
    b AS (SELECT g.video_id, g.center_ms, m.ts_ms, m.keyword, m.text, m.sim,
            row_number() OVER (PARTITION BY g.video_id, g.center_ms ORDER BY sim DESC, m.ts_ms, det_idx) AS n
          FROM grid g JOIN m USING (video_id, ts_ms) WHERE sim > 0)
    SELECT agg.*, coalesce(sim >= 0.8, FALSE) AS found, keyword, text, round(coalesce(sim, 0.0), 9) AS similarity, b.ts_ms
    FROM agg LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (video_id, center_ms)""",
)
def keyword_scan_window(spark, sf):
    centers = table(spark, sf, "conversations").filter(F.col("turn") % 2 == 1).select(
        F.col("conv_id").alias("video_id"), (F.col("turn") * 1000).alias("center_ms")
    )
    out = T.scan_keywords(tokens(spark, sf), centers, keywords(spark, sf), 1000, 500, 0.8)
    return out.withColumn("similarity", F.round("similarity", 9))


@query(
    "indel_ratio",
    f"""WITH RECURSIVE {RATIOS} SELECT a, b, round(sim, 9) AS similarity FROM ratios""",
)
def indel_ratio(spark, sf):
    """Every distinct word with every keyword that it resembles."""
    words = tokens(spark, sf).select(F.lower("text").alias("norm")).distinct()
    return similar(words, keywords(spark, sf), RATIO).select(
        F.col("norm").alias("a"), F.col("keyword").alias("b"), F.round("similarity", 9).alias("similarity")
    )


@query("keyword_matches_preview")
def keyword_matches_preview(spark, sf):
    """Preview mode scores by matching blocks (Python's difflib; no SQL twin)."""
    return T.match_keywords_blocks(tokens(spark, sf), ["the", "tion", "maison"], 0.6)


@query(
    "top_detections",
    f"""WITH {TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY confidence DESC, det_idx) AS rank FROM tokens)
    SELECT video_id, ts_ms, CAST(det_idx AS INTEGER) AS det_idx, text, CAST(confidence AS DOUBLE) AS confidence, CAST(rank AS INTEGER) AS rank
    FROM r WHERE rank <= 10""",
)
def top_detections(spark, sf):
    return T.top_detections(tokens(spark, sf), 10)
