"""Queries on link evidence, barcodes and long-read alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as lk
from . import fixtures as fx
from .catalog import query
from .fixtures import sql

EDGE_SQL = """, eo AS (SELECT id1, id2, gap, score, row_number() OVER (PARTITION BY id1, id2 ORDER BY gap) AS rn,
      count(*) OVER (PARTITION BY id1, id2) AS n FROM links),
    eg AS (SELECT id1, id2, n AS n_link, cast(sum(score) as bigint) AS score,
      max(CASE WHEN rn = n // 2 + 1 THEN gap END) AS hi, max(CASE WHEN rn = greatest(n // 2, 1) THEN gap END) AS lo FROM eo GROUP BY 1, 2, 3),
    edges AS (SELECT id1, id2, n_link, score, cast(CASE WHEN n_link % 2 = 1 THEN hi WHEN (hi + lo) // 2 >= 0 THEN (hi + lo) // 2
      ELSE ceil((hi + lo) // 2 + 0.5) END as bigint) AS gap FROM eg WHERE n_link >= 3)"""


def merged(spark, d, min_link=3):
    return lk.merge_links(fx.links(spark, d), min_link)


@query("link_aggregate_having", "A8 A9 A11 O1 G32", sql(EDGE_SQL + " SELECT id1, id2, n_link, score, gap FROM edges", "links"))
def link_aggregate_having(spark, d):
    return merged(spark, d).drop("is_overlap")


@query("link_average_gap", "A10 G34", sql(" SELECT id1, id2, count(*) AS n_link, round(avg(gap), 6) AS gap FROM links GROUP BY 1, 2 HAVING count(*) >= 2", "links"))
def link_average_gap(spark, d):
    return lk.average_gap(fx.links(spark, d), 2).withColumn("gap", F.round("gap", 6))


@query("link_breakdown", "A9", sql("""
    SELECT id1, id2, side, part, count(*) AS n FROM (SELECT id1, id2, 1 AS side, off1 AS part FROM links UNION ALL SELECT id1, id2, 2, off2 FROM links) GROUP BY ALL""", "links"))
def link_breakdown(spark, d):
    return lk.breakdown(fx.links(spark, d))


@query("link_sources_by_mode", "U2 U3 G33", sql("""
    , a AS (SELECT id1, id2, gap, score, false AS o FROM links WHERE pair % 2 = 0 UNION ALL SELECT id1, id2, -5, 0, true FROM links WHERE pair % 11 = 0)
    SELECT id1, id2, count(*) - CASE WHEN bool_or(o) THEN 1 ELSE 0 END AS n_link, bool_or(o) AS is_overlap,
      cast(CASE WHEN bool_or(o) THEN 0 ELSE sum(score) END as bigint) AS score, cast(max(CASE WHEN o THEN gap END) as bigint) AS overlap_gap FROM a GROUP BY 1, 2 HAVING count(*) >= 3 OR bool_or(o)""", "links"))
def link_sources_by_mode(spark, d):
    l = fx.links(spark, d)
    src = {"pair": l.where("pair % 2 = 0").select("id1", "id2", "gap", "score", F.lit(False).alias("is_overlap")),
           "long": l.where("pair % 2 = 1").select("id1", "id2", "gap", "score", F.lit(False).alias("is_overlap")),
           "overlap": l.where("pair % 11 = 0").select("id1", "id2", F.lit(-5).cast("bigint").alias("gap"), F.lit(0).cast("bigint").alias("score"), F.lit(True).alias("is_overlap"))}
    return lk.merge_links(lk.evidence({"pair", "overlap"}, src), 3).select(
        "id1", "id2", "n_link", "is_overlap", "score", F.when(F.col("is_overlap"), F.col("gap")).alias("overlap_gap"))


@query("tag_counts_by_contig", "A33", sql(" SELECT tag, node, count(*) AS n FROM tag_rows GROUP BY 1, 2", "tag_rows"))
def tag_counts_by_contig(spark, d):
    return lk.tag_counts(fx.tag_rows(spark, d))


@query("tag_counts_by_scaffold", "A34", sql("""
    SELECT tag, node % 97 AS scaffold, count(*) AS n FROM tag_rows GROUP BY 1, 2 HAVING count(*) >= 2""", "tag_rows"))
def tag_counts_by_scaffold(spark, d):
    parts = fx.nodes(spark, d).select("node", (F.col("node") % 97).alias("scaffold"))
    t = lk.tag_counts_by_scaffold(lk.tag_counts(fx.tag_rows(spark, d)), parts, 2)
    return t.withColumn("n", F.col("n").cast("bigint"))


@query("tag_common_count", "J27", sql("""
    , t AS (SELECT tag, """ + fx.folded_sql("node") + """ AS node, count(*) AS n FROM tag_rows GROUP BY 1, 2), p AS (SELECT DISTINCT id1, id2 FROM links),
    s AS (SELECT id1, id2, sum(least(a.n, b.n)) AS c FROM p JOIN t a ON a.node = id1 JOIN t b ON b.node = id2 AND a.tag = b.tag GROUP BY 1, 2)
    SELECT p.id1, p.id2, cast(coalesce(c, 0) as bigint) AS common FROM p LEFT JOIN s ON s.id1 = p.id1 AND s.id2 = p.id2""", "tag_rows", "links"))
def tag_common_count(spark, d):
    t = lk.tag_counts(fx.tag_rows(spark, d).withColumn("node", fx.folded("node")))
    return lk.common_tags(fx.links(spark, d), t)


@query("nodes_sharing_tags", "J25 J26", sql("""
    , t AS (SELECT DISTINCT tag, node FROM tag_rows)
    SELECT a.node AS id1, b.node AS id2, count(*) AS common FROM t a JOIN t b ON a.tag = b.tag AND a.node < b.node GROUP BY 1, 2 HAVING count(*) >= 2""", "tag_rows"))
def nodes_sharing_tags(spark, d):
    return lk.co_occurring(fx.tag_rows(spark, d), "tag", "node", 2)


_MERGED = """, mh AS (SELECT read_id, node, cast(sum(score) as bigint) AS score FROM hits GROUP BY 1, 2),
    bh AS (SELECT read_id, node, q_start, t_start FROM (SELECT *, row_number() OVER (PARTITION BY read_id, node ORDER BY score DESC, q_start, q_end DESC, t_start DESC) AS rn FROM hits) WHERE rn = 1),
    ex AS (SELECT read_id, bh.node, score, q_start - t_start AS l, q_start - t_start + len - 1 AS r FROM bh JOIN mh USING (read_id, node) JOIN nodes ON nodes.node = bh.node)"""


@query("long_read_links", "J25 A16", sql(_MERGED + """,
    lp AS (SELECT a.read_id, a.node AS id1, b.node AS id2, a.score + b.score AS score,
      CASE WHEN a.l <= b.l THEN 1 ELSE -1 END AS direction, CASE WHEN a.l <= b.l THEN b.l - a.r - 1 ELSE a.l - b.r - 1 END AS gap,
      count(*) OVER (PARTITION BY a.node, b.node) AS shared, CASE WHEN a.l <= b.l THEN a.r <= b.r ELSE b.r <= a.r END AS ok
      FROM ex a JOIN ex b ON a.read_id = b.read_id AND a.node < b.node)
    SELECT read_id, id1, id2, direction, gap, score FROM lp WHERE ok AND shared >= 2 AND gap >= -2000""", "hits", "nodes"))
def long_read_links(spark, d):
    return lk.long_read_links(fx.hits(spark, d), fx.nodes(spark, d).select("node", "len"), 2, 2000)


@query("tag_sessions", "W5", sql("""
    , o AS (SELECT tag, node, pos, lag(pos) OVER (PARTITION BY tag, node ORDER BY pos) AS p FROM positions),
    s AS (SELECT tag, node, pos, sum(CASE WHEN p IS NULL OR pos - p > 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY tag, node ORDER BY pos ROWS UNBOUNDED PRECEDING) AS session FROM o)
    SELECT tag, node, cast(session as bigint) AS session, min(pos) AS first, max(pos) AS last, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 2""", "positions"))
def tag_sessions(spark, d):
    return lk.sessions(fx.positions(spark, d), min_reads=2).withColumn("n", F.col("n").cast("bigint"))


@query("molecule_length", "W5", sql("""
    , o AS (SELECT tag, node, pos, lag(pos) OVER (PARTITION BY tag, node ORDER BY pos) AS p FROM positions),
    s AS (SELECT tag, node, pos, sum(CASE WHEN p IS NULL OR pos - p > 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY tag, node ORDER BY pos ROWS UNBOUNDED PRECEDING) AS session FROM o),
    m AS (SELECT max(pos) - min(pos) AS l FROM s GROUP BY tag, node, session HAVING count(*) >= 2)
    SELECT count(*) AS n, round(CASE WHEN count(*) >= 20 THEN sum(l * l * 1.0) / nullif(sum(l), 0) ELSE 50000 END, 4) AS mean FROM m""", "positions"))
def molecule_length(spark, d):
    m = lk.molecule_length(lk.sessions(fx.positions(spark, d), min_reads=2))
    return m.select("n", F.round("mean", 4).alias("mean"))


@query("barcode_links", "J26")
def barcode_links(spark, d):
    rows = fx.hits(spark, d).select(F.col("read_id").alias("tag"), "node", F.col("q_start").alias("pos"))
    spans = lk.sessions(rows, gap=200)
    lengths = fx.nodes(spark, d).select("node", F.lit(900).alias("len"))
    return lk.barcode_links(spans, lengths, 300, 2)


@query("alignment_filter", "P11 P12 S15", sql("""
    , h AS (SELECT read_id, node, q_start, q_end, t_start, t_start + (q_end - q_start) + node % 9 AS t_end, match, 900 AS q_len, 500 + node AS t_len FROM hits),
    a AS (SELECT *, greatest(q_end - q_start, t_end - t_start) AS aln FROM h)
    SELECT read_id, node, q_start, q_end, t_end FROM a WHERE match >= aln * 0.8 AND (aln >= 200 OR aln >= least(q_len, t_len) * 0.3)""", "hits"))
def alignment_filter(spark, d):
    h = fx.hits(spark, d).select("*", (F.col("t_start") + F.col("q_end") - F.col("q_start") + F.col("node") % 9).alias("t_end"),
                                 F.lit(900).alias("q_len"), (F.col("node") + 500).alias("t_len"))
    return lk.alignment_filter(h, 0.8, 0.3, 200).select("read_id", "node", "q_start", "q_end", "t_end")


@query("alignment_span_ratio", "A13", sql("""
    SELECT round(sum(q_end - q_start) / sum(q_end - q_start + node % 9), 6) AS ratio FROM hits""", "hits"))
def alignment_span_ratio(spark, d):
    h = fx.hits(spark, d).select("q_start", "q_end", "t_start", (F.col("t_start") + F.col("q_end") - F.col("q_start") + F.col("node") % 9).alias("t_end"))
    return lk.span_ratio(h).select(F.round("ratio", 6).alias("ratio"))


_HITS_ID = """, h AS (SELECT *, q_end - q_start AS span FROM hits),
    hd AS (SELECT read_id, node, q_start, q_end, t_start, score, span, row_number() OVER (ORDER BY read_id, node, q_start, q_end, t_start, score) AS hit
      FROM (SELECT DISTINCT read_id, node, q_start, q_end, t_start, score, span FROM h)),
    rv AS (SELECT a.hit AS ha, b.hit AS hb, a.score AS sa, b.score AS sb FROM hd a JOIN hd b ON a.read_id = b.read_id
      AND least(a.q_end, b.q_end) - greatest(a.q_start, b.q_start) > 20
      AND (a.score > b.score OR (a.score = b.score AND (a.span > b.span OR (a.span = b.span AND a.hit < b.hit)))))"""


@query("alignments_suppressed_unique", "O5 O7", sql(_HITS_ID + """
    SELECT read_id, node, q_start, q_end, t_start, score FROM hd WHERE hit NOT IN (SELECT hb FROM rv) AND hit NOT IN (SELECT ha FROM rv WHERE 2 * sb > sa)""", "hits"))
def alignments_suppressed_unique(spark, d):
    return lk.suppress_unique(_unique_hit_ids(spark, d), 20).drop("hit")


def _unique_hit_ids(spark, d):
    from ..session import materialize
    from ..sources.readers import dense_ids
    h = fx.hits(spark, d).select("read_id", "node", "q_start", "q_end", "t_start", "score").distinct()
    key = F.struct("read_id", "node", "q_start", "q_end", "t_start", "score")
    ids = dense_ids(h.select(key.alias("k")), "k", "hit", "hits")
    return materialize(ids.select("k.*", "hit"), "hits-id")


@query("alignments_suppressed_greedy", "O6")
def alignments_suppressed_greedy(spark, d):
    return lk.suppress_greedy(_unique_hit_ids(spark, d), 20).drop("hit")
