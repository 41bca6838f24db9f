"""Queries on depth, break points, masks and pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as cv, kmers as km
from . import fixtures as fx
from .catalog import query
from .fixtures import canon_sql, kmers_sql, sql

BASE = 1704067200   # first second of the events table


def _iv(spark, d):
    return fx.intervals(spark, d).select("node", "tag", (F.col("s") - BASE).alias("s"), (F.col("e") - BASE).alias("e"))


_DEPTH = f""", iv AS (SELECT node, tag, s - {BASE} AS s, e - {BASE} AS e FROM intervals),
    st AS (SELECT node, s AS pos, 1 AS dl FROM iv WHERE e > s UNION ALL SELECT node, e, -1 FROM iv WHERE e > s),
    sg AS (SELECT node, pos, sum(dl) AS dl FROM st GROUP BY 1, 2 HAVING sum(dl) <> 0),
    ds AS (SELECT node, pos AS "start", lead(pos) OVER (PARTITION BY node ORDER BY pos) AS "end",
      cast(sum(dl) OVER (PARTITION BY node ORDER BY pos) as bigint) AS depth FROM sg),
    dep AS (SELECT * FROM ds WHERE "end" IS NOT NULL AND depth <> 0)"""


@query("physical_coverage", "W3 W4 A36", sql(_DEPTH + ' SELECT node, "start", "end", depth FROM dep', "intervals"))
def physical_coverage(spark, d):
    return cv.depth_segments(_iv(spark, d))


@query("pair_inner_intervals", "W3", sql("""
    , p AS (SELECT id1 AS node, off1 * 97 AS l, 300 + gap AS ins FROM links), j AS (SELECT p.*, len FROM p JOIN nodes ON nodes.node = p.node),
    c AS (SELECT node, least(least(greatest(l, 0), len - 1) + 100, len - 1) AS s, greatest(least(greatest(l + ins, 0), len - 1) - 100, 0) + 1 AS e
      FROM j WHERE abs(ins - 300) <= 30) SELECT node, cast(s as bigint) AS s, cast(e as bigint) AS e FROM c WHERE e > s""", "links", "nodes"))
def pair_inner_intervals(spark, d):
    p = fx.links(spark, d).select(F.col("id1").alias("node"), (F.col("off1") * 97).alias("left"), (F.col("gap") + 300).alias("insert"))
    return cv.pair_intervals(p, fx.nodes(spark, d).select("node", "len"), 300, 30, 100)


_CHAIN_IN = """, lh AS (SELECT read_id, node, 800 AS read_len, t_start + q_start AS t_start, t_start + q_end AS t_end FROM hits),
    nl AS (SELECT node, 100000 + len AS len FROM nodes),
    ch AS (SELECT read_id, read_len, lh.node, least(greatest(t_start, 0), len - 1) AS s, max(least(greatest(t_end, 0), len - 1)) AS e FROM lh JOIN nl ON nl.node = lh.node GROUP BY 1, 2, 3, 4),
    cb AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY read_id, node ORDER BY s) + 1 > read_len THEN 1 ELSE 0 END AS nw FROM ch),
    cr AS (SELECT *, sum(nw) OVER (PARTITION BY read_id, node ORDER BY s) AS run FROM cb),
    cs AS (SELECT read_id, node, run, max(e) - min(s) AS span FROM cr GROUP BY 1, 2, 3),
    cx AS (SELECT read_id, node, run FROM (SELECT *, row_number() OVER (PARTITION BY read_id, node ORDER BY span DESC, run) AS rn FROM cs) WHERE rn = 1),
    chains AS (SELECT cr.read_id, cr.node, s, e, lead(s) OVER (PARTITION BY cr.read_id, cr.node ORDER BY s) AS nx FROM cr JOIN cx ON cr.read_id = cx.read_id AND cr.node = cx.node AND cr.run = cx.run)"""


def _chains(spark, d):
    h = fx.hits(spark, d).select("read_id", "node", F.lit(800).alias("read_len"),
                                 (F.col("t_start") + F.col("q_start")).alias("t_start"), (F.col("t_start") + F.col("q_end")).alias("t_end"))
    n = fx.nodes(spark, d).select("node", (F.col("len") + 100000).alias("len"))
    return cv.alignment_chains(h, n)


@query("long_read_chains", "W4 W14", sql(_CHAIN_IN + ' SELECT read_id, node, s, e, nx AS next FROM chains', "hits", "nodes"))
def long_read_chains(spark, d):
    return _chains(spark, d)


@query("long_read_coverage", "W4", sql(_CHAIN_IN + """, iv AS (SELECT node, min(s) AS s, max(e) AS e FROM chains GROUP BY read_id, node),
    st AS (SELECT node, s AS pos, 1 AS dl FROM iv WHERE e > s UNION ALL SELECT node, e, -1 FROM iv WHERE e > s),
    sg AS (SELECT node, pos, sum(dl) AS dl FROM st GROUP BY 1, 2 HAVING sum(dl) <> 0),
    ds AS (SELECT node, pos AS "start", lead(pos) OVER (PARTITION BY node ORDER BY pos) AS "end", cast(sum(dl) OVER (PARTITION BY node ORDER BY pos) as bigint) AS depth FROM sg)
    SELECT node, "start", "end", depth FROM ds WHERE "end" IS NOT NULL AND depth <> 0""", "hits", "nodes"))
def long_read_coverage(spark, d):
    return cv.long_read_depth(_chains(spark, d))


@query("covered_and_uncovered", "W14", sql(_CHAIN_IN + """, x AS (SELECT node, s, e, 1 AS c, 0 AS u FROM chains WHERE e > s UNION ALL SELECT node, e, nx, 0, 1 FROM chains WHERE nx > e),
    st AS (SELECT node, s AS pos, c, u FROM x UNION ALL SELECT node, e, -c, -u FROM x),
    sg AS (SELECT node, pos, sum(c) AS c, sum(u) AS u FROM st GROUP BY 1, 2 HAVING sum(c) <> 0 OR sum(u) <> 0),
    ds AS (SELECT node, pos AS "start", lead(pos) OVER (PARTITION BY node ORDER BY pos) AS "end", cast(sum(c) OVER (PARTITION BY node ORDER BY pos) as bigint) AS covered,
      cast(sum(u) OVER (PARTITION BY node ORDER BY pos) as bigint) AS uncovered FROM sg)
    SELECT node, "start", "end", covered, uncovered FROM ds WHERE "end" IS NOT NULL AND (covered <> 0 OR uncovered <> 0)""", "hits", "nodes"))
def covered_and_uncovered(spark, d):
    return cv.covered_and_uncovered(_chains(spark, d))


@query("outgoing_link_coverage", "W12 W13", sql("""
    , en AS (SELECT id1 AS node, CASE WHEN gap >= 0 THEN 1 ELSE -1 END AS strand, off1 * 97 AS pos FROM links),
    x AS (SELECT en.node, greatest(CASE WHEN strand > 0 THEN pos ELSE pos - 299 END, 0) AS s, least(CASE WHEN strand > 0 THEN pos + 300 ELSE pos + 1 END, len) AS e FROM en JOIN nodes ON nodes.node = en.node),
    st AS (SELECT node, s AS pos, 1 AS dl FROM x WHERE e > s UNION ALL SELECT node, e, -1 FROM x WHERE e > s),
    sg AS (SELECT node, pos, sum(dl) AS dl FROM st GROUP BY 1, 2 HAVING sum(dl) <> 0),
    ds AS (SELECT node, cast(pos as bigint) AS "start", cast(lead(pos) OVER (PARTITION BY node ORDER BY pos) as bigint) AS "end", cast(sum(dl) OVER (PARTITION BY node ORDER BY pos) as bigint) AS depth FROM sg)
    SELECT node, "start", "end", depth FROM ds WHERE "end" IS NOT NULL AND depth <> 0""", "links", "nodes"))
def outgoing_link_coverage(spark, d):
    e = fx.links(spark, d).select(F.col("id1").alias("node"), F.when(F.col("gap") >= 0, 1).otherwise(-1).alias("strand"), (F.col("off1") * 97).alias("pos"))
    return cv.depth_segments(cv.outgoing_intervals(e, fx.nodes(spark, d).select("node", "len"), 300))


@query("median_depth", "W9 A40", sql(_DEPTH + """, h AS (SELECT node, depth, sum("end" - "start") AS n FROM dep GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY node ORDER BY depth) AS cum, sum(n) OVER (PARTITION BY node) AS a FROM h)
    SELECT node, min(depth) AS median FROM r WHERE cum > a // 2 GROUP BY 1""", "intervals"))
def median_depth(spark, d):
    return cv.median_depth(cv.depth_segments(_iv(spark, d)))


_WIDE = _DEPTH.replace("e - 1704067200 AS e", "e - 1704067200 + 15000 AS e")
_BREAKS = """, inr AS (SELECT node, greatest("start", 100000) AS s, least("end", 2500000) AS e, depth FROM dep),
    inn AS (SELECT * FROM inr WHERE e > s), h AS (SELECT node, depth, sum(e - s) AS n FROM inn GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY node ORDER BY depth) AS cum, sum(n) OVER (PARTITION BY node) AS a FROM h),
    md AS (SELECT node, min(depth) AS median FROM r WHERE cum > a // 2 GROUP BY 1),
    lo AS (SELECT node, s, e FROM inn JOIN md USING (node) WHERE median >= 2 AND depth < median * 0.6),
    lb AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY node ORDER BY s) THEN 0 ELSE 1 END AS nw FROM lo),
    lr AS (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY s) AS run FROM lb),
    brk AS (SELECT node, min(s) AS s, max(e) AS e FROM lr GROUP BY node, run)"""


def _wide_breaks(spark, d):
    iv = _iv(spark, d).withColumn("e", F.col("e") + 15000)
    seg = cv.depth_segments(iv)
    lengths = fx.intervals(spark, d).select("node", F.lit(2600000).cast("bigint").alias("len")).distinct()
    return cv.low_depth_breaks(seg, lengths, 100000, 0.6, 2)


@query("coverage_breakpoints", "W9", sql(_WIDE + _BREAKS + " SELECT node, s, e FROM brk", "intervals"))
def coverage_breakpoints(spark, d):
    return _wide_breaks(spark, d)


@query("island_filter", "W8 P22", sql(_WIDE + _BREAKS + " SELECT node, s, e FROM brk WHERE e - s >= 600", "intervals"))
def island_filter(spark, d):
    return cv.long_runs(_wide_breaks(spark, d), 600)


@query("consecutive_islands", "W8", sql("""
    , p AS (SELECT DISTINCT node, pos // 3600 AS h FROM positions), r AS (SELECT node, h, h - row_number() OVER (PARTITION BY node ORDER BY h) AS g FROM p)
    SELECT node, min(h) AS s, max(h) + 1 AS e FROM r GROUP BY node, g HAVING count(*) >= 3""", "positions"))
def consecutive_islands(spark, d):
    p = fx.positions(spark, d).select("node", F.floor(F.col("pos") / 3600).alias("h"))
    return cv.islands(p, ["node"], "h", 3)


@query("boundary_breaks", "W11", sql(_WIDE + _BREAKS + """,
    pt AS (SELECT node, h AS idx, h * 86400 AS s, (h + 1) * 86400 - 4000 AS e FROM (SELECT DISTINCT node FROM intervals), (SELECT unnest(range(0, 30)) AS h)),
    lg AS (SELECT node, idx, s, e, lag(s) OVER (PARTITION BY node ORDER BY idx) AS ps, lag(e) OVER (PARTITION BY node ORDER BY idx) AS pe FROM pt),
    bd AS (SELECT node, idx, greatest(pe - least(3000, (pe - ps) // 2), 0) AS lo, s + least(3000, (e - s) // 2) AS hi FROM lg WHERE pe IS NOT NULL)
    SELECT DISTINCT bd.node, cast(idx as bigint) AS idx FROM bd JOIN brk ON bd.node = brk.node AND brk.s < hi AND brk.e > lo""", "intervals"))
def boundary_breaks(spark, d):
    nodes = fx.intervals(spark, d).select("node").distinct()
    parts = nodes.select("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))).alias("idx")).select(
        "node", "idx", (F.col("idx") * 86400).alias("start"), ((F.col("idx") + 1) * 86400 - 4000).alias("end"))
    return cv.boundary_breaks(parts, _wide_breaks(spark, d), 3000)


_OCC = ", " + kmers_sql("reads", "rk", "read_id", 12) + f""",
    tb AS (SELECT {canon_sql('f')} AS kmer, least(count(*), 65534) AS occ FROM rk GROUP BY 1),
    cov AS (SELECT read_id, pos, occ FROM rk JOIN tb ON tb.kmer = {canon_sql('rk.f')})"""


def _reads_and_table(spark, d):
    reads = fx.reads(spark, d).withColumnRenamed("read_id", "contig_id")
    return reads, km.dense_table(reads, 12)


@query("window_breaks", "W1 W10", sql(_OCC + """,
    w AS (SELECT read_id, pos, count(*) OVER x AS n, sum(occ) OVER x / 60 AS m, sum(occ * occ) OVER x / 60 AS q FROM cov
      WINDOW x AS (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)),
    s AS (SELECT read_id, pos, CASE WHEN n = 60 THEN m END AS m, CASE WHEN n = 60 THEN sqrt(greatest(q - m * m, 0)) END AS sd FROM w),
    l AS (SELECT *, lead(m, 72) OVER (PARTITION BY read_id ORDER BY pos) AS m2, lead(sd, 72) OVER (PARTITION BY read_id ORDER BY pos) AS sd2 FROM s)
    SELECT read_id AS contig_id, pos FROM l WHERE m2 IS NOT NULL AND NOT (m * 2 >= m2 AND m2 * 2 >= m) AND abs(m - m2) > 2 * greatest(sd, sd2)""", "reads"))
def window_breaks(spark, d):
    reads, table = _reads_and_table(spark, d)
    return cv.breaks_in_sequences(reads, table, 12, 60, 12, 2.0)


@query("trim_points", "W1 L20", sql(_OCC + """,
    rn AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY occ) AS rn, count(*) OVER (PARTITION BY read_id) AS n FROM cov),
    md AS (SELECT read_id, occ AS med FROM rn WHERE rn = n // 2 + 1)
    SELECT read_id AS contig_id, min(pos) AS first, max(pos) + 12 AS last FROM cov JOIN md USING (read_id)
    WHERE occ * 2 >= med AND med * 2 >= occ GROUP BY 1""", "reads"))
def trim_points(spark, d):
    reads, table = _reads_and_table(spark, d)
    return cv.trims_in_sequences(reads, table, 12, 2.0)


_PIECES = """, cut AS (SELECT contig_id, 0 AS pos FROM contigs UNION SELECT contig_id, length(seq) FROM contigs
      UNION SELECT contig_id, 37 + contig_id % 50 FROM contigs UNION SELECT contig_id, 90 FROM contigs),
    pc AS (SELECT contig_id, cast(pos as bigint) AS s, cast(lead(pos) OVER (PARTITION BY contig_id ORDER BY pos) as bigint) AS e FROM cut)"""


def _pieces(spark, d):
    c = fx.contigs(spark, d)
    pts = c.select("contig_id", F.explode(F.array((F.col("contig_id") % 50 + 37).cast("bigint"), F.lit(90).cast("bigint"))).alias("pos"))
    return cv.pieces_between(pts, c, 25)


@query("coverage_trim_pieces", "L19", sql(_PIECES + ' SELECT contig_id, s AS "start", e AS "end" FROM pc WHERE e - s >= 25', "contigs"))
def coverage_trim_pieces(spark, d):
    return _pieces(spark, d)


@query("piece_coverage", "A43 A21", sql(", " + kmers_sql("contigs", "ck", "contig_id, cov", 12) + f""",
    tb AS (SELECT {canon_sql('f')} AS kmer, count(*) AS occ FROM ck GROUP BY 1),
    cc AS (SELECT contig_id, pos, occ FROM ck JOIN tb ON tb.kmer = {canon_sql('ck.f')})""" + _PIECES + """,
    ok AS (SELECT * FROM pc WHERE e - s >= 25)
    SELECT ok.contig_id, s AS "start", e AS "end", cast(floor(coalesce(sum(occ), 0) / (e - s + 13) * 100 / 89 + 0.5) as bigint) AS cov
    FROM ok LEFT JOIN cc ON cc.contig_id = ok.contig_id AND pos >= s AND pos + 12 <= e GROUP BY ok.contig_id, s, e""", "contigs"))
def piece_coverage(spark, d):
    c = fx.contigs(spark, d)
    cover = km.position_coverage(c, km.count_kmers(km.kmer_rows(c, 12)), 12)
    return cv.piece_coverage(_pieces(spark, d), cover, 12, 100)


@query("pileup", "A36", sql(_DEPTH.replace("AS (SELECT node, tag, s", "AS (SELECT node, tag % 3 AS odd, s").replace(
    "SELECT node, s AS pos, 1 AS dl", "SELECT node, s AS pos, CASE WHEN odd = 0 THEN 0 ELSE 1 END AS g, CASE WHEN odd = 0 THEN 1 ELSE 0 END AS o").replace(
    "SELECT node, e, -1 FROM", "SELECT node, e, CASE WHEN odd = 0 THEN 0 ELSE -1 END, CASE WHEN odd = 0 THEN -1 ELSE 0 END FROM").split("sg AS")[0] + """
    sg AS (SELECT node, pos, sum(g) AS g, sum(o) AS o FROM st GROUP BY 1, 2 HAVING sum(g) <> 0 OR sum(o) <> 0),
    ds AS (SELECT node, pos AS "start", lead(pos) OVER (PARTITION BY node ORDER BY pos) AS "end", cast(sum(g) OVER (PARTITION BY node ORDER BY pos) as bigint) AS good,
      cast(sum(o) OVER (PARTITION BY node ORDER BY pos) as bigint) AS odd FROM sg)
    SELECT node, "start", "end", good, odd FROM ds WHERE "end" IS NOT NULL AND (good <> 0 OR odd <> 0)""", "intervals"))
def pileup(spark, d):
    iv = _iv(spark, d).withColumn("identity", F.when(F.col("tag") % 3 == 0, 0.5).otherwise(0.95))
    return cv.pileup(iv, 0.9)


_PILE = f""", iv AS (SELECT node, tag % 3 = 0 AS odd, s - {BASE} AS s, e - {BASE} AS e FROM intervals),
    st AS (SELECT node, s AS pos, CASE WHEN odd THEN 0 ELSE 1 END AS g, CASE WHEN odd THEN 1 ELSE 0 END AS o FROM iv WHERE e > s
      UNION ALL SELECT node, e, CASE WHEN odd THEN 0 ELSE -1 END, CASE WHEN odd THEN -1 ELSE 0 END FROM iv WHERE e > s),
    sg AS (SELECT node, pos, sum(g) AS g, sum(o) AS o FROM st GROUP BY 1, 2 HAVING sum(g) <> 0 OR sum(o) <> 0),
    ds AS (SELECT node, pos AS s, lead(pos) OVER (PARTITION BY node ORDER BY pos) AS e, sum(g) OVER (PARTITION BY node ORDER BY pos) AS g, sum(o) OVER (PARTITION BY node ORDER BY pos) AS o FROM sg)"""


@query("error_base_masks", "P20", sql(_PILE + """, bd AS (SELECT node, s, e FROM ds WHERE e IS NOT NULL AND o > g),
    bm AS (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY s) AS run FROM (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY node ORDER BY s) THEN 0 ELSE 1 END AS nw FROM bd))
    SELECT node, min(s) AS s, max(e) AS e FROM bm GROUP BY node, run""", "intervals"))
def error_base_masks(spark, d):
    iv = _iv(spark, d).withColumn("identity", F.when(F.col("tag") % 3 == 0, 0.5).otherwise(0.95))
    return cv.error_masks(cv.pileup(iv, 0.9), 1.0)


@query("low_end_masks", "P21", sql(_DEPTH + """, ok AS (SELECT node, min("start") AS a, max("end") AS b FROM dep WHERE depth >= 2 GROUP BY 1),
    n AS (SELECT DISTINCT node FROM intervals), x AS (SELECT n.node, coalesce(a, 2600000) AS a, coalesce(b, 0) AS b FROM n LEFT JOIN ok USING (node))
    SELECT node, cast(0 as bigint) AS s, CASE WHEN b <= a THEN 2600000 ELSE a END AS e FROM x WHERE a > 0 UNION ALL SELECT node, b, 2600000 FROM x WHERE b > a AND b < 2600000""", "intervals"))
def low_end_masks(spark, d):
    iv = _iv(spark, d).withColumn("identity", F.lit(1.0))
    lengths = iv.select("node", F.lit(2600000).cast("bigint").alias("len")).distinct()
    return cv.low_end_masks(cv.pileup(iv, 0.9), lengths, 2)


@query("short_islands_hidden", "P22", sql("""
    , p AS (SELECT read_id, regexp_extract_all(seq, 'N+|[^N]+') AS rs FROM reads_n)
    SELECT read_id, array_to_string(list_transform(rs, lambda r: CASE WHEN left(r, 1) <> 'N' AND length(r) < 9 THEN repeat('N', length(r)) ELSE r END), '') AS seq FROM p""", "reads_n"))
def short_islands_hidden(spark, d):
    return fx.reads_n(spark, d).select("read_id", cv.short_islands_hidden("seq", 9).alias("seq"))


@query("gap_enumeration", "W21", sql("""
    , p AS (SELECT read_id, regexp_extract_all(seq, 'N+|[^N]+') AS rs FROM reads_n),
    u AS (SELECT read_id, i, rs[i] AS r FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS i FROM p)),
    a AS (SELECT read_id, r, coalesce(sum(length(r)) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
    SELECT read_id AS node, cast(s as bigint) AS s, cast(s + length(r) as bigint) AS e FROM a WHERE left(r, 1) = 'N'""", "reads_n"))
def gap_enumeration(spark, d):
    return cv.unknown_runs(fx.reads_n(spark, d).withColumnRenamed("read_id", "node"))


@query("masks_applied", "P20 T19", sql("""
    SELECT contig_id AS node, left(seq, 10) || repeat('N', 5) || substring(seq, 16, 20) || 'NNN' || substring(seq, 39) AS seq FROM contigs WHERE length(seq) >= 60""", "contigs"))
def masks_applied(spark, d):
    c = fx.contigs(spark, d).where(F.length("seq") >= 60).select(F.col("contig_id").alias("node"), "seq")
    m = c.select("node", F.explode(F.array(F.struct(F.lit(35).alias("s"), F.lit(38).alias("e")), F.struct(F.lit(10).alias("s"), F.lit(15).alias("e")))).alias("x")).select("node", "x.*")
    return cv.hidden(c, m)


@query("masks_beside_gaps", "W16", sql(_CHAIN_IN + """, x AS (SELECT node, s, e, 1 AS c, 0 AS u FROM chains WHERE e > s UNION ALL SELECT node, e, nx, 0, 1 FROM chains WHERE nx > e),
    st AS (SELECT node, s AS pos, c, u FROM x UNION ALL SELECT node, e, -c, -u FROM x),
    sg AS (SELECT node, pos, sum(c) AS c, sum(u) AS u FROM st GROUP BY 1, 2 HAVING sum(c) <> 0 OR sum(u) <> 0),
    ds AS (SELECT node, pos AS s, lead(pos) OVER (PARTITION BY node ORDER BY pos) AS e, sum(c) OVER (PARTITION BY node ORDER BY pos) AS c, sum(u) OVER (PARTITION BY node ORDER BY pos) AS u FROM sg),
    dd AS (SELECT * FROM ds WHERE e IS NOT NULL AND (c <> 0 OR u <> 0)), bd AS (SELECT node, s, e FROM dd WHERE u > 0 AND u > c * 0.5),
    bm AS (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY s) AS run FROM (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY node ORDER BY s) THEN 0 ELSE 1 END AS nw FROM bd)),
    mm AS (SELECT node, min(s) AS s, max(e) AS e FROM bm GROUP BY node, run)
    SELECT node, s, e FROM mm WHERE EXISTS (SELECT 1 FROM dd g WHERE g.c = 0 AND g.node = mm.node AND mm.s <= g.e AND mm.e >= g.s)""", "hits", "nodes"))
def masks_beside_gaps(spark, d):
    seg = cv.covered_and_uncovered(_chains(spark, d))
    gaps = seg.where("covered = 0").select("node", F.col("start").alias("s"), F.col("end").alias("e"))
    return cv.masks_beside_gaps(seg, gaps, 0, 0.5)


@query("gap_rate_compensated", "W15", sql("""
    , c AS (SELECT contig_id AS node, i AS pos, cov + i % 5 AS depth, CASE WHEN seq[cast(i as int) + 1] = 'A' THEN 1 ELSE 0 END AS gap FROM (SELECT *, unnest(range(0, length(seq))) AS i FROM contigs)),
    w AS (SELECT node, pos, depth, sum(gap) OVER x AS g, count(*) OVER x AS n FROM c WINDOW x AS (PARTITION BY node ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
    SELECT node, cast(pos as int) AS pos, cast(floor(depth * n / nullif(n - g, 0) + 0.5) as bigint) AS depth FROM w""", "contigs"))
def gap_rate_compensated(spark, d):
    c = fx.contigs(spark, d).select(F.col("contig_id").alias("node"), "cov", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    cover = c.select("node", "pos", (F.col("cov") + F.col("pos") % 5).alias("depth"))
    return cv.gap_rate_compensated(cover, c.select("node", "pos", F.when(F.col("base") == "A", 1).otherwise(0).alias("gap")), 21)


@query("longest_nodes", "O12 T15", sql(" SELECT node, len FROM nodes ORDER BY len DESC, node LIMIT 25", "nodes"))
def longest_nodes(spark, d):
    return cv.longest_nodes(fx.nodes(spark, d), 25).select("node", "len")
