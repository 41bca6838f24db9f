"""Queries on the de Bruijn graph of the contig table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bases import canonical
from ..operators import dbg, kmers as km
from . import fixtures as fx
from .catalog import query
from .fixtures import canon_sql, kmers_sql, sql

K = 9
ARM = 13

_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
GRAPH_SQL = ", " + kmers_sql("contigs", "ck", "contig_id", K) + f""",
    km AS (SELECT {canon_sql('f')} AS kmer, count(*) AS occ FROM ck GROUP BY 1),
    od AS (SELECT kmer AS key, occ FROM km UNION SELECT {_RC.format('kmer')}, occ FROM km),
    qi AS (SELECT right(key, {K - 1}) AS q, count(*) AS n, min(key) AS one FROM od GROUP BY 1),
    qo AS (SELECT left(key, {K - 1}) AS q, count(*) AS n, min(key) AS one FROM od GROUP BY 1),
    dg AS (SELECT od.key, occ, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, i.one AS prev, o.one AS next FROM od
      LEFT JOIN qi i ON i.q = left(od.key, {K - 1}) LEFT JOIN qo o ON o.q = right(od.key, {K - 1})),
    st AS (SELECT * FROM dg WHERE n_in <= 1 AND n_out <= 1),
    lk AS (SELECT a.key AS prev, b.key AS key FROM st a JOIN st b ON a.n_out = 1 AND a.next = b.key WHERE a.key <> b.key AND b.key <> {_RC.format('a.key')}),
    wk AS (SELECT key AS head, key AS cur, 0 AS dist, key AS seq, occ AS mass FROM st WHERE key NOT IN (SELECT key FROM lk)
      UNION ALL SELECT head, lk.key, dist + 1, seq || right(lk.key, 1), mass + st.occ FROM wk JOIN lk ON lk.prev = wk.cur JOIN st ON st.key = lk.key),
    mx AS (SELECT head, max(dist) AS d FROM wk GROUP BY 1),
    uo AS (SELECT wk.head, cur AS tail, dist + 1 AS n_kmer, seq, mass / (dist + 1) AS cov FROM wk JOIN mx ON mx.head = wk.head AND mx.d = wk.dist),
    ut AS (SELECT * FROM uo WHERE head <= {_RC.format('tail')}),
    sg AS (SELECT seq, n_kmer, cov, false AS junction FROM uo UNION ALL SELECT key, 1, occ, true FROM dg WHERE n_in > 1 OR n_out > 1),
    se AS (SELECT seq, n_kmer, cov, junction, left(seq, {K - 1}) AS pre, right(seq, {K - 1}) AS suf, least(left(seq, {K}), {_RC.format(f'right(seq, {K})')}) AS name FROM sg)"""


def arms_table(spark, d):
    """Contigs three times over, each with a second arm (middle base changed)
    and a dead end (the first part with its last base changed)."""
    c = fx.contigs(spark, d).where(F.length("seq") >= 100).select("contig_id", "seq")
    n = F.length("seq")
    mid = F.floor(n / 2).cast("int")
    flip = lambda at: F.translate(F.substring(F.col("seq"), at, F.lit(1)), "ACGT", "CGTA")
    arm = F.concat(F.left("seq", mid - 1), flip(mid), F.substring(F.col("seq"), mid + 1, n))
    tip = F.concat(F.substring(F.col("seq"), F.lit(1), F.lit(29)), flip(F.lit(30)), F.substring(F.col("seq"), F.lit(31), F.lit(5)))
    return c.select(F.explode(F.array("seq", "seq", "seq", arm, tip)).alias("seq"))


def arms_graph(spark, d):
    return dbg.compact(dbg.as_segments(km.count_kmers(km.kmer_rows(arms_table(spark, d), ARM)), ARM), ARM)


_FLIP = "translate(substring(seq, {0}, 1), 'ACGT', 'CGTA')"
_ARMS = f""", cc AS (SELECT contig_id, seq, cast(length(seq) // 2 as int) AS mid FROM contigs WHERE length(seq) >= 100),
    av AS (SELECT contig_id, seq FROM cc UNION ALL SELECT contig_id, seq FROM cc UNION ALL SELECT contig_id, seq FROM cc
      UNION ALL SELECT contig_id, left(seq, mid - 1) || {_FLIP.format('mid')} || substring(seq, mid + 1) FROM cc
      UNION ALL SELECT contig_id, left(seq, 29) || {_FLIP.format('30')} || substring(seq, 31, 5) FROM cc)"""
ARMS_SQL = _ARMS + GRAPH_SQL.replace("FROM contigs)", "FROM av)").replace(", 9)", f", {ARM})").replace("+ 1, 9)", f"+ 1, {ARM})").replace(
    "- 9 + 1", f"- {ARM} + 1").replace(", 8)", f", {ARM - 1})")


def graph(spark, d):
    c = fx.contigs(spark, d)
    return dbg.compact(dbg.as_segments(km.count_kmers(km.kmer_rows(c, K)), K), K)


@query("unitigs", "G1 G10 G11 G12 G14", sql(GRAPH_SQL + """ SELECT least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS seq, n_kmer, round(cov, 6) AS cov FROM ut""", "contigs"))
def unitigs(spark, d):
    u = dbg.unitigs(graph(spark, d))
    return u.select(canonical("seq").alias("seq"), "n_kmer", F.round("cov", 6).alias("cov"))


@query("junction_kmers", "G1 G15", sql(GRAPH_SQL + f""" SELECT DISTINCT least(key, {_RC.format('key')}) AS kmer, occ FROM dg WHERE n_in > 1 OR n_out > 1""", "contigs"))
def junction_kmers(spark, d):
    return dbg.junctions(graph(spark, d)).select(canonical("seq").alias("kmer"), F.col("cov").cast("bigint").alias("occ"))


_TIPS = """, dd AS (SELECT a.*, (SELECT count(*) FROM se b WHERE b.suf = a.pre) AS n_in, (SELECT count(*) FROM se b WHERE b.pre = a.suf) AS n_out,
      (SELECT bool_or(b.junction) FROM se b WHERE b.suf = a.pre) AS pj FROM se a WHERE n_kmer <= 13 AND NOT junction),
    tp AS (SELECT DISTINCT name FROM dd WHERE n_out = 0 AND n_in = 1 AND pj
      AND cov <= 0.5 * coalesce((SELECT max(cov) FROM se b WHERE b.pre = dd.pre AND b.seq <> dd.seq), 0))"""


@query("tip_candidates", "G3", sql(ARMS_SQL + _TIPS + " SELECT name FROM tp", "contigs"))
def tip_candidates(spark, d):
    return dbg.tips(arms_graph(spark, d), ARM).select(F.substring("name", 2, ARM).alias("name"))


@query("tips_cut_to_fixpoint", "G4 G10", None)
def tips_cut_to_fixpoint(spark, d):
    return dbg.cut_tips(arms_graph(spark, d), ARM).select(canonical("seq").alias("seq"), "n_kmer", "cov", "junction")


@query("bubble_pairs", "G5 G6", sql(ARMS_SQL + f"""
    , ad AS (SELECT a.*, (SELECT count(*) FROM se b WHERE b.suf = a.pre) AS n_in, (SELECT count(*) FROM se b WHERE b.pre = a.suf) AS n_out,
      (SELECT min(b.seq) FROM se b WHERE b.suf = a.pre AND b.junction) AS prev, (SELECT min(b.seq) FROM se b WHERE b.pre = a.suf AND b.junction) AS next FROM se a WHERE NOT junction),
    ar AS (SELECT * FROM ad WHERE n_in = 1 AND n_out = 1 AND prev IS NOT NULL AND next IS NOT NULL),
    pp AS (SELECT a.name, b.name AS keeper, a.n_kmer, round(a.cov, 6) AS cov, a.seq AS s, b.seq AS t, b.n_kmer AS bn FROM ar a JOIN ar b
      ON a.prev = b.prev AND a.next = b.next AND a.name <> b.name AND (a.cov < b.cov OR (a.cov = b.cov AND (a.n_kmer < b.n_kmer OR (a.n_kmer = b.n_kmer AND a.name < b.name)))))
    SELECT DISTINCT name, keeper, n_kmer, cov FROM pp WHERE CASE WHEN least(n_kmer, bn) + 1 <= {ARM} THEN abs(n_kmer - bn) <= floor((greatest(n_kmer, bn) + {ARM} - 1) * 0.1 + 0.5)
      ELSE levenshtein(substring(s, {ARM}, cast(n_kmer as int) - {ARM} + 1), substring(t, {ARM}, cast(bn as int) - {ARM} + 1)) <= floor((greatest(n_kmer, bn) + {ARM} - 1) * 0.1 + 0.5) END""", "contigs"))
def bubble_pairs(spark, d):
    return dbg.bubble_arms(arms_graph(spark, d), ARM, 0.1).select(
        F.substring("name", 2, ARM).alias("name"), F.substring("keeper", 2, ARM).alias("keeper"), "n_kmer", F.round("cov", 6).alias("cov"))


@query("bubbles_crushed", "G7", None)
def bubbles_crushed(spark, d):
    return dbg.crush_bubbles(arms_graph(spark, d), ARM, 0.1).select(canonical("seq").alias("seq"), "n_kmer", "cov", "junction")


@query("weak_unitigs", "G8 A31", sql(GRAPH_SQL + """
    , dd AS (SELECT a.*, EXISTS (SELECT 1 FROM se b WHERE b.suf = a.pre) AS hi, EXISTS (SELECT 1 FROM se b WHERE b.pre = a.suf) AS ho FROM se a WHERE NOT junction)
    SELECT DISTINCT least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS seq FROM dd WHERE cov < 2 AND n_kmer < 30 AND NOT (hi AND ho)""", "contigs"))
def weak_unitigs(spark, d):
    return dbg.weak_segments(graph(spark, d), 2, 30).select(canonical("seq").alias("seq"))


@query("weak_unitigs_removed", "G9", None)
def weak_unitigs_removed(spark, d):
    return dbg.drop_weak(graph(spark, d), K, 2, 30).select(canonical("seq").alias("seq"), "n_kmer", "cov")


@query("coverage_without_bubbles", "A32", None)
def coverage_without_bubbles(spark, d):
    g = arms_graph(spark, d)
    return dbg.mean_coverage_without_bubbles(g, dbg.bubble_arms(g, ARM, 0.1), ARM)


@query("unitig_seed_counts", "G13", sql(GRAPH_SQL + f""", us AS (SELECT seq, cast(floor(cov + 0.5) as int) AS cov FROM ut UNION ALL
      SELECT DISTINCT least(key, {_RC.format('key')}), cast(occ as int) FROM dg WHERE n_in > 1 OR n_out > 1), """ + kmers_sql("us", "uk", "cov", 13) + f"""
    SELECT {canon_sql('f')} AS kmer, max(cov) AS occ FROM uk GROUP BY 1""", "contigs"))
def unitig_seed_counts(spark, d):
    from ..functions.bases import unpack
    return dbg.export_kmers(graph(spark, d), 13).select(unpack("kmer", 13).alias("kmer"), "occ")


@query("unitig_open_ends", "G16", sql(GRAPH_SQL + f"""
    , dd AS (SELECT seq, NOT EXISTS (SELECT 1 FROM se b WHERE b.suf = left(a.seq, {K - 1})) AS fl, NOT EXISTS (SELECT 1 FROM se b WHERE b.pre = right(a.seq, {K - 1})) AS fr FROM ut a)
    SELECT DISTINCT {canon_sql(f'left(seq, {K})')} AS kmer FROM dd WHERE fl UNION SELECT {canon_sql(f'right(seq, {K})')} FROM dd WHERE fr""", "contigs"))
def unitig_open_ends(spark, d):
    from ..functions.bases import unpack
    return dbg.open_end_kmers(graph(spark, d), K).select(unpack("kmer", K).alias("kmer")).distinct()


@query("unitigs_split_by_reads", "G17", None)
def unitigs_split_by_reads(spark, d):
    return dbg.split_by_support(graph(spark, d), fx.reads(spark, d), K, K).select("seq")
