"""Queries on result sequences, gap closing and the composed commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bases import revcomp
from ..operators import coverage as cv, gapclose as gc, layout as ly, overlap as ov
from ..session import materialize
from . import commands as cmd, fixtures as fx
from .catalog import query
from .fixtures import canon_sql, kmers_sql, sql

# two or three consecutive contigs make a scaffold; odd ones lie turned
_PT = """, cs AS (SELECT contig_id + 1 AS c, contig_id // 3 AS node, contig_id % 3 AS idx, seq, length(seq) AS n, cov,
      CASE contig_id % 3 WHEN 0 THEN 0 WHEN 1 THEN contig_id % 7 * 20 - 30 ELSE 12 END AS gp FROM contigs),
    pl AS (SELECT *, sum(n + gp) OVER (PARTITION BY node ORDER BY idx) AS stop FROM cs),
    pt AS (SELECT node, idx, c * CASE WHEN c % 2 = 0 THEN -1 ELSE 1 END AS contig, cast(stop - n as bigint) AS s, cast(stop as bigint) AS e, seq, n FROM pl),
    pv AS (SELECT *, lag(e) OVER (PARTITION BY node ORDER BY idx) AS e0 FROM pt),
    ct AS (SELECT *, CASE WHEN e0 IS NULL THEN 0 WHEN s - e0 < 0 THEN 10 ELSE s - e0 END AS gap,
      CASE WHEN contig < 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS t FROM pv)"""


def _parts(spark, d):
    from pyspark.sql import Window
    k = F.col("contig_id")
    c = fx.contigs(spark, d).select((k + 1).alias("c"), F.floor(k / 3).alias("node"), (k % 3).alias("idx"), F.length("seq").alias("n"),
                                    F.when(k % 3 == 0, 0).when(k % 3 == 1, k % 7 * 20 - 30).otherwise(12).alias("gp"))
    stop = F.sum(F.col("n") + F.col("gp")).over(Window.partitionBy("node").orderBy("idx")).cast("bigint")
    return materialize(c.select("node", "idx", (F.col("c") * F.when(F.col("c") % 2 == 0, -1).otherwise(1)).alias("contig"),
                                (stop - F.col("n")).alias("start"), stop.alias("end")), "parts")


def _text(spark, d):
    return fx.contigs(spark, d).select((F.col("contig_id") + 1).alias("contig"), "seq", "cov")


def _rendered(spark, d, trims=False):
    o = materialize(ov.exact_overlaps(fx.contigs(spark, d), 5), "overlaps")
    cuts = ly.part_cuts(_parts(spark, d), o, 60)
    return ly.rendered_parts(cuts, _text(spark, d), ly.end_overlaps(o) if trims else None)


@query("result_sequences", "L1 L2 L5 F20 T5 T6", sql(_PT + """ SELECT node, string_agg(repeat('N', cast(gap as int)) || t, '' ORDER BY idx) AS seq FROM ct GROUP BY 1
    HAVING sum(gap + n) >= 200""", "contigs"))
def result_sequences(spark, d):
    # exact overlaps here are shorter than the joining overlap, so gaps stay
    return ly.result_sequences(_rendered(spark, d), 200)


@query("result_components", "T9 L1", sql(_PT + """, st AS (SELECT *, sum(gap + n) OVER (PARTITION BY node ORDER BY idx) AS stop FROM ct)
    SELECT node, cast(stop - n as bigint) AS "start", cast(stop as bigint) AS "end", abs(contig) AS contig, CASE WHEN contig < 0 THEN '-' ELSE '+' END AS strand FROM st""", "contigs"))
def result_components(spark, d):
    return ly.component_table(_rendered(spark, d))


@query("result_sequences_trimmed", "T5 L1", None)
def result_sequences_trimmed(spark, d):
    return ly.result_sequences(_rendered(spark, d, True), 100)


@query("result_names", "L1 T7", sql(_PT + """, r AS (SELECT node, sum(gap + n) AS len FROM ct GROUP BY 1)
    SELECT 'scaffold' || row_number() OVER (ORDER BY node) || '_len' || len || '_cov' || (node % 9 + 1) || '_read100_maxK25' AS name FROM r""", "contigs"))
def result_names(spark, d):
    r = ly.result_sequences(_rendered(spark, d), 1)
    c = r.select("node", (F.col("node") % 9 + 1).alias("cov"))
    return ly.named(r, c, 100, 25).select("name")


@query("contig_pieces", "L3", sql("""
    , cut AS (SELECT contig_id, 0 AS pos FROM contigs UNION SELECT contig_id, length(seq) FROM contigs UNION SELECT contig_id, 40 + contig_id FROM contigs WHERE 40 + contig_id < length(seq)),
    p AS (SELECT contig_id, pos AS s, lead(pos) OVER (PARTITION BY contig_id ORDER BY pos) AS e FROM cut)
    SELECT contig_id AS contig, cast(s as bigint) AS "start", cast(e as bigint) AS "end", substring(seq, s + 1, e - s) AS seq FROM p JOIN contigs USING (contig_id) WHERE e - s >= 50""".replace("substring(seq, s + 1, e - s)", "substring(seq, cast(s as int) + 1, cast(e - s as int))"), "contigs"))
def contig_pieces(spark, d):
    c = fx.contigs(spark, d).select(F.col("contig_id").alias("contig"), "seq")
    pts = c.where(F.col("contig") + 40 < F.length("seq")).select("contig", (F.col("contig") + 40).alias("pos"))
    return ly.pieces_at(c, pts, 50)


# gaps: every contig keeps its ends, a stretch in the middle becomes N
_GP = """, gs AS (SELECT contig_id AS node, left(seq, 60) || repeat('N', 20) || substring(seq, 81) AS seq, substring(seq, 61, 20) AS body FROM contigs WHERE length(seq) >= 120)"""


def _gapped(spark, d):
    c = fx.contigs(spark, d).where(F.length("seq") >= 120)
    return c.select(F.col("contig_id").alias("node"), F.concat(F.left("seq", F.lit(60)), F.repeat(F.lit("N"), 20), F.substring(F.col("seq"), F.lit(81), F.length("seq"))).alias("seq"))


@query("gaps_with_flanks", "W21 O8", sql(_GP + """ SELECT node || ':60' AS gap_id, node, cast(60 as bigint) AS s, cast(80 as bigint) AS e, left(seq, 60) AS head, substring(seq, 81, 150) AS tail FROM gs""", "contigs"))
def gaps_with_flanks(spark, d):
    return gc.gaps(_gapped(spark, d))


# read candidates of a gap: one per word of documents that falls on it
_CAND = """, cd AS (SELECT p_partkey % 97 AS gap_id, p_size % 3 + 5 AS length, translate(left(regexp_replace(lower(p_name || p_type || p_brand || 'abcdefg'), '[^a-z]', '', 'g'), p_size % 3 + 5),
      'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM part)"""


def _candidates(spark, d):
    t = F.regexp_replace(F.lower(F.concat("p_name", "p_type", "p_brand", F.lit("abcdefg"))), "[^a-z]", "")
    n = F.col("p_size") % 3 + 5
    return fx.table(spark, d, "part").select((F.col("p_partkey") % 97).alias("gap_id"), n.cast("bigint").alias("length"),
                                             F.translate(F.left(t, n), fx.LETTERS, fx.AS_BASES).alias("seq"))


@query("small_gap_consensus", "A38 L6", sql(_CAND + """, ln AS (SELECT gap_id, length, count(*) AS m, sum(count(*)) OVER (PARTITION BY gap_id) AS a FROM cd GROUP BY 1, 2),
    tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY m DESC, length) AS rn FROM ln) WHERE rn = 1 AND m >= a * 0.4),
    cl AS (SELECT cd.gap_id, cd.length, m, i, seq[i] AS b FROM cd JOIN tp ON tp.gap_id = cd.gap_id AND tp.length = cd.length, (SELECT unnest(range(1, 8)) AS i) WHERE i <= cd.length),
    vt AS (SELECT gap_id, length, m, i, b, count(*) AS v FROM cl GROUP BY ALL),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id, i ORDER BY v DESC, b) AS rn FROM vt) WHERE rn = 1)
    SELECT gap_id, cast(length as bigint) AS length, string_agg(b, '' ORDER BY i) AS seq FROM bs GROUP BY gap_id, length, m HAVING sum(v) >= length * m * 0.4""", "reads"))
def small_gap_consensus(spark, d):
    return gc.consensus(_candidates(spark, d), 0.4)


@query("consensus_base", "A39", sql(_CAND + """, cl AS (SELECT gap_id AS key, i, seq[i] AS b FROM cd, (SELECT unnest(range(1, 6)) AS i)),
    vt AS (SELECT key, i, b, count(*) AS v FROM cl GROUP BY ALL),
    bs AS (SELECT *, row_number() OVER (PARTITION BY key, i ORDER BY v DESC, b) AS rn, sum(v) OVER (PARTITION BY key, i) AS a FROM vt)
    SELECT key, cast(i - 1 as int) AS col, CASE WHEN v >= a * 0.5 THEN b ELSE 'N' END AS base FROM bs WHERE rn = 1""", "reads"))
def consensus_base(spark, d):
    c = _candidates(spark, d).select(F.col("gap_id").alias("key"), F.posexplode(F.split(F.left("seq", F.lit(5)), "")).alias("col", "base")).where("base <> ''")
    return gc.consensus_bases(c, 0.5)


# mates along the event types, gaps of one hour a day
_RANGE = """, m AS (SELECT event_id AS read_id, node, CASE WHEN tag % 2 = 0 THEN 1 ELSE -1 END AS strand, pos - 1704067200 AS pos, 40 + event_id % 20 AS n FROM positions),
    g AS (SELECT node || ':' || (h * 21600) AS gap_id, node, h * 21600 AS s, h * 21600 + 900 AS e FROM (SELECT DISTINCT node FROM positions), (SELECT unnest(range(0, 120)) AS h)),
    iv AS (SELECT *, CASE WHEN strand > 0 THEN pos + 500 - 90 - n ELSE pos - 500 - 90 END AS lo, CASE WHEN strand > 0 THEN pos + 590 ELSE pos - 410 + n END AS hi FROM m)"""


def _range_input(spark, d):
    p = fx.positions(spark, d)
    m = p.select(F.col("event_id").alias("read_id"), "node", F.when(F.col("tag") % 2 == 0, 1).otherwise(-1).alias("strand"), (F.col("pos") - 1704067200).alias("pos"),
                 F.repeat(F.lit("A"), (F.col("event_id") % 20 + 40).cast("int")).alias("seq"))
    g = p.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(119).cast("bigint"))).alias("h"))
    s = F.col("h") * 21600
    return m, g.select(F.concat_ws(":", "node", s.cast("string")).alias("gap_id"), "node", s.alias("s"), (s + 900).alias("e"))


@query("range_join_gap_reads", "J34 L7", sql(_RANGE + " SELECT DISTINCT gap_id, read_id FROM iv JOIN g ON g.node = iv.node AND lo <= e AND hi >= s", "positions"))
def range_join_gap_reads(spark, d):
    return gc.gather(*_range_input(spark, d), 500, 30)


@query("gap_point_lookup", "J35", sql(_RANGE + " SELECT read_id, g.node, pos, gap_id FROM m JOIN g ON g.node = m.node AND pos >= s AND pos < e", "positions"))
def gap_point_lookup(spark, d):
    m, g = _range_input(spark, d)
    return gc.gap_at(m.select("read_id", "node", "pos"), g).select("read_id", "node", "pos", "gap_id")


_GATH = _RANGE + """, gr AS (SELECT DISTINCT gap_id, read_id, n FROM iv JOIN g ON g.node = iv.node AND lo <= e AND hi >= s)"""


def _gathered(spark, d):
    m, g = _range_input(spark, d)
    return gc.gather(m, g, 500, 30).join(m.select("read_id", "seq"), "read_id"), g


@query("gap_gathered_ratio", "A47", sql(_GATH + """ SELECT gr.gap_id, sum(n) AS bases, round(sum(n) / (901 + 180) / 2.0, 6) AS ratio FROM gr GROUP BY 1""", "positions"))
def gap_gathered_ratio(spark, d):
    r, g = _gathered(spark, d)
    c = g.select("node").distinct().select("node", F.lit(2.0).alias("cov"))
    return gc.gathered_ratio(r, g, c, 30).withColumn("ratio", F.round("ratio", 6))


@query("gap_largest_gathering", "A48", sql(_GATH + ", b AS (SELECT gap_id, sum(n + 1) AS b FROM gr GROUP BY 1) SELECT cast(max(b) as bigint) AS most FROM b", "positions"))
def gap_largest_gathering(spark, d):
    return gc.largest_gathering(_gathered(spark, d)[0])


def _pieces(spark, d, size=60, step=7):
    """Every contig as overlapping reads, three copies of each."""
    c = fx.contigs(spark, d).where(F.length("seq") >= 120)
    at = F.explode(F.sequence(F.lit(0), (F.length("seq") - size).cast("int"), F.lit(step)))
    t = c.select(F.col("contig_id").alias("node"), "seq", at.alias("i"))
    return t.select("node", F.concat_ws(":", "node", F.lit("60")).alias("gap_id"), (F.col("node") * 100000 + F.col("i")).alias("read_id"),
                    F.substring(F.col("seq"), F.col("i") + 1, F.lit(size)).alias("seq"))


@query("gap_spanning_reads", "J36", sql(_GP + """, fl AS (SELECT node, substring(seq, 46, 15) AS l, substring(seq, 81, 15) AS r FROM gs),
    rd AS (SELECT contig_id AS node, contig_id * 100000 + i AS read_id, substring(seq, cast(i as int) + 1, 60) AS seq FROM (SELECT *, unnest(range(0, length(seq) - 59, 7)) AS i FROM contigs WHERE length(seq) >= 120))
    SELECT rd.node || ':60' AS gap_id, read_id, cast(20 as bigint) AS length, body AS seq FROM rd JOIN fl ON fl.node = rd.node JOIN gs ON gs.node = rd.node WHERE contains(rd.seq, l || body || r)""", "contigs"))
def gap_spanning_reads(spark, d):
    from ..operators.mapping import gap_spanning_reads as spanning
    g = gc.gaps(_gapped(spark, d))
    r = _pieces(spark, d).select("read_id", "seq")
    out = spanning(r, g.select("gap_id", F.col("head").alias("left"), F.col("tail").alias("right")), 15)
    return out.select("gap_id", "read_id", F.col("length").cast("bigint").alias("length"), "seq")


@query("small_gaps_closed", "L6 L14 T11", sql(" SELECT contig_id AS node, seq FROM contigs WHERE length(seq) >= 120", "contigs"))
def small_gaps_closed(spark, d):
    s = _gapped(spark, d)
    g = materialize(gc.gaps(s), "gaps")
    from ..operators.mapping import gap_spanning_reads as spanning
    c = spanning(_pieces(spark, d).select("read_id", "seq"), g.select("gap_id", F.col("head").alias("left"), F.col("tail").alias("right")), 15)
    return gc.apply_closures(s, g, gc.close_small(g, c)).select("node", "seq")


@query("gaps_closed_by_graph", "L8 L9 L10 L11 G2 G18", sql(" SELECT contig_id AS node, seq FROM contigs WHERE length(seq) >= 120", "contigs"))
def gaps_closed_by_graph(spark, d):
    s = _gapped(spark, d)
    g = materialize(gc.gaps(s), "gaps")
    reads = _pieces(spark, d, step=1)
    c = gc.close_with_reads(g, reads.select("gap_id", "read_id", "seq"), ks=(25,), min_cov=1)
    return gc.apply_closures(s, g, c).select("node", "seq")


@query("gaps_closed_by_overlaps", "L12 L13 O9 F5", sql(" SELECT contig_id AS node, seq FROM contigs WHERE length(seq) >= 120", "contigs"))
def gaps_closed_by_overlaps(spark, d):
    s = _gapped(spark, d)
    g = materialize(gc.gaps(s), "gaps")
    c = gc.overlap_chains(g, _pieces(spark, d).select("gap_id", "read_id", "seq"), 20)
    return gc.apply_closures(s, g, c).select("node", "seq")


@query("gaps_closed_by_bent_overlaps", "L12 L13 F5", sql(" SELECT contig_id AS node, seq FROM contigs WHERE length(seq) >= 120", "contigs"))
def gaps_closed_by_bent_overlaps(spark, d):
    """Each read lacks a base of its own inside the part an earlier read covers."""
    s = _gapped(spark, d)
    g = materialize(gc.gaps(s), "gaps")
    lacks = F.concat(F.left("seq", F.lit(22)), F.substring(F.col("seq"), F.lit(24), F.length("seq")))
    c = gc.overlap_chains(g, _pieces(spark, d, step=14).select("gap_id", "read_id", lacks.alias("seq")), 20)
    return gc.apply_closures(s, g, c).select("node", "seq")


@query("gap_overlap_candidates", "L12", sql("""
    , rd AS (SELECT contig_id AS g, contig_id * 100000 + i AS read_id, substring(seq, cast(i as int) + 1, 60) AS seq FROM (SELECT *, unnest(range(0, length(seq) - 59, 7)) AS i FROM contigs WHERE length(seq) >= 120)),
    w AS (SELECT g, read_id, i, substring(seq, cast(i as int) + 1, 20) AS f FROM (SELECT *, unnest(range(1, length(seq) - 19)) AS i FROM rd))
    SELECT w.g || ':60' AS gap_id, w.read_id AS a, r.read_id AS b, cast(i as int) AS pos FROM w JOIN rd r ON r.g = w.g AND left(r.seq, 20) = f AND r.read_id <> w.read_id""", "contigs"))
def gap_overlap_candidates(spark, d):
    return gc.overlap_candidates(_pieces(spark, d).select("gap_id", "read_id", "seq"), 20)


@query("gap_extra_contigs", "L16 T12 L17")
def gap_extra_contigs(spark, d):
    g = gc.gaps(_gapped(spark, d))
    return gc.local_contigs(_pieces(spark, d).select("gap_id", "seq"), (25,), 1, 80)


@query("polished_contigs", "D12 P20 P22 P23 T19 X4")
def polished_contigs(spark, d):
    c = fx.contigs(spark, d).select(F.col("contig_id").alias("node"), "seq")
    reads = _pieces(spark, d, step=5).select("node", (F.col("read_id") % 100000).cast("bigint").alias("s"), ((F.col("read_id") % 100000) + 60).cast("bigint").alias("e"),
                                             F.when(F.col("read_id") % 11 == 0, 0.5).otherwise(0.98).alias("identity"))
    return cmd.polish(c, reads, min_identity=0.9, max_odd_ratio=0.3, min_piece=20)


@query("assembled_contigs", "D1 G19 A5 J29")
def assembled_contigs(spark, d):
    """Reads tiled over the contigs, assembled again at two word lengths."""
    reads = _pieces(spark, d, step=2).select("read_id", "seq")
    out = cmd.assemble(reads, ks=(25, 31), min_cov=1)
    return out.contigs.select("seq", "n_kmer", "cov")


@query("merged_contigs", "D8 U1")
def merged_contigs(spark, d):
    c = fx.contigs(spark, d)
    half = c.select((F.col("contig_id") + 100000).alias("contig_id"), F.substring("seq", 1, 100).alias("seq"), "cov")
    return cmd.merge_contigs(c.select("contig_id", "seq", "cov").unionByName(half), 25).select("seq", "cov")


@query("coverage_trimmed_contigs", "D6 L19 W1")
def coverage_trimmed_contigs(spark, d):
    c = fx.contigs(spark, d).select("contig_id", "seq")
    return cmd.cov_trim(c, fx.reads(spark, d), 12, ratio=2.0, min_len=25, read_len=100, window=60)


@query("divided_contigs", "D7 G79")
def divided_contigs(spark, d):
    c = fx.contigs(spark, d).select(F.col("contig_id").alias("node"), "seq")
    cover = _pieces(spark, d, step=9).select("node", (F.col("read_id") % 100000).cast("bigint").alias("s"), ((F.col("read_id") % 100000) + 30).cast("bigint").alias("e"))
    return cmd.divide(c, cover, edge=20, rate=0.6, min_median=2, min_len=25)


@query("binned_contigs", "X2 A36")
def binned_contigs(spark, d):
    c = fx.contigs(spark, d).select(F.col("contig_id").alias("id"), "seq", "cov")
    return cmd.cluster(c, min_len=100, number=2, max_iter=3)


@query("gaps_closed_by_reads", "D5 D11", sql(" SELECT contig_id AS node, seq FROM contigs WHERE length(seq) >= 120", "contigs"))
def gaps_closed_by_reads(spark, d):
    return cmd.close_gaps(_gapped(spark, d), _pieces(spark, d).select("read_id", "seq"), word=15).select("node", "seq")


@query("scaffolded_contigs", "D3 D4 D14")
def scaffolded_contigs(spark, d):
    """Contigs cut in two with the middle left out, joined again by pairs."""
    c = fx.contigs(spark, d).where(F.length("seq") >= 200)
    n = F.length("seq")
    half = c.select(F.explode(F.array(F.struct((F.col("contig_id") * 2).alias("contig_id"), F.left("seq", F.lit(90)).alias("seq")),
                                      F.struct((F.col("contig_id") * 2 + 1).alias("contig_id"), F.substring(F.col("seq"), F.lit(111), n).alias("seq")))).alias("h"),
                    "cov").select("h.*", "cov")
    at = c.select("contig_id", "seq", F.explode(F.sequence(F.lit(0), (n - 160).cast("int"), F.lit(2))).alias("i"))
    mate = F.explode(F.array(F.struct(F.lit(0).alias("mate"), F.substring(F.col("seq"), F.col("i") + 1, F.lit(40)).alias("seq")),
                             F.struct(F.lit(1).alias("mate"), revcomp(F.substring(F.col("seq"), F.col("i") + 121, F.lit(40))).alias("seq"))))
    pairs = at.select((F.col("contig_id") * 100000 + F.col("i")).alias("pair_id"), mate.alias("m")).select("pair_id", "m.*")
    out = cmd.scaffold(materialize(half, "halves"), materialize(pairs, "mates"), seed=21, min_link=3, min_len=1, min_overlap=25)
    return out.results.select("name", "seq")


@query("bubble_result_sets", "T8", sql("""
    SELECT contig_id * 2 AS opposite, 'p' || (contig_id * 2 + 1) AS primary_name, 's' || (contig_id * 2) AS secondary_name FROM contigs""", "contigs"))
def bubble_result_sets(spark, d):
    from ..sources.writers import bubble_sets
    k = F.col("contig_id")
    c = fx.contigs(spark, d)
    a = c.select((k * 2 + 1).alias("node"), F.concat(F.lit("p"), k * 2 + 1).alias("name"), (k * 2).alias("opposite"), F.lit(True).alias("primary"), F.lit(False).alias("secondary"), F.lit(True).alias("hetero"))
    b = c.select((k * 2).alias("node"), F.concat(F.lit("s"), k * 2).alias("name"), (k * 2 + 1).alias("opposite"), F.lit(False).alias("primary"), F.lit(True).alias("secondary"), F.lit(True).alias("hetero"))
    return bubble_sets(a.unionByName(b))["relation"]
