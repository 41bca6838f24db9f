"""Queries on seed joins, read mapping, overlaps and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bases import revcomp, unpack
from ..operators import dbg, kmers as km, mapping as mp, overlap as ov
from . import fixtures as fx
from .catalog import query
from .fixtures import canon_sql, kmers_sql, sql

W = 11

# canonical words with one place on either strand, and the words of the reads
_INDEX = ", " + kmers_sql("contigs", "ck", "contig_id", W) + f""",
    pl AS (SELECT {canon_sql('f')} AS kmer, contig_id + 1 AS cid, pos AS cpos,
      CASE WHEN f < reverse(translate(f, 'ACGT', 'TGCA')) THEN 1 WHEN f = reverse(translate(f, 'ACGT', 'TGCA')) THEN 0 ELSE -1 END AS cs FROM ck),
    ix AS (SELECT kmer, min(cid) AS cid, min(cpos) AS cpos, min(cs) AS cs FROM pl GROUP BY 1 HAVING count(*) = 1 AND min(cs) <> 0)"""
_WORDS = f""", rl AS (SELECT *, length(seq) AS len FROM reads WHERE length(seq) >= {W}),
    ws AS (SELECT read_id, len, i AS pos, substring(seq, cast(i as int) + 1, {W}) AS f FROM
      (SELECT *, unnest(list_distinct(list_append(range(len - {W}, -1, -{W}), 0))) AS i FROM rl)),
    wd AS (SELECT read_id, len, pos, {canon_sql('f')} AS kmer, CASE WHEN f < reverse(translate(f, 'ACGT', 'TGCA')) THEN 1 ELSE -1 END AS s
      FROM ws WHERE NOT contains(f, 'N') AND f <> reverse(translate(f, 'ACGT', 'TGCA'))),
    hp AS (SELECT read_id, len, pos, CASE WHEN s = cs THEN cid ELSE -cid END AS id,
      CASE WHEN s = cs THEN cpos - pos ELSE cpos + pos + {W} - 1 END AS "offset" FROM wd JOIN ix USING (kmer))"""
_VOTES = """, vt AS (SELECT read_id, id, "offset", count(*) AS votes FROM hp GROUP BY ALL),
    bt AS (SELECT *, max(votes) OVER (PARTITION BY read_id) AS b FROM vt),
    mv AS (SELECT read_id, min(id) AS id, min("offset") AS "offset", min(votes) AS votes FROM bt WHERE votes = b GROUP BY 1 HAVING count(*) = 1)"""
_FIRST = """, f1 AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos, id, "offset") AS rn FROM hp),
    mf AS (SELECT read_id, len, id, "offset" FROM f1 WHERE rn = 1)"""


@query("seed_index_unique", "J1", sql(_INDEX + " SELECT kmer, cid, cast(cpos as int) AS cpos, cs AS cstrand FROM ix", "contigs"))
def seed_index_unique(spark, d):
    t = mp.unique_index(fx.contigs(spark, d), W)
    return t.select(unpack("kmer", W).alias("kmer"), "cid", "cpos", "cstrand")


@query("seed_probe_hits", "J2 J3", sql(_INDEX + _WORDS + """ SELECT read_id, id, count(*) AS hits FROM hp GROUP BY ALL""", "contigs", "reads"))
def seed_probe_hits(spark, d):
    placed = mp._placed(mp.read_words(fx.reads(spark, d), W, ["read_id"]), mp.unique_index(fx.contigs(spark, d), W), W, ["read_id"])
    return placed.groupBy("read_id", "id").agg(F.count(F.lit(1)).alias("hits"))


@query("map_by_votes", "J4 O3", sql(_INDEX + _WORDS + _VOTES + """ SELECT read_id, id, "offset", votes FROM mv""", "contigs", "reads"))
def map_by_votes(spark, d):
    return mp.map_by_votes(fx.reads(spark, d), fx.contigs(spark, d), W)


@query("map_by_first_word", "J6", sql(_INDEX + _WORDS + _FIRST + """ SELECT read_id, id, "offset" FROM mf""", "contigs", "reads"))
def map_by_first_word(spark, d):
    return mp.map_by_first_word(fx.reads(spark, d), fx.contigs(spark, d), W)


def _first_sql(k, left, out):
    """The place of the first uniquely placed word of ``k`` bases, for reads of ``left``."""
    c = lambda f: f"CASE WHEN {f} < reverse(translate({f}, 'ACGT', 'TGCA')) THEN 1 WHEN {f} = reverse(translate({f}, 'ACGT', 'TGCA')) THEN 0 ELSE -1 END"
    return ", " + kmers_sql("contigs", f"ck{k}", "contig_id", k) + f""",
    ix{k} AS (SELECT {canon_sql('f')} AS kmer, min(contig_id) + 1 AS cid, min(pos) AS cpos, min({c('f')}) AS cs FROM ck{k} GROUP BY 1 HAVING count(*) = 1),
    ws{k} AS (SELECT read_id, i AS pos, substring(seq, cast(i as int) + 1, {k}) AS f FROM
      (SELECT *, unnest(list_distinct(list_append(range(length(seq) - {k}, -1, -{k}), 0))) AS i FROM {left} WHERE length(seq) >= {k})),
    hp{k} AS (SELECT read_id, pos, CASE WHEN s = cs THEN cid ELSE -cid END AS id, CASE WHEN s = cs THEN cpos - pos ELSE cpos + pos + {k} - 1 END AS "offset"
      FROM (SELECT read_id, pos, {canon_sql('f')} AS kmer, {c('f')} AS s FROM ws{k}) JOIN ix{k} USING (kmer) WHERE s <> 0 AND cs <> 0),
    {out} AS (SELECT read_id, id, "offset", {k} AS score FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos, id, "offset") AS rn FROM hp{k}) WHERE rn = 1)"""


@query("map_with_seed_fallback", "J7 J14", sql(_first_sql(21, "reads", "m1") + ", r2 AS (SELECT * FROM reads WHERE read_id NOT IN (SELECT read_id FROM m1))"
       + _first_sql(15, "r2", "m2") + ", r3 AS (SELECT * FROM r2 WHERE read_id NOT IN (SELECT read_id FROM m2))" + _first_sql(W, "r3", "m3")
       + " SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3", "contigs", "reads"))
def map_with_seed_fallback(spark, d):
    return mp.map_with_fallback(fx.reads(spark, d), fx.contigs(spark, d), [21, 15, W])


def _tiles(spark, d, size, step):
    """Every whole contig cut into reads of ``size`` bases, the last one at its end;
    every second read is turned round and has one base changed in its middle."""
    c = fx.contigs(spark, d).where(F.length("seq") >= size)
    last = (F.length("seq") - size).cast("int")
    i = F.explode(F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(step)), last)))
    t = c.select("contig_id", "seq", i.alias("i"))
    mid = size // 2
    piece = F.substring(F.col("seq"), F.col("i") + 1, F.lit(size))
    changed = F.concat(F.left(piece, F.lit(mid)), F.translate(F.substring(piece, mid + 1, 1), "ACGT", "CGTA"), F.substring(piece, mid + 2, size))
    return t.select((F.col("contig_id") * 100000 + F.col("i")).alias("read_id"),
                    F.when(F.col("i") % 2 == 1, revcomp(changed)).otherwise(piece).alias("seq"))


def _tiles_sql(size, step):
    mid = size // 2
    return f""", ti AS (SELECT contig_id, i, substring(seq, cast(i as int) + 1, {size}) AS p FROM
      (SELECT *, unnest(list_distinct(list_append(range(0, length(seq) - {size} + 1, {step}), length(seq) - {size}))) AS i FROM contigs WHERE length(seq) >= {size})),
    reads AS (SELECT contig_id * 100000 + i AS read_id, CASE WHEN i % 2 = 1 THEN
      reverse(translate(left(p, {mid}) || translate(substring(p, {mid + 1}, 1), 'ACGT', 'CGTA') || substring(p, {mid + 2}), 'ACGT', 'TGCA')) ELSE p END AS seq FROM ti)"""


@query("map_ungapped", "J9 J16", sql(_tiles_sql(80, 15) + _INDEX + _WORDS + """,
    pl2 AS (SELECT DISTINCT read_id, len, id, "offset" FROM hp),
    fu AS (SELECT p.*, r.seq AS r, c.seq AS t, CASE WHEN id > 0 THEN "offset" ELSE "offset" - p.len + 1 END AS s
      FROM pl2 p JOIN reads r USING (read_id) JOIN contigs c ON c.contig_id + 1 = abs(p.id)),
    rg AS (SELECT *, substring(t, cast(s as int) + 1, len) AS g FROM fu WHERE s >= 0 AND s + len <= length(t)),
    mm AS (SELECT read_id, len, id, "offset", hamming(r, CASE WHEN id > 0 THEN g ELSE reverse(translate(g, 'ACGT', 'TGCA')) END) AS mismatch FROM rg),
    sc AS (SELECT read_id, id, "offset", mismatch, len - 51 * mismatch AS score FROM mm WHERE 10 * mismatch <= len),
    bs AS (SELECT *, max(score) OVER (PARTITION BY read_id) AS b FROM sc)
    SELECT read_id, min(id) AS id, min("offset") AS "offset", min(mismatch) AS mismatch, min(score) AS score
    FROM bs WHERE score = b GROUP BY 1 HAVING count(*) = 1""", "contigs"))
def map_ungapped(spark, d):
    return mp.map_ungapped(_tiles(spark, d, 80, 15), fx.contigs(spark, d), W, 0.9)


_PAIRS = """, mm AS (SELECT read_id // 2 AS pair_id, read_id % 2 AS mate, id, "offset" AS off, len FROM mf),
    pr AS (SELECT a.pair_id, a.id AS f_id, a.off AS f_off, b.id AS r_id, b.off AS r_off, least(a.len, b.len) AS min_len
      FROM mm a JOIN mm b ON a.pair_id = b.pair_id AND a.mate = 0 AND b.mate = 1)"""


def _pairs(spark, d):
    reads = fx.reads(spark, d)
    m = mp.map_by_first_word(reads, fx.contigs(spark, d), W)
    m = m.join(reads.select("read_id", F.length("seq").alias("len")), "read_id")
    return mp.pair_up(m.select(F.expr("read_id div 2").alias("pair_id"), (F.col("read_id") % 2).alias("mate"), "id", "offset", "len"))


@query("pair_links", "J10 J11", sql(_INDEX + _WORDS + _FIRST + _PAIRS + """
    SELECT pair_id, CASE WHEN abs(f_id) < abs(r_id) THEN f_id ELSE r_id END AS id1, CASE WHEN abs(f_id) < abs(r_id) THEN f_off ELSE r_off END AS off1,
    -(CASE WHEN abs(f_id) < abs(r_id) THEN r_id ELSE f_id END) AS id2, CASE WHEN abs(f_id) < abs(r_id) THEN r_off ELSE f_off END AS off2
    FROM pr WHERE abs(f_id) <> abs(r_id)""", "contigs", "reads"))
def pair_links(spark, d):
    return mp.pair_links(_pairs(spark, d))


@query("pair_insert_lengths", "J10 J15", sql(_INDEX + _WORDS + _FIRST + _PAIRS + """
    SELECT pair_id, abs(f_id) AS contig, least(f_off, r_off) AS "left", abs(f_off - r_off) + 1 AS insert FROM pr
    WHERE f_id = -r_id AND ((f_id > 0 AND f_off < r_off) OR (r_id > 0 AND r_off < f_off)) AND abs(f_off - r_off) + 1 >= min_len""", "contigs", "reads"))
def pair_insert_lengths(spark, d):
    return mp.insert_lengths(_pairs(spark, d))


@query("pair_links_by_tag", "J13", sql(_INDEX + _WORDS + _FIRST + _PAIRS + """
    SELECT pair_id % 50 AS tag, abs(f_id) AS node, count(*) AS n FROM pr WHERE f_id <> r_id GROUP BY ALL""", "contigs", "reads"))
def pair_links_by_tag(spark, d):
    p = _pairs(spark, d).where("f_id <> r_id").select((F.col("pair_id") % 50).alias("tag"), F.abs("f_id").alias("node"))
    return p.groupBy("tag", "node").agg(F.count(F.lit(1)).alias("n"))


@query("mapped_library_coverage", "J11", sql(
    " SELECT round((SELECT sum(length(seq)) FROM reads) / (SELECT sum(length(seq)) FROM contigs), 6) AS coverage", "contigs", "reads"))
def mapped_library_coverage(spark, d):
    return mp.mapped_coverage(fx.reads(spark, d), fx.contigs(spark, d)).select(F.round("coverage", 6).alias("coverage"))


@query("map_with_bubbles", "J5 J12 J37 L18")
def map_with_bubbles(spark, d):
    # each contig also has a second arm with one changed base in its middle
    c = fx.contigs(spark, d)
    mid = F.floor(F.length("seq") / 2).cast("int")
    arm = F.concat(F.left("seq", mid), F.translate(F.substring(F.col("seq"), mid + 1, F.lit(1)), "ACGT", "CGTA"),
                   F.substring(F.col("seq"), mid + 2, F.length("seq")))
    return mp.map_with_bubbles(fx.reads(spark, d), c, c.select(F.col("contig_id").alias("bubble_id"), arm.alias("seq")), W)


@query("overlap_exact", "J17", sql(r"""
    , c AS (SELECT contig_id + 1 AS id, seq, length(seq) AS len FROM contigs WHERE length(seq) >= 6),
    o AS (SELECT id, 1 AS s, seq, len FROM c UNION ALL SELECT id, -1, reverse(translate(seq, 'ACGT', 'TGCA')), len FROM c),
    p AS (SELECT a.id * a.s AS x, b.id * b.s AS y, a.seq AS sa, b.seq AS sb, unnest(range(6, least(a.len, b.len) + 1)) AS n
      FROM o a JOIN o b ON abs(b.id) > abs(a.id) AND a.s = 1),
    q AS (SELECT x, y, n FROM p WHERE right(sa, n) = left(sb, n)
      UNION ALL SELECT -x, -y, n FROM p WHERE left(sa, n) = right(sb, n))
    SELECT x AS id1, y AS id2, cast(max(n) as int) AS length FROM q GROUP BY ALL""", "contigs"))
def overlap_exact(spark, d):
    return ov.exact_overlaps(fx.contigs(spark, d), 6)


@query("overlap_lookup", "J18 J20 P17", sql(r"""
    , c AS (SELECT contig_id + 1 AS id, seq FROM contigs WHERE length(seq) >= 6),
    p AS (SELECT a.id AS id1, b.id AS id2, a.seq AS sa, b.seq AS sb FROM c a JOIN c b ON b.id = a.id + 1),
    n AS (SELECT id1, id2, max(n) AS n FROM (SELECT *, unnest(range(6, least(length(sa), length(sb)) + 1)) AS n FROM p) WHERE right(sa, n) = left(sb, n) GROUP BY ALL)
    SELECT -p.id2 AS id1, -p.id1 AS id2, cast(coalesce(n, 0) as int) AS overlap FROM p LEFT JOIN n ON n.id1 = p.id1 AND n.id2 = p.id2""", "contigs"))
def overlap_lookup(spark, d):
    c = fx.contigs(spark, d)
    o = ov.exact_overlaps(c, 6)
    # asked for the wrong way round on purpose
    ids = c.where(F.length("seq") >= 6).select((F.col("contig_id") + 1).alias("i"))
    nxt = ids.select((F.col("i") - 1).alias("i"), F.col("i").alias("j"))
    pairs = ids.join(nxt, "i").select((-F.col("j")).alias("id1"), (-F.col("i")).alias("id2"))
    return ov.lookup_overlap(pairs, o)


_CONT = """, t AS (SELECT read_id AS id, seq FROM reads WHERE length(seq) >= 25 UNION ALL
      SELECT contig_id + 10000000, substring(seq, 20, 120) FROM contigs WHERE length(seq) >= 140
      UNION ALL SELECT contig_id + 20000000, reverse(translate(seq, 'ACGT', 'TGCA')) FROM contigs WHERE length(seq) >= 140),
    w AS (SELECT id, length(seq) AS len, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM t),
    cp AS (SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY least(seq, rc)) AS f FROM w) WHERE id > f)"""


def _containment_input(spark, d):
    c = fx.contigs(spark, d).where(F.length("seq") >= 140)
    return (fx.reads(spark, d).where(F.length("seq") >= 25).select(F.col("read_id").alias("id"), "seq")
            .unionByName(c.select((F.col("contig_id") + 10000000).alias("id"), F.substring("seq", 20, 120).alias("seq")))
            .unionByName(c.select((F.col("contig_id") + 20000000).alias("id"), revcomp("seq").alias("seq"))))


@query("containment_dedup", "U6 U7", sql(_CONT + """,
    u AS (SELECT * FROM w WHERE id NOT IN (SELECT id FROM cp))
    SELECT id FROM cp UNION SELECT i.id FROM u i WHERE EXISTS (SELECT 1 FROM u o WHERE o.len > i.len AND (contains(o.seq, i.seq) OR contains(o.rc, i.seq)))""", "reads", "contigs"))
def containment_dedup(spark, d):
    return ov.contained(_containment_input(spark, d), 25)


def _strand_sql(f):
    return f"CASE WHEN {f} < reverse(translate({f}, 'ACGT', 'TGCA')) THEN 1 ELSE -1 END"


@query("read_on_unitig", "J42", sql(_tiles_sql(90, 15) + ", " + kmers_sql("contigs", "ck", "contig_id", 25) + ", "
       + kmers_sql("reads", "rk", "read_id, length(seq) AS len", 25) + f""",
    ix AS (SELECT {canon_sql('f')} AS kmer, min(contig_id) + 1 AS cid, min(pos) AS cpos, min({_strand_sql('f')}) AS cs FROM ck GROUP BY 1 HAVING count(*) = 1),
    hp AS (SELECT read_id, len, CASE WHEN s = cs THEN cid ELSE -cid END AS id, CASE WHEN s = cs THEN cpos - pos ELSE cpos + pos + 24 END AS "offset"
      FROM (SELECT read_id, len, pos, {canon_sql('f')} AS kmer, {_strand_sql('f')} AS s FROM rk) JOIN ix USING (kmer))
    SELECT read_id, min(id) AS id, min("offset") AS "offset" FROM hp GROUP BY read_id, len
    HAVING count(*) = len - 24 AND min(id) = max(id) AND min("offset") = max("offset")""", "contigs"))
def read_on_unitig(spark, d):
    return mp.read_on_unitig(_tiles(spark, d, 90, 15), fx.contigs(spark, d), 25)


@query("dead_end_bridges", "J32", sql(", " + kmers_sql("reads", "rk", "read_id", 13) + f""",
    en AS (SELECT contig_id AS unitig, {canon_sql('left(seq, 13)')} AS kmer FROM contigs WHERE length(seq) >= 13
      UNION SELECT contig_id, {canon_sql('right(seq, 13)')} FROM contigs WHERE length(seq) >= 13)
    SELECT read_id FROM rk JOIN en ON en.kmer = {canon_sql('f')} GROUP BY 1 HAVING count(DISTINCT unitig) >= 2""", "reads", "contigs"))
def dead_end_bridges(spark, d):
    ends = dbg.end_kmers(fx.contigs(spark, d), 13, keep=["contig_id"]).withColumnRenamed("contig_id", "unitig")
    return mp.dead_end_bridges(fx.reads(spark, d), ends, 13)


@query("wrong_pairs_removed", "J43 S19", sql("""
    , bad AS (SELECT DISTINCT id1, id2 FROM links WHERE score % 7 = 0)
    SELECT pair, id1, id2, gap FROM links l WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.id1 = l.id1 AND bad.id2 = l.id2)""", "links"))
def wrong_pairs_removed(spark, d):
    from ..session import materialize
    l = materialize(fx.links(spark, d), "links")
    bad = l.where("score % 7 = 0").select("id1", "id2").distinct()
    return l.join(bad, ["id1", "id2"], "left_anti").select("pair", "id1", "id2", "gap")
