"""Queries on sequence functions, header parsing and table sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases as b
from ..operators import overlap as ov
from ..sources import readers as rd, writers as wr
from . import fixtures as fx
from .catalog import query
from .fixtures import sql

_RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))"


@query("base_codes", "P1 P2", sql(
    " SELECT read_id, translate(seq, 'ACGTN', '01234') AS digits, seq AS letters FROM reads_n", "reads_n"))
def base_codes(spark, d):
    r = fx.reads_n(spark, d).select("read_id", b.encode("seq").alias("digits"))
    return r.withColumn("letters", b.decode("digits"))


@query("reverse_complement", "P3 P4 P5", sql(f" SELECT read_id, {_RC.format('seq')} AS rc FROM reads_n", "reads_n"))
def reverse_complement(spark, d):
    return fx.reads_n(spark, d).select("read_id", b.revcomp("seq").alias("rc"))


@query("known_length", "F3 P24", sql(
    " SELECT read_id, length(replace(seq, 'N', '')) AS known FROM reads_n WHERE length(seq) >= 500", "reads_n"))
def known_length(spark, d):
    return fx.reads_n(spark, d).where(F.length("seq") >= 500).select("read_id", b.known_length("seq").alias("known"))


@query("unknown_ends_trimmed", "P23", sql(
    " SELECT read_id, regexp_replace(regexp_replace(seq, '^N+', ''), 'N+$', '') AS seq FROM reads_n", "reads_n"))
def unknown_ends_trimmed(spark, d):
    return fx.reads_n(spark, d).select("read_id", b.trim_unknown("seq").alias("seq"))


@query("contigs_cut_at_unknown", "S10 S9", sql("""
    , p AS (SELECT read_id, list_filter(regexp_split_to_array(seq, 'N+'), lambda x: length(x) > 0) AS ps FROM reads_n WHERE length(seq) >= 200)
    SELECT read_id, cast(i as int) AS piece, ps[i + 1] AS seq FROM (SELECT *, unnest(range(0, len(ps))) AS i FROM p)""", "reads_n"))
def contigs_cut_at_unknown(spark, d):
    return rd.cut_unknown(fx.reads_n(spark, d), 200, keep=("read_id",))


@query("flag_functions", "F1 F2", sql("""
    SELECT node, len % 16 AS flag, CASE len % 16 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 3 ELSE 4 END AS base,
    bit_count(cast(len % 16 as int)) AS bits FROM nodes""", "nodes"))
def flag_functions(spark, d):
    f = F.col("len") % 16
    return fx.nodes(spark, d).select("node", f.alias("flag"), b.base_of_flag(f).alias("base"),
                                     b.flag_count(f).cast("int").alias("bits"))


@query("ratio_closeness", "P13 P14", sql(
    " SELECT id1, id2, gap, score, (score * 2.0 >= abs(gap) AND abs(gap) * 2.0 >= score) AS close FROM links", "links"))
def ratio_closeness(spark, d):
    g = F.abs(F.col("gap"))
    return fx.links(spark, d).select("id1", "id2", "gap", "score", b.close_ratio("score", g, 2.0).alias("close"))


@query("ungapped_identity", "P15 P16", sql("""
    , m AS (SELECT read_id // 2 AS pair, max(CASE WHEN read_id % 2 = 0 THEN seq END) AS a,
        max(CASE WHEN read_id % 2 = 1 THEN seq END) AS b FROM reads_n GROUP BY 1),
    t AS (SELECT pair, left(a, least(length(a), length(b))) AS a, left(b, least(length(a), length(b))) AS b FROM m
        WHERE a IS NOT NULL AND b IS NOT NULL),
    n AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1, length(a) + 1)) AS i)
        WHERE a[i] <> b[i] AND a[i] <> 'N' AND b[i] <> 'N') AS mism FROM t)
    SELECT pair, cast(mism as int) AS mism, mism <= floor(0.35 * length(a)) AS ok FROM n""", "reads_n"))
def ungapped_identity(spark, d):
    r = fx.reads_n(spark, d).withColumn("s", F.col("seq"))
    even = r.where("read_id % 2 = 0").select(F.expr("read_id div 2").alias("pair"), F.col("s").alias("a"))
    odd = r.where("read_id % 2 = 1").select(F.expr("read_id div 2").alias("pair"), F.col("s").alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    t = even.join(odd, "pair").select("pair", F.left("a", n).alias("a"), F.left("b", n).alias("b"))
    return t.select("pair", b.mismatches("a", "b").alias("mism"), b.identity_ok("a", "b", 0.65).alias("ok"))


@query("self_overlap", "F8 L15", sql("""
    SELECT contig_id, cast(coalesce((SELECT max(n) FROM (SELECT unnest(range(2, length(seq))) AS n)
      WHERE left(seq, n) = right(seq, n)), 0) as int) AS ov FROM contigs""", "contigs"))
def self_overlap(spark, d):
    return fx.contigs(spark, d).select("contig_id", b.self_overlap("seq", 2).alias("ov"))


@query("short_overlap_scan", "J19", sql("""
    SELECT a.contig_id AS id1, b.contig_id AS id2, cast(coalesce((SELECT max(n) FROM (SELECT unnest(range(3, 33)) AS n)
      WHERE right(a.seq, n) = left(b.seq, n) AND n <= length(a.seq) AND n <= length(b.seq)), 0) as int) AS ov
    FROM contigs a JOIN contigs b ON b.contig_id = a.contig_id + 1""", "contigs"))
def short_overlap_scan(spark, d):
    c = fx.contigs(spark, d)
    nxt = c.select((F.col("contig_id") - 1).alias("contig_id"), F.col("contig_id").alias("id2"), F.col("seq").alias("b"))
    return c.join(nxt, "contig_id").select(F.col("contig_id").alias("id1"), "id2",
                                           b.overlap_length("seq", "b", 3, 32).alias("ov"))


@query("common_end_trim", "F7", sql("""
    , p AS (SELECT a.contig_id AS id1, a.seq AS s, b.seq AS t, least(length(a.seq), length(b.seq)) // 2 AS h
      FROM contigs a JOIN contigs b ON b.contig_id = a.contig_id + 1)
    SELECT id1, cast(coalesce((SELECT max(n) FROM (SELECT unnest(range(1, h + 1)) AS n) WHERE left(s, n) = left(t, n)), 0) as int) AS prefix,
    cast(coalesce((SELECT max(n) FROM (SELECT unnest(range(1, h + 1)) AS n) WHERE right(s, n) = right(t, n)), 0) as int) AS suffix FROM p""", "contigs"))
def common_end_trim(spark, d):
    c = fx.contigs(spark, d)
    nxt = c.select((F.col("contig_id") - 1).alias("contig_id"), F.col("seq").alias("b"))
    return c.join(nxt, "contig_id").select(F.col("contig_id").alias("id1"), b.common_trim("seq", "b").alias("t")).select("id1", "t.*")


@query("edit_distance", "F4 F6", sql("""
    SELECT a.contig_id AS id1, cast(levenshtein(a.seq, b.seq) as int) AS dist
    FROM contigs a JOIN contigs b ON b.contig_id = a.contig_id + 1""", "contigs"))
def edit_distance(spark, d):
    c = fx.contigs(spark, d)
    nxt = c.select((F.col("contig_id") - 1).alias("contig_id"), F.col("seq").alias("b"))
    return c.join(nxt, "contig_id").select(F.col("contig_id").alias("id1"),
                                           F.levenshtein("seq", "b").alias("dist"))


@query("approximate_overlap", "J21 F5 F6", sql("""
    , p AS (SELECT a.contig_id AS id1, a.seq AS s, b.seq AS t FROM contigs a JOIN contigs b ON b.contig_id = a.contig_id + 1),
    n AS (SELECT *, unnest(range(20, least(length(s), length(t), 40) + 1)) AS n FROM p),
    e AS (SELECT id1, n, levenshtein(right(s, n), left(t, n)) AS d FROM n)
    SELECT id1, cast(max(n) as int) AS ov FROM e WHERE d <= floor(n * 0.6) GROUP BY 1""", "contigs"))
def approximate_overlap(spark, d):
    c = fx.contigs(spark, d)
    nxt = c.select((F.col("contig_id") - 1).alias("contig_id"), F.col("seq").alias("b"))
    pairs = c.join(nxt, "contig_id").select(F.col("contig_id").alias("id1"), F.col("seq").alias("a"), "b")
    return ov.approximate_overlap(pairs, 20, 40, 0.6).where("ov > 0").select("id1", "ov")


@query("header_attributes", "S9 S11 S18", sql("""
    SELECT name, cast(regexp_extract(name, 'cov([0-9]+)', 1) as bigint) AS cov,
    CASE WHEN cast(regexp_extract(name, '_read([0-9]+)', 1) as bigint) <= 1 THEN 100 ELSE cast(regexp_extract(name, '_read([0-9]+)', 1) as bigint) END AS read,
    cast(regexp_extract(name, 'maxK([0-9]+)', 1) as bigint) AS maxk,
    cast(regexp_extract(name, 'cluster([0-9]+)', 1) as bigint) AS cluster FROM headers""", "headers"))
def header_attributes(spark, d):
    h = fx.headers(spark, d)
    return h.select("name", b.header_number("name", "cov", 1).alias("cov"), b.header_length_like("name", "_read").alias("read"),
                    b.header_length_like("name", "maxK").alias("maxk"), b.header_number("name", "cluster", 0).alias("cluster"))


@query("barcode_dictionary", "S7 S8", sql("""
    , t AS (SELECT regexp_extract('r' || event_id || ' BX:Z:' || node || '0' || (tag % 40), 'BX:Z:([0-9A-Za-z]+)', 1) AS barcode FROM positions)
    SELECT barcode, cast(row_number() OVER (ORDER BY barcode) as bigint) AS barcode_id FROM (SELECT DISTINCT barcode FROM t WHERE barcode <> '')""", "positions"))
def barcode_dictionary(spark, d):
    p = fx.positions(spark, d)
    name = F.concat(F.lit("r"), "event_id", F.lit(" BX:Z:"), "node", F.lit("0"), F.col("tag") % 40)
    return rd.barcode_ids(rd.with_barcode(p.select(name.alias("name"))))


@query("bin_renumber", "T23", sql("""
    , b AS (SELECT name, cast(regexp_extract(name, 'cluster([0-9]+)', 1) as bigint) * 3 AS cluster FROM headers)
    SELECT name, CASE WHEN cluster = 0 THEN 0 ELSE (SELECT count(DISTINCT x.cluster) FROM b x WHERE x.cluster <> 0 AND x.cluster <= b.cluster) END AS bin FROM b""", "headers"))
def bin_renumber(spark, d):
    h = fx.headers(spark, d)
    return wr.renumbered(h.select("name", (b.header_number("name", "cluster", 0) * 3).alias("cluster")))


@query("cluster_rows_from_headers", "T20 T17", sql("""
    SELECT name, cast(regexp_extract(name, '_cluster([0-9]+)', 1) as bigint) AS cluster FROM headers
    WHERE cast(regexp_extract(name, '_cluster([0-9]+)', 1) as bigint) <> 0""", "headers"))
def cluster_rows_from_headers(spark, d):
    return wr.cluster_rows(fx.headers(spark, d))


@query("cluster_attach", "S17 T21 T10 G91", sql("""
    , r AS (SELECT 'doc' || read_id AS name, length(seq) AS len FROM reads),
    c AS (SELECT 'doc' || doc_id AS name, quality * 2 + toxic AS cluster_id FROM labels)
    SELECT name, len, CASE WHEN coalesce(cluster_id, 0) = 0 THEN 'unclassified' ELSE cast(cluster_id as varchar) END AS cluster,
      name || '_cluster' || coalesce(cluster_id, 0) AS routed FROM r LEFT JOIN c USING (name)""", "reads"))
def cluster_attach(spark, d):
    r = fx.reads(spark, d).select(F.concat(F.lit("doc"), "read_id").alias("name"), F.length("seq").alias("len"))
    c = fx.table(spark, d, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("name"),
                                            (F.col("quality") * 2 + F.col("toxic")).alias("cluster_id"))
    t = wr.attach_clusters(r, c)
    return t.select("name", "len", F.when(F.col("cluster_id") == 0, "unclassified").otherwise(F.col("cluster_id").cast("string")).alias("cluster"),
                    F.concat("name", F.lit("_cluster"), "cluster_id").alias("routed"))


@query("fasta_reform", "T22 T1 T7", sql(r"""
    SELECT regexp_replace('seq' || contig_id || '_len' || length(seq) || '_cov' || cov || '_np1212', '_np1212$', '') AS name,
    rtrim(regexp_replace(seq, '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS seq FROM contigs""", "contigs"))
def fasta_reform(spark, d):
    c = fx.contigs(spark, d)
    name = F.concat(F.lit("seq"), "contig_id", F.lit("_len7_cov"), "cov", F.lit("_read100_maxK89_np1212"))
    return wr.reformed(c.select(name.alias("name"), F.lower("seq").alias("seq")))


@query("contig_fasta_rows", "T1 T7 T11", sql(r"""
    SELECT '>seq' || contig_id || '_len' || length(seq) || '_cov' || cov || '_read100_maxK25' || chr(10) ||
    rtrim(regexp_replace(seq, '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS value FROM contigs WHERE length(seq) >= 150""", "contigs"))
def contig_fasta_rows(spark, d):
    c = fx.contigs(spark, d).where(F.length("seq") >= 150)
    name = wr.contig_name("seq", "contig_id", F.length("seq"), "cov", 100, 25)
    return c.select(wr.fasta_text(name, "seq").alias("value"))


@query("occurrence_rows_dense", "T2 T4", sql("""
    , h AS (SELECT cov AS occ, count(*) AS n FROM contigs GROUP BY 1)
    SELECT cast(o as bigint) AS occ, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, (SELECT max(occ) FROM h) + 1)) AS o) LEFT JOIN h ON occ = o""", "contigs"))
def occurrence_rows_dense(spark, d):
    h = fx.contigs(spark, d).groupBy(F.col("cov").alias("occ")).agg(F.count(F.lit(1)).alias("n"))
    return wr.dense_histogram(h)


@query("name_index", "T18", sql("""
    SELECT name, cast(row_number() OVER (ORDER BY name) as bigint) AS "index" FROM (SELECT DISTINCT name FROM headers)""", "headers"))
def name_index(spark, d):
    return wr.name_index(fx.headers(spark, d))


@query("pairs_interleaved", "S5 S6", sql(f"""
    SELECT read_id // 2 AS pair_id, cast(read_id % 2 as int) AS mate, {_RC.format('seq')} AS seq FROM reads""", "reads"))
def pairs_interleaved(spark, d):
    return rd.interleaved_pairs(fx.reads(spark, d), "read_id", outward=True)


@query("read_pair_filter", "S23", sql("""
    , p AS (SELECT read_id // 2 AS pair_id, cast(read_id % 2 as int) AS mate, seq FROM reads),
    g AS (SELECT pair_id FROM p GROUP BY 1 HAVING bool_and(NOT contains(seq, 'N') AND length(seq) BETWEEN 60 AND 4000))
    SELECT pair_id, mate, length(seq) AS len FROM p WHERE pair_id IN (SELECT pair_id FROM g)""", "reads"))
def read_pair_filter(spark, d):
    p = rd.interleaved_pairs(fx.reads(spark, d), "read_id")
    return rd.filter_read_pairs(p, 60, 4000).select("pair_id", "mate", F.length("seq").alias("len"))


@query("read_depth_cap", "S23", sql("""
    , r AS (SELECT read_id, length(seq) AS len, sum(length(seq)) OVER (ORDER BY read_id) AS cum FROM reads)
    SELECT read_id, len FROM r WHERE cum - len < 200000""", "reads"))
def read_depth_cap(spark, d):
    return rd.cap_depth(fx.reads(spark, d), "read_id", 200000).select("read_id", F.length("seq").alias("len"))
