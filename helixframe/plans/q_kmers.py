"""Queries on k-mer extraction, counting and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bases import unpack
from ..operators import kmers as km
from . import fixtures as fx
from .catalog import query
from .fixtures import canon_sql, kmers_sql, sql

K = 25
SHORT = 12

_READ_KMERS = ", " + kmers_sql("reads", "rk", "read_id", K)
_CONTIG_KMERS = ", " + kmers_sql("contigs", "ck", "contig_id, cov, length(seq) AS len", K)


@query("kmer_histogram", "P7 P8 A1 A2 A3 T2 F21", sql(_READ_KMERS + f""",
    t AS (SELECT least(count(*), 65534) AS occ FROM rk GROUP BY {canon_sql('f')})
    SELECT cast(occ as int) AS occ, count(*) AS n FROM t GROUP BY 1""", "reads"))
def kmer_histogram(spark, d):
    return km.occurrence_histogram(km.count_sequences(fx.reads(spark, d), K))


@query("kmer_histogram_unknown_bases", "P7 P8 A3", sql(", " + kmers_sql("reads_n", "rk", "read_id", SHORT) + f""",
    t AS (SELECT least(count(*), 65534) AS occ FROM rk GROUP BY {canon_sql('f')})
    SELECT cast(occ as int) AS occ, count(*) AS n FROM t GROUP BY 1""", "reads_n"))
def kmer_histogram_unknown_bases(spark, d):
    return km.occurrence_histogram(km.count_sequences(fx.reads_n(spark, d), SHORT))


@query("kmer_histogram_wide_key", "P7 P8 A1 S20", sql(", " + kmers_sql("contigs", "rk", "contig_id", 41) + f""",
    t AS (SELECT least(count(*), 65534) AS occ FROM rk GROUP BY {canon_sql('f')})
    SELECT cast(occ as int) AS occ, count(*) AS n FROM t GROUP BY 1""", "contigs"))
def kmer_histogram_wide_key(spark, d):
    return km.occurrence_histogram(km.count_kmers(km.kmer_rows(fx.contigs(spark, d), 41)))


@query("kmer_occurrence_table", "A1 P9 A18 T3 S21", sql(_READ_KMERS + f""" SELECT {canon_sql('f')} AS kmer,
    cast(least(count(*), 65534) as int) AS occ FROM rk GROUP BY 1 HAVING count(*) >= 4""", "reads"))
def kmer_occurrence_table(spark, d):
    t = km.count_sequences(fx.reads(spark, d), K, min_occ=4)
    return t.select(unpack("kmer", K).alias("kmer"), "occ")


@query("contig_kmer_max_coverage", "A4", sql(_CONTIG_KMERS + f""" SELECT {canon_sql('f')} AS kmer,
    cast(least(greatest(max(cov), 2), 65534) as int) AS occ FROM ck GROUP BY 1""", "contigs"))
def contig_kmer_max_coverage(spark, d):
    t = km.max_coverage_kmers(fx.contigs(spark, d), K, min_occ=2)
    return t.select(unpack("kmer", K).alias("kmer"), "occ")


@query("kmer_incremental_count", "A5 J33 U1", sql(_READ_KMERS + _CONTIG_KMERS + f""",
    prev AS (SELECT {canon_sql('f')} AS kmer, max(cov) AS occ FROM ck GROUP BY 1),
    seen AS (SELECT {canon_sql('f')} AS kmer, count(*) AS occ FROM rk GROUP BY 1),
    alltab AS (SELECT * FROM prev UNION ALL SELECT * FROM seen WHERE kmer NOT IN (SELECT kmer FROM prev))
    SELECT cast(least(occ, 65534) as int) AS occ, count(*) AS n FROM alltab GROUP BY 1""", "reads", "contigs"))
def kmer_incremental_count(spark, d):
    prev = km.max_coverage_kmers(fx.contigs(spark, d), K)
    return km.occurrence_histogram(km.add_new_counts(prev, fx.reads(spark, d), K))


@query("kmer_new_per_length", "J33", sql(_READ_KMERS + _CONTIG_KMERS + f"""
    SELECT substring(kmer, 1, 4) AS prefix, count(*) AS n FROM
      (SELECT DISTINCT {canon_sql('f')} AS kmer FROM rk) r
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {canon_sql('f')} AS kmer FROM ck) c WHERE c.kmer = r.kmer)
    GROUP BY 1""", "reads", "contigs"))
def kmer_new_per_length(spark, d):
    known = km.kmer_rows(fx.contigs(spark, d), K).distinct()
    new = km.new_kmers(fx.reads(spark, d), known, K)
    per = new.groupBy(F.shiftright("kmer", 2 * (K - 4)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(unpack("prefix", 4).alias("prefix"), "n")


@query("read_matched_region", "J29 J31", sql(_READ_KMERS + _CONTIG_KMERS + f""" SELECT read_id,
    cast(min(pos) as int) AS start, cast(max(pos) + {K} as int) AS "end" FROM rk
    WHERE {canon_sql('f')} IN (SELECT {canon_sql('f')} FROM ck) GROUP BY 1""", "reads", "contigs"))
def read_matched_region(spark, d):
    rows = km.kmer_rows(fx.reads(spark, d), K, keep=["read_id"], positions=True)
    return km.matched_region(rows, km.kmer_rows(fx.contigs(spark, d), K), K)


@query("read_trimmed_to_region", "J29 P10", sql(_READ_KMERS + _CONTIG_KMERS + f""",
    r AS (SELECT read_id, min(pos) AS s, max(pos) + {K} AS e FROM rk
      WHERE {canon_sql('f')} IN (SELECT {canon_sql('f')} FROM ck) GROUP BY 1)
    SELECT read_id, substring(seq, cast(s as int) + 1, cast(e - s as int)) AS seq FROM r JOIN reads USING (read_id)""", "reads", "contigs"))
def read_trimmed_to_region(spark, d):
    reads = fx.reads(spark, d)
    rows = km.kmer_rows(reads, K, keep=["read_id"], positions=True)
    return km.trim_to_region(reads, km.matched_region(rows, km.kmer_rows(fx.contigs(spark, d), K), K))


@query("read_with_end_kmer", "J30 G16", sql(_READ_KMERS + f""",
    ends AS (SELECT {canon_sql(f"left(seq, {K})")} AS kmer FROM contigs WHERE length(seq) >= {K}
      UNION SELECT {canon_sql(f"right(seq, {K})")} FROM contigs WHERE length(seq) >= {K})
    SELECT DISTINCT read_id FROM rk WHERE {canon_sql('f')} IN (SELECT kmer FROM ends)""", "reads", "contigs"))
def read_with_end_kmer(spark, d):
    from ..operators.dbg import end_kmers
    rows = km.kmer_rows(fx.reads(spark, d), K, keep=["read_id"])
    return km.reads_with(rows, end_kmers(fx.contigs(spark, d), K))


@query("contig_coverage", "A30 J8", sql(_READ_KMERS + _CONTIG_KMERS + f""",
    t AS (SELECT {canon_sql('f')} AS kmer, least(count(*), 65534) AS occ FROM rk GROUP BY 1)
    SELECT contig_id, cast(least(floor(sum(greatest(coalesce(occ, 0), 1)) / count(*) + 0.5), 65534) as bigint) AS cov
    FROM ck LEFT JOIN t ON t.kmer = {canon_sql('ck.f')} GROUP BY 1""", "reads", "contigs"))
def contig_coverage(spark, d):
    contigs = fx.contigs(spark, d)
    t = km.count_among(fx.reads(spark, d), km.kmer_rows(contigs, K), K)
    return km.contig_coverage(contigs, t, K)


@query("contig_half_coverage_ratio", "W19", sql(_READ_KMERS + _CONTIG_KMERS + f""",
    t AS (SELECT {canon_sql('f')} AS kmer, least(count(*), 65534) AS occ FROM rk GROUP BY 1),
    p AS (SELECT contig_id, pos, len // 2 AS half, greatest(coalesce(occ, 0), 1) AS occ
      FROM ck LEFT JOIN t ON t.kmer = {canon_sql('ck.f')}),
    h AS (SELECT contig_id, avg(CASE WHEN pos + {K} <= half THEN occ END) AS a, avg(CASE WHEN pos >= half THEN occ END) AS b
      FROM p GROUP BY 1)
    SELECT contig_id, round(greatest(a, b) / least(a, b), 6) AS ratio FROM h WHERE a IS NOT NULL AND b IS NOT NULL""", "reads", "contigs"))
def contig_half_coverage_ratio(spark, d):
    contigs = fx.contigs(spark, d)
    t = km.count_among(fx.reads(spark, d), km.kmer_rows(contigs, K), K)
    cover = km.position_coverage(contigs, t, K)
    r = km.half_coverage_ratio(cover, contigs.select("contig_id", F.length("seq").alias("len")), K)
    return r.select("contig_id", F.round("ratio", 6).alias("ratio"))


@query("contig_kmer_median", "A41 A40 A42", sql(_READ_KMERS + _CONTIG_KMERS + f""",
    t AS (SELECT {canon_sql('f')} AS kmer, least(count(*), 65534) AS occ FROM rk GROUP BY 1),
    p AS (SELECT contig_id, greatest(coalesce(occ, 0), 1) AS occ,
      row_number() OVER (PARTITION BY contig_id ORDER BY greatest(coalesce(occ, 0), 1)) AS rn,
      count(*) OVER (PARTITION BY contig_id) AS n FROM ck LEFT JOIN t ON t.kmer = {canon_sql('ck.f')})
    SELECT contig_id, cast(occ as int) AS med FROM p WHERE rn = n // 2 + 1""", "reads", "contigs"))
def contig_kmer_median(spark, d):
    from ..operators.stats import median_by
    contigs = fx.contigs(spark, d)
    t = km.count_among(fx.reads(spark, d), km.kmer_rows(contigs, K), K)
    cover = km.position_coverage(contigs, t, K)
    return median_by(cover, ["contig_id"], "occ", "med")
