"""Links expected over gapless stretches, and bubble arms placed on results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain, stretches as gs
from ..operators.consensus import gap_consensus
from . import fixtures as fx
from .catalog import query
from .fixtures import canon_sql, kmers_sql, sql, table

# a node is an order and its parts are the lines; an edge joins it to the next order
_LAYOUT = """WITH l AS (SELECT l_orderkey + 1 AS node, l_linenumber * 40 AS s, cast(floor(l_quantity) as bigint) AS q FROM lineitem),
    parts AS (SELECT DISTINCT node, s AS start, s + 15 + q % 40 AS stop FROM l),
    le AS (SELECT node, max(stop) AS len FROM parts GROUP BY 1),
    es AS (SELECT a.node * CASE WHEN a.node % 3 = 0 THEN -1 ELSE 1 END AS id1, b.node * CASE WHEN a.node % 5 = 0 THEN -1 ELSE 1 END AS id2, a.len % 30 - 10 AS gap,
      a.len AS l1, b.len AS l2 FROM le a JOIN le b ON b.node = a.node + 1),
    ins AS (SELECT 60 + q AS insert, count(*) AS n FROM l GROUP BY 1)"""


def _layout(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1).alias("node"), (F.col("l_linenumber") * 40).cast("long").alias("start"), F.floor("l_quantity").cast("long").alias("q"))
    parts = l.select("node", "start", (F.col("start") + 15 + F.col("q") % 40).alias("end")).distinct()
    lengths = parts.groupBy("node").agg(F.max("end").alias("len"))
    nxt = lengths.select((F.col("node") - 1).alias("node"))
    edges = lengths.join(nxt, "node").select(
        F.when(F.col("node") % 3 == 0, -F.col("node")).otherwise(F.col("node")).alias("id1"),
        F.when(F.col("node") % 5 == 0, -(F.col("node") + 1)).otherwise(F.col("node") + 1).alias("id2"), (F.col("len") % 30 - 10).alias("gap"))
    inserts = l.groupBy((F.col("q") + 60).alias("insert")).agg(F.count(F.lit(1)).alias("n"))
    return edges, parts, lengths, inserts


@query("links_expected_over_stretches", "F10 G39", _LAYOUT + """,
    -- every start of a first read and every end of a second read that lies on a stretch
    c AS (SELECT node, unnest(range(start, stop)) AS x FROM parts),
    ok AS (SELECT node, x, count(*) OVER (PARTITION BY node ORDER BY x RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) = 20 AS fits FROM (SELECT DISTINCT node, x FROM c)),
    p AS (SELECT id1, id2, CASE WHEN id1 > 0 THEN x - l1 ELSE -x - 20 END AS p FROM es JOIN ok ON node = abs(id1) WHERE fits),
    f AS (SELECT id1, id2, gap + 20 + CASE WHEN id2 > 0 THEN x ELSE l2 - x - 20 END AS e FROM es JOIN ok ON node = abs(id2) WHERE fits),
    d AS (SELECT p.id1, p.id2, e - p AS insert, count(*) AS m FROM p JOIN f ON p.id1 = f.id1 AND p.id2 = f.id2 WHERE e - p BETWEEN 60 AND 110 GROUP BY ALL),
    w AS (SELECT id1, id2, sum(m * n) AS ways FROM d JOIN ins USING (insert) GROUP BY ALL)
    SELECT es.id1, es.id2, cast(coalesce(ways, 0) as bigint) AS ways FROM es LEFT JOIN w ON w.id1 = es.id1 AND w.id2 = es.id2""")
def links_expected_over_stretches(spark, d):
    edges, parts, lengths, inserts = _layout(spark, d)
    return gs.fragment_ways(edges, gs.gapless_stretches(parts), lengths, inserts, 20).select("id1", "id2", "ways")


_K = 25


@query("bubble_arms_on_results", "J38", sql("""
    , b AS (SELECT contig_id, seq, unnest(range(0, length(seq) - 119, 90)) AS s FROM contigs WHERE length(seq) >= 120),
    """ + kmers_sql("contigs", "kw", "contig_id", _K) + f""",
    kc AS (SELECT {canon_sql('f')} AS w, min(contig_id) AS c, min(pos) AS p FROM kw GROUP BY 1 HAVING count(*) = 1),
    """ + """ok AS (SELECT DISTINCT contig_id, s FROM b JOIN kc ON c = contig_id AND p BETWEEN s AND s + 95)
    SELECT contig_id * 100000 + s AS bubble, contig_id AS target, CASE WHEN s % 4 = 0 THEN -1 ELSE 1 END AS strand, s + 60 AS start, s + 61 AS "end",
      translate(substring(seq, s + 61, 1), 'ACGT', 'CGTA') AS arm, substring(seq, s + 61, 1) AS removed FROM b JOIN ok USING (contig_id, s)""", "contigs"))
def bubble_arms_on_results(spark, d):
    """Stretches of 120 bases of the contigs as the arm that was kept, with another
    middle base as the arm that was not; every second one is turned round."""
    c = fx.contigs(spark, d).where(F.length("seq") >= 120)
    b = c.select("contig_id", "seq", F.explode(F.expr("transform(sequence(0, length(seq) - 120, 90), x -> cast(x as bigint))")).alias("s"))
    cut = lambda a, n: F.expr(f"substring(seq, cast(s as int) + {a} + 1, {n})")
    arm = F.concat(cut(0, 60), F.translate(cut(60, 1), "ACGT", "CGTA"), cut(61, 59))
    turn = lambda x: F.when(F.col("s") % 4 == 0, F.translate(F.reverse(x), "ACGT", "TGCA")).otherwise(x)
    bubbles = b.select((F.col("contig_id") * 100000 + F.col("s")).alias("bubble"), turn(arm).alias("arm"), turn(cut(0, 120)).alias("opposite"))
    return chain.bubbles_on_results(bubbles, fx.contigs(spark, d).select(F.col("contig_id").alias("target"), "seq"), _K)


@query("gaps_filled_by_long_reads", "X3", sql("""
    , t AS (SELECT contig_id, seq, unnest(range(0, length(seq) - 119, 100)) AS s FROM contigs WHERE length(seq) >= 120)
    SELECT contig_id * 100000 + s AS gap, substring(seq, s + 1, 120) AS seq FROM t""", "contigs"))
def gaps_filled_by_long_reads(spark, d):
    """Seven pieces over each stretch of 120 bases, each with a wrong base, a base
    too many and one too few at places of its own."""
    c = fx.contigs(spark, d).where(F.length("seq") >= 120)
    t = c.select("contig_id", F.explode(F.expr("transform(sequence(0, length(seq) - 120, 100), x -> cast(x as bigint))")).alias("s"), "seq").select(
        (F.col("contig_id") * 100000 + F.col("s")).alias("gap"), F.expr("substring(seq, cast(s as int) + 1, 120)").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("r"))
    at = lambda a, n=1: F.expr(f"substring(x, {a} + 12 * r + 1, {n})")
    other = lambda x: F.translate(x, "ACGT", "CGTA")
    piece = F.concat(F.expr("substring(x, 1, 20 + 12 * r)"), other(at(20)), at(21, 3), other(at(24)), at(24, 4), at(29, 120))
    return gap_consensus(t.select("gap", piece.alias("piece")), band=8).select("gap", "seq")
