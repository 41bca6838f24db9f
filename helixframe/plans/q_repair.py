"""Gapped alignment, polishing and bubble merging on planted cases: each query
breaks the texts or lists of a table by a rule, and SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, bubble_merge, polish
from . import fixtures as fx
from .catalog import query
from .fixtures import sql, table

NEXT = "ACGTA"              # fixed values: a changed base becomes the next one of these


def _broken(texts, step: int, subst: int, extra: int, lost: int):
    """Texts with a base changed, one added and one lost in every ``step`` bases."""
    base = "substring(seq, i + 1, 1)"
    other = f"translate({base}, '{NEXT[:4]}', '{NEXT[1:]}')"
    return texts.where(F.length("seq") > 0).withColumn("draft", F.expr(f"""array_join(transform(sequence(0, length(seq) - 1), i -> case i % {step}
        when {subst} then {other} when {extra} then {base} || {other} when {lost} then '' else {base} end), '')"""))


@query("contigs_polished_gapped", "X4 D12 A38", sql("""
    SELECT contig_id AS contig, seq FROM contigs WHERE length(seq) > 0""", "contigs"))
def contigs_polished_gapped(spark, d):
    """Contigs with a wrong base, a base too many and one too few in every 150
    bases come back from pieces of the true text; ends are padded, so that every
    base of the contig has reads over it."""
    c = fx.contigs(spark, d).select(F.col("contig_id").alias("contig"), "seq").where(F.length("seq") > 0)
    pad = "ACGGTCATTGCAAGTCCTGATTCGCAGGATCTTACGCATGGTCAACTGTCGA"
    padded = lambda x: F.concat(F.lit(pad), x, F.lit(pad))
    drafts = _broken(c, 150, 30, 75, 120).select("contig", padded("seq").alias("seq"), padded("draft").alias("draft"))
    at = F.explode(F.expr("sequence(-80, length(seq) - 21, 10)")).alias("at")
    reads = drafts.select("contig", "seq", at).select(
        "contig", F.greatest("at", F.lit(0)).alias("pos"), F.when(F.col("at") % 20 == 0, 1).otherwise(-1).alias("strand"),
        F.expr("substring(seq, greatest(at, 0) + 1, 100 + least(at, 0))").alias("read"))
    turned = F.translate(F.reverse("read"), "ACGT", "TGCA")
    reads = reads.withColumn("read", F.when(F.col("strand") < 0, turned).otherwise(F.col("read")))
    fixed = polish.polish(drafts.select("contig", F.col("draft").alias("seq")), reads, band=12, min_depth=3, margin=6)
    return fixed.select("contig", F.expr(f"substring(seq, {len(pad)} + 1, length(seq) - {2 * len(pad)})").alias("seq"))


@query("texts_joined_by_end_alignment", "F5 L12 L13", sql("""
    , t AS (SELECT contig_id, seq, unnest(range(0, greatest(length(seq) - 150, 0), 60)) AS place FROM contigs)
    SELECT contig_id AS contig, place, substring(seq, place + 1, 150) AS text FROM t""", "contigs"))
def texts_joined_by_end_alignment(spark, d):
    """Stretches of 150 bases as two pieces that overlap by 80; the second has a
    base too many and one too few inside the overlap. Joined at the end of the
    first piece they are the stretch again."""
    c = fx.contigs(spark, d).where(F.length("seq") > 150)
    t = c.select(F.col("contig_id").alias("contig"), F.explode(F.expr("transform(sequence(0, length(seq) - 151, 60), x -> cast(x as bigint))")).alias("place"), "seq")
    cut = lambda a, n: F.expr(f"substring(seq, cast(place as int) + {a} + 1, {n})")
    other = F.translate(cut(43, 1), NEXT[:4], NEXT[1:])
    pairs = t.select("contig", "place", cut(0, 100).alias("a"), F.concat(cut(20, 24), other, cut(44, 28), cut(73, 77)).alias("b"), F.lit(20).alias("diagonal"))
    found = align.end_alignments(pairs, band=6, min_overlap=40, max_miss=0.1)
    return found.join(pairs, ["contig", "place"]).select("contig", "place", F.concat("a", F.expr("substring(b, b_end + 1)")).alias("text"))


_ARMS_SQL = """
    l AS (SELECT l_orderkey AS o, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_orderkey) AS n, cast(floor(l_quantity) as bigint) AS q,
        cast(floor(l_extendedprice) as bigint) % 60 AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
    f AS (SELECT *, r > 1 AND r < n AND r % 3 = 0 AS fork, o * 64 + r AS own, o * 64 + 32 + r AS other FROM l)"""
_MERGED_SQL = f"""WITH {_ARMS_SQL},
    -- a fork with two sides is decided between its neighbours, which are shared
    b AS (SELECT *, fork AND q % 2 = 0 AS two, lag(q) OVER w AS lq, lead(q) OVER w AS rq FROM f WINDOW w AS (PARTITION BY o ORDER BY r)),
    g AS (SELECT o FROM b GROUP BY o HAVING count(*) FILTER (two) > 0 AND count(*) FILTER (two AND NOT (lq < 45 AND rq < 45 AND q <= 48 AND c <= 48)) = 0),
    k AS (SELECT o, r - 1 AS idx, CASE WHEN two AND q < c THEN other ELSE own END AS contig, CASE WHEN two AND q < c THEN c ELSE q END AS cov, 10 + r AS len,
        CASE WHEN NOT fork THEN 0 WHEN two AND q < c THEN 2 ELSE 1 END AS arm FROM b JOIN g USING (o))
    SELECT o * 2 + 1 AS node, CASE WHEN o % 2 = 1 THEN -(o * 2 + 2) ELSE o * 2 + 2 END AS opposite, idx, contig, len, cov, arm,
        sum(len * cov) OVER (PARTITION BY o) / sum(len) OVER (PARTITION BY o) AS node_cov FROM k"""
_CRUSHED_SQL = f"""WITH {_ARMS_SQL},
    b AS (SELECT *, fork AND q % 2 = 0 AS two, lag(q) OVER w AS lq, lead(q) OVER w AS rq FROM f WINDOW w AS (PARTITION BY o ORDER BY r)),
    g AS (SELECT o FROM b GROUP BY o HAVING count(*) FILTER (two) > 0 AND count(*) FILTER (two AND NOT (lq < 45 AND rq < 45 AND q <= 48 AND c <= 48)) = 0)
    SELECT o * 2 + 1 AS node, CASE WHEN q < c THEN own ELSE other END AS contig, CASE WHEN q < c THEN q ELSE c END AS cov, CASE WHEN q < c THEN 1 ELSE 2 END AS arm
    FROM b JOIN g USING (o) WHERE two"""


def _arms(spark, d):
    """The lines of an order are the parts of an arm. The other arm has the same
    parts but every third inner one, which it replaces (even quantity) or skips;
    in odd orders it is turned round."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey")
    lines = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    l = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.row_number().over(lines).alias("r"),
        F.count(F.lit(1)).over(w).alias("n"), F.floor("l_quantity").cast("long").alias("q"), (F.floor("l_extendedprice") % 60).cast("long").alias("c"))
    fork = (F.col("r") > 1) & (F.col("r") < F.col("n")) & (F.col("r") % 3 == 0)
    l = l.withColumn("fork", fork).withColumn("kept", ~F.col("fork") | (F.col("q") % 2 == 0))
    order = Window.partitionBy("o")
    l = l.withColumn("i", F.count_if("kept").over(order.orderBy("r"))).withColumn("m", F.count_if("kept").over(order))
    turned = F.col("o") % 2 == 1
    part = lambda node, idx, contig, cov: F.struct(node.alias("node"), idx.cast("long").alias("idx"), contig.alias("contig"), (F.col("r") + 10).alias("len"), cov.alias("cov"))
    own = part(F.col("o") * 2 + 1, F.col("r") - 1, F.col("o") * 64 + F.col("r"), F.col("q"))
    contig = F.col("o") * 64 + F.when(F.col("fork"), 32).otherwise(0) + F.col("r")
    two = part(F.col("o") * 2 + 2, F.when(turned, F.col("m") - F.col("i")).otherwise(F.col("i") - 1), F.when(turned, -contig).otherwise(contig), F.when(F.col("fork"), F.col("c")).otherwise(F.col("q")))
    parts = l.select(F.explode(F.array_compact(F.array(own, F.when(F.col("kept"), two)))).alias("p")).select("p.*")
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o")).distinct().select(
        (F.col("o") * 2 + 1).alias("node"), F.when(turned, -(F.col("o") * 2 + 2)).otherwise(F.col("o") * 2 + 2).alias("opposite"))
    return pairs, parts


@query("bubble_arms_merged", "G63 G64 G65", _MERGED_SQL)
def bubble_arms_merged(spark, d):
    return bubble_merge.merge_arms(*_arms(spark, d), 45, 48)[0]


@query("bubble_stretches_crushed", "G63 G64 G65", _CRUSHED_SQL)
def bubble_stretches_crushed(spark, d):
    return bubble_merge.merge_arms(*_arms(spark, d), 45, 48)[1].select("node", "contig", "cov", "arm")
