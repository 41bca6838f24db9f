"""Queries on scaffold-graph edges, joins, crosses, bubbles and division."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import division as dv, edges as ed, grow as gr, links as lk, scaffold as sc, stats as st
from ..session import materialize
from . import fixtures as fx
from .catalog import query
from .fixtures import sql
from .q_links import EDGE_SQL, merged

# signed edges between part nodes: merged links with directions
_SE = EDGE_SQL + """, es AS (SELECT (id1 + 1) * CASE WHEN n_link % 2 = 0 THEN 1 ELSE -1 END AS id1, (id2 + 1) * CASE WHEN score % 3 = 0 THEN -1 ELSE 1 END AS id2,
      gap, n_link, score, score % 5 = 0 AS is_overlap FROM edges),
    nd AS (SELECT node + 1 AS node, len, cov, cluster, node % 3 = 0 AS bubble, node % 4 <> 0 AS hetero FROM nodes),
    he AS (SELECT abs(id1) AS src, sign(id1) AS dir, abs(id2) * sign(id1) * sign(id2) AS dst, * FROM es UNION ALL
      SELECT abs(id2), -sign(id2), abs(id1) * sign(id1) * sign(id2), * FROM es)"""
_T = 20


def signed(spark, d):
    e = merged(spark, d)
    return materialize(e.select(
        ((F.col("id1") + 1) * F.when(F.col("n_link") % 2 == 0, 1).otherwise(-1)).alias("id1"),
        ((F.col("id2") + 1) * F.when(F.col("score") % 3 == 0, -1).otherwise(1)).alias("id2"),
        "gap", "n_link", "score", (F.col("score") % 5 == 0).alias("is_overlap")), "signed")


def nodes(spark, d):
    n = F.col("node")
    return fx.nodes(spark, d).select((n + 1).alias("node"), "len", "cov", "cluster", (n % 3 == 0).alias("bubble"), (n % 4 != 0).alias("hetero"))


def _ids(df):
    return df.select("id1", "id2").distinct()


def se(body: str) -> str:
    return sql(_SE + body, "links", "nodes")


@query("half_edges_ordered", "G32 O2 O4 T13 T14", se(" SELECT src, cast(dir as int) AS dir, cast(dst as bigint) AS dst, gap, n_link FROM he"))
def half_edges_ordered(spark, d):
    return ed.edge_order(ed.half_edges(signed(spark, d))).select("src", "dir", "dst", "gap", "n_link")


@query("edges_thin", "G40", se(" SELECT id1, id2 FROM es WHERE n_link < 6"))
def edges_thin(spark, d):
    return _ids(ed.thin(signed(spark, d), 6))


@query("edges_thin_kept_overlap", "G41 U4", se(" SELECT id1, id2, n_link FROM es WHERE NOT (n_link < 6 AND NOT is_overlap)"))
def edges_thin_kept_overlap(spark, d):
    e = signed(spark, d)
    return ed.without(e, ed.thin(e, 6, keep_overlap=True)).select("id1", "id2", "n_link")


@query("edges_long", "G48", se(" SELECT id1, id2 FROM es WHERE gap > 5"))
def edges_long(spark, d):
    return _ids(ed.longer_than(signed(spark, d), 5))


@query("edges_short_nodes", "P17", se(" SELECT id1, id2 FROM es JOIN nd a ON a.node = abs(id1) JOIN nd b ON b.node = abs(id2) WHERE a.len < 2000 OR b.len < 2000"))
def edges_short_nodes(spark, d):
    return _ids(ed.from_short_nodes(signed(spark, d), nodes(spark, d), 2000))


@query("edges_short_nodes_bubbles_kept", "P18", se(
    " SELECT id1, id2 FROM es JOIN nd a ON a.node = abs(id1) JOIN nd b ON b.node = abs(id2) WHERE (a.len < 2000 AND NOT a.bubble) OR (b.len < 2000 AND NOT b.bubble)"))
def edges_short_nodes_bubbles_kept(spark, d):
    return _ids(ed.from_short_nodes(signed(spark, d), nodes(spark, d), 2000, keep_bubbles=True))


@query("edges_abnormal_nodes", "P19", se(" SELECT id1, id2 FROM es JOIN nd a ON a.node = abs(id1) JOIN nd b ON b.node = abs(id2) WHERE (a.len < 3000 AND a.cov NOT BETWEEN 901 AND 902) OR (b.len < 3000 AND b.cov NOT BETWEEN 901 AND 902)"))
def edges_abnormal_nodes(spark, d):
    return _ids(ed.from_abnormal_nodes(signed(spark, d), nodes(spark, d), 3000, 901, 902))


@query("edge_cluster_filter", "G51", se(" SELECT id1, id2 FROM es JOIN nd a ON a.node = abs(id1) JOIN nd b ON b.node = abs(id2) WHERE a.cluster <> b.cluster AND a.cluster * b.cluster <> 0"))
def edge_cluster_filter(spark, d):
    return _ids(ed.across_clusters(signed(spark, d), nodes(spark, d)))


_COLL = f""", hl AS (SELECT he.*, nd.len AS dlen, row_number() OVER () AS rid FROM he JOIN nd ON nd.node = abs(dst)),
    cl AS (SELECT x.rid, x.src, x.id1, x.id2, x.n_link AS n1, y.n_link AS n2 FROM hl x JOIN hl y ON x.src = y.src AND x.dir = y.dir AND x.rid <> y.rid
      WHERE x.gap + x.dlen > y.gap AND y.gap + y.dlen > x.gap AND abs(x.gap + x.dlen - y.gap) > {_T} AND abs(y.gap + y.dlen - x.gap) > {_T})"""


@query("edge_link_rate_filter", "G44 J28", se(_COLL + " SELECT DISTINCT id1, id2 FROM cl WHERE n1 < 0.25 * n2"))
def edge_link_rate_filter(spark, d):
    return ed.weak_by_rate(signed(spark, d), nodes(spark, d), _T)


@query("repeat_nodes", "G35", se(_COLL + " SELECT DISTINCT src AS node FROM cl"))
def repeat_nodes(spark, d):
    return ed.repeats(signed(spark, d), nodes(spark, d), _T)


@query("repeat_nodes_by_coverage", "G36", se(_COLL + " SELECT src AS node FROM cl UNION SELECT node FROM nd WHERE len // 100 % 4 = 1 AND cov > 1.5 * 700"))
def repeat_nodes_by_coverage(spark, d):
    n = nodes(spark, d).withColumn("n_parts", (F.col("len") / 100).cast("int") % 4)
    return ed.repeats(signed(spark, d), n, _T, "n_parts", 700.0)


@query("edge_tag_rate_filter", "G45 J27", sql(_SE + f""", tc AS (SELECT tag, {fx.folded_sql("node")} + 1 AS node, count(*) AS n FROM tag_rows GROUP BY 1, 2),
    ct AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS t FROM tc a JOIN tc b ON a.tag = b.tag AND a.node < b.node GROUP BY 1, 2),
    tp AS (SELECT id1, id2, coalesce(t, 0) AS t FROM es LEFT JOIN ct ON a = least(abs(id1), abs(id2)) AND b = greatest(abs(id1), abs(id2))),
    hl AS (SELECT he.*, t, nd.len AS dlen, row_number() OVER () AS rid FROM he JOIN tp USING (id1, id2) JOIN nd ON nd.node = abs(dst))
    SELECT DISTINCT x.id1, x.id2 FROM hl x JOIN hl y ON x.src = y.src AND x.dir = y.dir AND x.rid <> y.rid
      WHERE x.gap + x.dlen > y.gap AND y.gap + y.dlen > x.gap AND abs(x.gap + x.dlen - y.gap) > {_T} AND abs(y.gap + y.dlen - x.gap) > {_T} AND x.t < 0.25 * y.t""", "links", "nodes", "tag_rows"))
def edge_tag_rate_filter(spark, d):
    t = lk.tag_counts(fx.tag_rows(spark, d).withColumn("node", fx.folded("node") + 1))
    return ed.weak_by_tags(signed(spark, d), nodes(spark, d), t, _T)


@query("edge_expected_rate_filter", "G43 G46", se(f""", hl AS (SELECT he.*, nd.len AS dlen, n_link / greatest(score % 7 + 2, 1.0) AS rate, row_number() OVER () AS rid FROM he JOIN nd ON nd.node = abs(dst))
    SELECT DISTINCT x.id1, x.id2 FROM hl x JOIN hl y ON x.src = y.src AND x.dir = y.dir AND x.rid <> y.rid
      WHERE x.gap + x.dlen > y.gap AND y.gap + y.dlen > x.gap AND abs(x.gap + x.dlen - y.gap) > {_T} AND abs(y.gap + y.dlen - x.gap) > {_T}
      AND x.rate <= 4 AND y.rate <= 4 AND x.n_link < y.n_link AND x.rate <= y.rate * 0.5"""))
def edge_expected_rate_filter(spark, d):
    e = signed(spark, d).withColumn("expected", (F.col("score") % 7 + 2).cast("double"))
    return ed.weak_by_expectation(e, nodes(spark, d), _T)


@query("edges_thin_for_library", "G39 F10")
def edges_thin_for_library(spark, d):
    return _ids(ed.below_expectation(signed(spark, d), nodes(spark, d), 2000.0, 900.0, 350, 300, 100))


_TAILS = """, lens AS (SELECT p_size * 3 AS l FROM part), lh AS (SELECT l, count(*) AS n FROM lens GROUP BY 1),
    tl AS (SELECT l, sum(n) OVER (ORDER BY l DESC) AS num, sum(l * n) OVER (ORDER BY l DESC) AS total FROM lh),
    xe AS (SELECT es.*, coalesce((SELECT min_by(10.0 * (total - greatest(gap, 0) * num), l) FROM tl WHERE l >= greatest(gap, 0)) / (SELECT max(total) FROM tl), 0.0) AS expected FROM es)"""


@query("edge_expected_long_reads", "F11 W6", se(_TAILS + " SELECT id1, id2, round(expected, 6) AS expected FROM xe"))
def edge_expected_long_reads(spark, d):
    lens = fx.table(spark, d, "part").select((F.col("p_size") * 3).alias("len"))
    return ed.expected_long_links(signed(spark, d), st.suffix_totals(lens), 10.0).select("id1", "id2", F.round("expected", 6).alias("expected"))


@query("edges_thin_for_long_reads", "G42", se(_TAILS + " SELECT id1, id2 FROM xe WHERE expected <> 0 AND n_link / expected < 0.6"))
def edges_thin_for_long_reads(spark, d):
    lens = fx.table(spark, d, "part").select((F.col("p_size") * 3).alias("len"))
    return _ids(ed.thin_for_long_reads(signed(spark, d), st.suffix_totals(lens), 10.0, 0.6))


@query("edges_same_target", "G47", se("""
    , e2 AS (SELECT id1, id2, n_link FROM es UNION ALL SELECT id1, -id2, 1 + n_link * 2 % 7 FROM es WHERE score % 4 = 0)
    SELECT DISTINCT x.id1, x.id2 FROM e2 x JOIN e2 y ON abs(x.id1) = abs(y.id1) AND abs(x.id2) = abs(y.id2) AND (x.id1 <> y.id1 OR x.id2 <> y.id2)
    WHERE (x.n_link * 2 >= y.n_link AND y.n_link * 2 >= x.n_link) OR x.n_link < y.n_link"""))
def edges_same_target(spark, d):
    e = signed(spark, d).select("id1", "id2", "n_link", "score")
    more = e.where("score % 4 = 0").select("id1", (-F.col("id2")).alias("id2"), (F.lit(1) + F.col("n_link") * 2 % 7).alias("n_link"), "score")
    return _ids(ed.same_target(e.unionByName(more)))


@query("edges_from_parent", "G52", se("""
    , lp AS (SELECT l.id1 + 1 AS a, l.id2 + 1 AS b, off1 AS part, count(*) AS n FROM links l GROUP BY 1, 2, 3),
    o AS (SELECT id1, id2, n_link, sum(n) AS o FROM es JOIN lp ON a = abs(id1) AND b = abs(id2) WHERE part % 2 = 0 GROUP BY 1, 2, 3)
    SELECT id1, id2 FROM o WHERE n_link - o < 3"""))
def edges_from_parent(spark, d):
    e = signed(spark, d)
    lp = fx.links(spark, d).groupBy((F.col("id1") + 1).alias("a"), (F.col("id2") + 1).alias("b"), F.col("off1").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    by = e.select("id1", "id2", F.abs("id1").alias("a"), F.abs("id2").alias("b")).join(lp, ["a", "b"]).withColumn("same_parent", F.col("part") % 2 == 0)
    return _ids(ed.from_parent(e, by, 3))


@query("edges_homozygous", "G53", se(" SELECT id1, id2 FROM es JOIN nd a ON a.node = abs(id1) JOIN nd b ON b.node = abs(id2) WHERE NOT is_overlap AND NOT (a.hetero AND b.hetero)"))
def edges_homozygous(spark, d):
    return _ids(ed.homozygous(signed(spark, d), nodes(spark, d)))


@query("edges_hetero_conflicts", "G54", se(_COLL.replace("JOIN nd ON nd.node = abs(dst))", "JOIN nd ON nd.node = abs(dst) WHERE nd.hetero)") + " SELECT DISTINCT id1, id2 FROM cl"))
def edges_hetero_conflicts(spark, d):
    return ed.heterozygous_conflicts(signed(spark, d), nodes(spark, d), _T)


def _arms(spark, d):
    """Nodes 2i and 2i + 1 are the two arms of a bubble."""
    n = nodes(spark, d).select("node")
    return n.select("node", F.when(F.col("node") % 2 == 0, F.col("node") + 1).otherwise(F.col("node") - 1).alias("opposite")).where("opposite > 0")


_ARM = ", am AS (SELECT node, CASE WHEN node % 2 = 0 THEN node + 1 ELSE node - 1 END AS opposite FROM nd WHERE node > 1)"


@query("edges_bubble_conflicts", "G56", se(_ARM + """ SELECT DISTINCT x.id1, x.id2 FROM he x JOIN am ON am.node = abs(x.dst) JOIN he y ON y.src = x.src AND y.dir = x.dir AND abs(y.dst) = am.opposite
    WHERE x.n_link < 0.25 * y.n_link"""))
def edges_bubble_conflicts(spark, d):
    return ed.bubble_conflicts(signed(spark, d), _arms(spark, d))


@query("edges_between_bubbles", "G55", se(_ARM + " SELECT id1, id2 FROM es JOIN am a ON a.node = abs(id1) JOIN am b ON b.node = abs(id2)"))
def edges_between_bubbles(spark, d):
    return ed.between_bubbles(signed(spark, d), _arms(spark, d))


@query("secondary_bubble_arms", "G57", se(_ARM + """ SELECT DISTINCT am.node FROM am JOIN nd a ON a.node = am.node JOIN nd b ON b.node = am.opposite
    WHERE a.cov < b.cov OR (a.cov = b.cov AND (a.len < b.len OR (a.len = b.len AND a.node > b.node)))"""))
def secondary_bubble_arms(spark, d):
    return ed.secondary_arms(_arms(spark, d), nodes(spark, d))


@query("weak_branch_nodes", "G49", se("""
    , sd AS (SELECT src, count(DISTINCT dir) AS s FROM he GROUP BY 1)
    SELECT node FROM nd LEFT JOIN sd ON src = node WHERE len < 2500 AND cov < 1000 AND coalesce(s, 0) < 2"""))
def weak_branch_nodes(spark, d):
    return ed.weak_branches(signed(spark, d), nodes(spark, d), 2500, 1000)


@query("edges_cut_to_fixpoint", "G38 G45", None)
def edges_cut_to_fixpoint(spark, d):
    n = nodes(spark, d)
    return ed.until_stable(signed(spark, d), lambda e: ed.weak_by_rate(e, n, _T))


_PARTS = """, pb AS (SELECT id1 + 1 AS a, id2 + 1 AS b, 1 AS side, off1 AS part, count(*) AS n FROM links GROUP BY ALL
      UNION ALL SELECT id1 + 1, id2 + 1, 2, off2, count(*) FROM links GROUP BY ALL),
    pt AS (SELECT h.src, h.dir, h.dst, h.id1, h.id2, pb.part, pb.n FROM he h JOIN pb ON a = abs(id1) AND b = abs(id2) AND side = CASE WHEN src = abs(id1) THEN 1 ELSE 2 END),
    hl AS (SELECT he.*, nd.len FROM he JOIN nd ON nd.node = abs(dst)),
    pr AS (SELECT a.src, a.dir, a.dst AS x, b.dst AS y FROM hl a JOIN hl b ON a.src = b.src AND a.dir = b.dir AND a.dst < b.dst
      WHERE a.gap + a.len - b.gap > 20 AND b.gap + b.len - a.gap > 20)"""


def _parts(spark, d, e):
    b = lk.breakdown(fx.links(spark, d)).withColumn("a", F.col("id1") + 1).withColumn("b", F.col("id2") + 1).select("a", "b", "side", "part", "n")
    return e.select("id1", "id2", F.abs("id1").alias("a"), F.abs("id2").alias("b")).join(b, ["a", "b"]).drop("a", "b")


@query("edges_repeat_links", "G37", se(_PARTS + """
    , lp AS (SELECT src, max({'dir': dir, 'x': x, 'y': y}) AS p FROM pr GROUP BY 1),
    ls AS (SELECT lp.src, sum(least(f.n, g.n)) AS loss FROM lp JOIN pt f ON f.src = lp.src AND f.dir = p.dir AND f.dst = p.x
      JOIN pt g ON g.src = lp.src AND g.dir = p.dir AND g.dst = p.y AND g.part = f.part GROUP BY 1)
    SELECT DISTINCT id1, id2 FROM he LEFT JOIN ls USING (src) WHERE n_link - coalesce(loss, 0) < 3"""))
def edges_repeat_links(spark, d):
    e = signed(spark, d)
    return ed.repeat_edge_links(e, _parts(spark, d, e), nodes(spark, d), _T, 3)


@query("edges_repeat_parts", "G38", se(_PARTS + """
    , cl AS (SELECT DISTINCT f.src, f.part FROM pr JOIN pt f ON f.src = pr.src AND f.dir = pr.dir AND f.dst = x
      JOIN pt g ON g.src = pr.src AND g.dir = pr.dir AND g.dst = y AND g.part = f.part WHERE f.n >= 3 AND g.n >= 3),
    ls AS (SELECT src, dir, dst, sum(n) AS loss FROM pt JOIN cl USING (src, part) GROUP BY ALL)
    SELECT DISTINCT id1, id2 FROM he LEFT JOIN ls USING (src, dir, dst) WHERE n_link - coalesce(loss, 0) < 3"""))
def edges_repeat_parts(spark, d):
    e = signed(spark, d)
    return ed.repeat_parts(e, _parts(spark, d, e), nodes(spark, d), _T, 3)[1]


# a sparse overlap graph: each part leads on to one or two later parts
_CH = """, c0 AS (SELECT p_partkey + 1 AS u, p_size AS z, cast(floor(p_retailprice) as bigint) AS r FROM part),
    c1 AS (SELECT u AS id1, (u + 1 + z % 3) * CASE WHEN z % 11 = 0 THEN -1 ELSE 1 END AS id2, z - 20 AS gap, 1 + z % 9 AS n_link FROM c0
      UNION SELECT u, u + 2 + z % 5, z - 20, 1 + z % 9 FROM c0 WHERE r % 4 = 0),
    dr AS (SELECT DISTINCT u, v FROM (SELECT id1 AS u, id2 AS v FROM c1 UNION ALL SELECT -id2, -id1 FROM c1))"""


def chain_edges(spark, d):
    p = fx.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("u"), F.col("p_size").alias("z"), F.floor("p_retailprice").alias("r"))
    v = F.explode(F.array_compact(F.array((F.col("u") + 1 + F.col("z") % 3) * F.when(F.col("z") % 11 == 0, -1).otherwise(1),
                                          F.when(F.col("r") % 4 == 0, F.col("u") + 2 + F.col("z") % 5))))
    e = p.select(F.col("u").alias("id1"), v.alias("id2"), (F.col("z") - 20).cast("bigint").alias("gap"), (F.col("z") % 9 + 1).cast("bigint").alias("n_link"))
    return materialize(e.distinct(), "chain-edges")


_MU = """, d1 AS (SELECT u, v FROM dr WHERE abs(u) <> abs(v)),
    mu AS (SELECT u, v FROM d1 WHERE u IN (SELECT u FROM d1 GROUP BY 1 HAVING count(*) = 1) AND v IN (SELECT v FROM d1 GROUP BY 1 HAVING count(*) = 1))"""


@query("unambiguous_pairs", "G20 G25 G26", sql(_CH + _MU + " SELECT u, v FROM mu", "nodes"))
def unambiguous_pairs(spark, d):
    return sc.mutual_unique(chain_edges(spark, d)).select("u", "v").distinct()


@query("unambiguous_pair_joins", "G20 O10")
def unambiguous_pair_joins(spark, d):
    return sc.pair_joins(chain_edges(spark, d))


@query("unambiguous_paths", "G21 O10", sql(_CH + _MU + """,
    hd AS (SELECT u FROM mu WHERE u NOT IN (SELECT v FROM mu)),
    wk AS (SELECT u AS head, u AS node, 0 AS dist FROM hd UNION ALL SELECT head, mu.v, dist + 1 FROM wk JOIN mu ON mu.u = wk.node),
    tl AS (SELECT head, max_by(node, dist) AS t FROM wk GROUP BY 1)
    SELECT wk.head, wk.node, cast(dist as bigint) AS dist FROM wk JOIN tl ON tl.head = wk.head WHERE wk.head >= -t""", "nodes"))
def unambiguous_paths(spark, d):
    return sc.path_joins(chain_edges(spark, d))


# five consecutive parts form a cross: 0 is the centre, 1 and 2 lie left, 3 and 4 right
_CR = """, g AS (SELECT p_partkey // 5 AS g, p_partkey % 5 AS r, p_partkey + 1 AS node, p_size AS z FROM part),
    gc AS (SELECT g.* FROM g JOIN (SELECT g FROM g GROUP BY 1 HAVING count(*) = 5) USING (g)),
    ev AS (SELECT a.g, a.node AS l, b.node AS rt, a.z * b.z % 10 AS n, a.z AS gp FROM gc a JOIN gc b ON a.g = b.g AND a.r IN (1, 2) AND b.r IN (3, 4) WHERE (a.z * b.z) % 10 > 0),
    ct AS (SELECT g, min(node) AS centre, min(node) + 1 AS l1, min(node) + 2 AS l2, min(node) + 3 AS r1, min(node) + 4 AS r2 FROM gc GROUP BY 1),
    ce AS (SELECT centre, l1, l2, r1, r2, coalesce(sum(n) FILTER (l - l1 = rt - r1), 0) AS parallel, coalesce(sum(n) FILTER (l - l1 <> rt - r1), 0) AS crossed,
      count(n) FILTER (l - l1 = rt - r1) AS n_parallel, count(n) FILTER (l - l1 <> rt - r1) AS n_crossed FROM ct LEFT JOIN ev USING (g) GROUP BY 1, 2, 3, 4, 5)"""


def cross_edges(spark, d):
    p = fx.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 5).alias("g"), (F.col("p_partkey") % 5).alias("r"), (F.col("p_partkey") + 1).alias("node"), F.col("p_size").alias("z"))
    c = p.where("r = 0").select("g", F.col("node").alias("c"))
    full = p.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("g")
    t = p.join(full, "g").join(c, "g")
    # left parts run into the centre: stored turned, smaller id first
    e = t.where("r > 0").select(F.when(F.col("r") > 2, F.col("c")).otherwise(-F.col("c")).alias("id1"), F.when(F.col("r") > 2, F.col("node")).otherwise(-F.col("node")).alias("id2"),
                                F.col("z").cast("bigint").alias("gap"))
    a = t.where("r in (1, 2)").select("g", F.col("node").alias("id1"), F.col("z").alias("za"))
    b = t.where("r in (3, 4)").select("g", F.col("node").alias("id2"), F.col("z").alias("zb"))
    # two left and two right parts a cross: four pairs a group
    ev = a.join(b, "g").select("id1", "id2", (F.col("za") * F.col("zb") % 10).cast("bigint").alias("n"), F.col("za").cast("bigint").alias("gap")).where("n > 0")
    return e, ev


@query("cross_evidence", "G27 A45", sql(_CR + " SELECT centre, l1, l2, r1, r2, cast(parallel as bigint) AS parallel, cast(crossed as bigint) AS crossed FROM ce", "nodes"))
def cross_evidence(spark, d):
    e, ev = cross_edges(spark, d)
    return sc.cross_evidence(sc.crosses(e), ev, "n").select("centre", "l1", "l2", "r1", "r2", "parallel", "crossed")


@query("crosses_resolved", "G27 G28", sql(_CR + """, cx AS (SELECT *, CASE WHEN parallel <= 0.25 * crossed AND n_crossed > 0 THEN true WHEN crossed <= 0.25 * parallel AND n_parallel > 0 THEN false END AS x
      FROM ce WHERE greatest(parallel, crossed) >= 3)
    SELECT centre, l1 AS "left", CASE WHEN x THEN r2 ELSE r1 END AS "right" FROM cx WHERE x IS NOT NULL UNION ALL
    SELECT centre, l2, CASE WHEN x THEN r1 ELSE r2 END FROM cx WHERE x IS NOT NULL""", "nodes"))
def crosses_resolved(spark, d):
    e, ev = cross_edges(spark, d)
    p = sc.resolved_crosses(sc.cross_evidence(sc.crosses(e), ev, "n"), sc.CROSS_LINK_RATE, 3)
    return sc.disjoint_crosses(materialize(p, "cross-paths"))


@query("crosses_by_coverage", "G29")
def crosses_by_coverage(spark, d):
    e, _ = cross_edges(spark, d)
    n = nodes(spark, d).withColumn("cov", F.col("len") / 100)
    return sc.crosses_by_coverage(sc.crosses(e), n, 1.8, 1.3)


# four consecutive parts form a bubble: 0 is the source, 1 and 2 the arms, 3 the sink
def bubble_edges(spark, d):
    p = fx.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("g"), (F.col("p_partkey") % 4).alias("r"), (F.col("p_partkey") + 1).alias("node"), F.col("p_size").alias("z"))
    x = F.explode(F.array(F.struct(F.col("node").alias("id1"), (F.col("node") + 1).alias("id2")), F.struct(F.col("node").alias("id1"), (F.col("node") + 2).alias("id2"))))
    out = p.where("r = 0").select(x.alias("e"), "z").select("e.*", "z")
    into = p.where("r in (1, 2) and not (r = 2 and z % 5 = 0)").select(F.col("node").alias("id1"), (F.col("node") + 3 - F.col("r")).alias("id2"), "z")
    return out.unionByName(into).select("id1", "id2", (F.col("z") % 7).cast("bigint").alias("gap"), (F.col("z") % 9 + 1).cast("bigint").alias("n_link"))


@query("bubble_node_pairs", "G58 G59 G69", sql("""
    , p AS (SELECT p_partkey // 4 AS g, p_partkey % 4 AS r, p_partkey + 1 AS node, p_size AS z FROM part)
    SELECT a.node, b.node AS opposite FROM p s JOIN p a ON a.g = s.g AND a.r = 1 JOIN p b ON b.g = s.g AND b.r = 2 WHERE s.r = 0 AND b.z % 5 <> 0""", "nodes"))
def bubble_node_pairs(spark, d):
    return sc.bubble_pairs(bubble_edges(spark, d))


@query("bubble_node_pairs_gapped", "G60 G61", sql("""
    , p AS (SELECT p_partkey // 4 AS g, p_partkey % 4 AS r, p_partkey + 1 AS node, p_size AS z FROM part),
    q AS (SELECT a.node, b.node AS opposite, a.z % 7 AS ga, b.z % 7 AS gb, a.z * 100 AS la, b.z * 100 AS lb FROM p s JOIN p a ON a.g = s.g AND a.r = 1 JOIN p b ON b.g = s.g AND b.r = 2 WHERE s.r = 0 AND b.z % 5 <> 0)
    -- the arms collide as seen from the source or, with their own gaps, from the sink
    SELECT node, opposite FROM q WHERE ((la > 300 AND lb > 300) OR (la + ga - gb > 300 AND lb + gb - ga > 300)) AND node IN (SELECT node + 1 FROM nodes WHERE cov <= 1000) AND opposite IN (SELECT node + 1 FROM nodes WHERE cov <= 1000)""", "nodes"))
def bubble_node_pairs_gapped(spark, d):
    return sc.conflicting_pairs(bubble_edges(spark, d), nodes(spark, d), 300, 1000)


@query("bubbles_crushed_by_text", "G62 G63 G64 G65", sql("""
    , c AS (SELECT contig_id, seq, length(seq) AS len, left(seq, length(seq) // 2) || 'A' || substring(seq, length(seq) // 2 + 2) AS s2, cov FROM contigs WHERE length(seq) >= 50),
    n AS (SELECT contig_id * 2 + 1 AS node, seq, cov FROM c UNION ALL SELECT contig_id * 2 + 2, s2, cov + contig_id % 3 - 1 FROM c)
    SELECT CASE WHEN b.cov < a.cov OR (b.cov = a.cov) THEN b.node ELSE a.node END AS node, CASE WHEN b.cov < a.cov OR (b.cov = a.cov) THEN a.node ELSE b.node END AS keeper
    FROM n a JOIN n b ON b.node = a.node + 1 AND a.node % 2 = 1""", "contigs"))
def bubbles_crushed_by_text(spark, d):
    c = fx.contigs(spark, d).where(F.length("seq") >= 50)
    half = F.floor(F.length("seq") / 2).cast("int")
    second = F.concat(F.left("seq", half), F.lit("A"), F.substring(F.col("seq"), half + 2, F.length("seq")))
    n = c.select((F.col("contig_id") * 2 + 1).alias("node"), "seq", "cov").unionByName(
        c.select((F.col("contig_id") * 2 + 2).alias("node"), second.alias("seq"), (F.col("cov") + F.col("contig_id") % 3 - 1).cast("int").alias("cov")))
    pairs = c.select((F.col("contig_id") * 2 + 1).alias("node"), (F.col("contig_id") * 2 + 2).alias("opposite"))
    return sc.crush_alike(pairs, n, 0.02)


@query("overlaps_of_alike_ends", "G66 J24", sql("""
    , c AS (SELECT contig_id + 1 AS id, seq, length(seq) AS len FROM contigs WHERE length(seq) >= 5),
    o AS (SELECT id, 1 AS s, seq, len FROM c UNION ALL SELECT id, -1, reverse(translate(seq, 'ACGT', 'TGCA')), len FROM c),
    p AS (SELECT a.id * a.s AS x, b.id * b.s AS y, a.seq AS sa, b.seq AS sb, unnest(range(5, least(a.len, b.len) + 1)) AS n
      FROM o a JOIN o b ON abs(b.id) > abs(a.id) AND a.s = 1),
    q AS (SELECT x, y, n FROM p WHERE right(sa, n) = left(sb, n) UNION ALL SELECT -x, -y, n FROM p WHERE left(sa, n) = right(sb, n)),
    ov AS (SELECT x, y, max(n) AS n FROM q GROUP BY ALL),
    dd AS (SELECT x AS u, y AS v, n FROM ov UNION ALL SELECT -y, -x, n FROM ov),
    rk AS (SELECT *, first_value(v) OVER (PARTITION BY u ORDER BY n DESC, abs(v), v DESC) AS bv FROM dd),
    tx AS (SELECT rk.u, rk.v, a.seq AS s1, b.seq AS s2, least(a.len, b.len) AS n FROM rk JOIN o a ON a.id * a.s = v JOIN o b ON b.id * b.s = bv WHERE v <> bv)
    SELECT DISTINCT CASE WHEN abs(u) < abs(v) THEN u ELSE -v END AS id1, CASE WHEN abs(u) < abs(v) THEN v ELSE -u END AS id2
    FROM tx WHERE levenshtein(left(s1, n), left(s2, n)) <= floor(n * 0.6)""", "contigs"))
def overlaps_of_alike_ends(spark, d):
    from ..operators import overlap as ov
    c = fx.contigs(spark, d)
    return sc.alike_overlaps(ov.exact_overlaps(c, 5), c, 0.6)


@query("node_classes", "G67 A44", sql("""
    , b AS (SELECT node % 500 AS node, count(*) AS bubbles FROM tag_rows WHERE tag % 9 = 0 GROUP BY 1)
    SELECT n.node, (coalesce(bubbles, 0) >= 1 OR cov >= 1000) AS homo FROM nodes n LEFT JOIN b ON b.node = n.node""", "nodes", "tag_rows"))
def node_classes(spark, d):
    b = fx.tag_rows(spark, d).where("tag % 9 = 0").groupBy((F.col("node") % 500).alias("node")).agg(F.count(F.lit(1)).alias("bubbles"))
    return sc.classified(fx.nodes(spark, d), b, 1000)


# scaffolds of parts: ten consecutive part keys, lengths from the part sizes
_PT = """, pt AS (SELECT p_partkey // 10 AS node, p_partkey % 10 AS idx, (p_partkey % 400 + 1) * CASE WHEN p_size % 4 = 0 THEN -1 ELSE 1 END AS contig, p_size * 10 AS n, p_size % 7 * 40 - 60 AS gp FROM part),
    ps AS (SELECT node, idx, contig, n, sum(n + gp) OVER (PARTITION BY node ORDER BY idx) AS stop FROM pt),
    parts AS (SELECT node, idx, contig, cast(stop - n as bigint) AS s, cast(stop as bigint) AS e FROM ps),
    pp AS (SELECT *, lag(s) OVER w AS s0, lag(e) OVER w AS e0, lag(contig) OVER w AS c0, max(idx) OVER (PARTITION BY node) AS last FROM parts WINDOW w AS (PARTITION BY node ORDER BY idx))"""


# the same scaffolds where three fifths of the contigs are placed once, at any scale factor
_PT1 = _PT.replace("p_partkey % 400 + 1", "p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END")


def parts(spark, d, once=False):
    from pyspark.sql import Window
    k, z = F.col("p_partkey"), F.col("p_size")
    contig = k + F.when(k % 5 == 0, 2).otherwise(1) if once else k % 400 + 1
    t = fx.table(spark, d, "part").select(F.floor(k / 10).alias("node"), (k % 10).alias("idx"), (contig * F.when(z % 4 == 0, -1).otherwise(1)).alias("contig"),
                                          (z * 10).alias("n"), (z % 7 * 40 - 60).alias("gp"))
    # ten parts a scaffold by construction
    stop = F.sum(F.col("n") + F.col("gp")).over(Window.partitionBy("node").orderBy("idx")).cast("bigint")
    return materialize(t.select("node", "idx", "contig", (stop - F.col("n")).alias("start"), stop.alias("end")), "parts")


@query("node_coverage", "A19 A20 G71", sql(_PT + """, u AS (SELECT abs(contig) AS c, count(*) AS k FROM parts GROUP BY 1), cv AS (SELECT node + 1 AS c, len, cov FROM nodes),
    j AS (SELECT parts.node, len, cov, k FROM parts JOIN cv ON cv.c = abs(contig) JOIN u ON u.c = cv.c)
    SELECT node, round(coalesce(sum(cov * len) FILTER (k = 1), sum(cov * len)) / coalesce(sum(len) FILTER (k = 1), sum(len)), 6) AS cov FROM j GROUP BY 1""", "nodes"))
def node_coverage(spark, d):
    c = fx.nodes(spark, d).select((F.col("node") + 1).alias("contig"), "len", "cov")
    return sc.node_coverage(parts(spark, d), c).select("node", F.round("cov", 6).alias("cov"))


@query("node_cluster_labels", "G70", sql(_PT + """, l AS (SELECT p.node, idx, n.cluster FROM parts p JOIN nodes n ON n.node + 1 = abs(contig) WHERE n.cluster % 3 <> 0)
    SELECT DISTINCT p.node, coalesce((SELECT min_by(cluster, idx) FROM l WHERE l.node = p.node), 0) AS cluster FROM parts p""", "nodes"))
def node_cluster_labels(spark, d):
    c = fx.nodes(spark, d).select((F.col("node") + 1).alias("contig"), F.when(F.col("cluster") % 3 != 0, F.col("cluster")).otherwise(0).alias("cluster"))
    return sc.node_clusters(parts(spark, d), c)


@query("opposite_nodes", "G68 A37", sql(_PT1 + """, u AS (SELECT abs(contig) AS c, count(*) AS k, min(sign(contig) * node) AS home FROM parts WHERE node > 0 GROUP BY 1),
    o AS (SELECT p.node, e - s AS len, sign(contig) * u.home AS partner FROM parts p JOIN u ON u.c = abs(contig) + 13 AND k = 1 WHERE p.node > 0),
    w AS (SELECT node, partner, sum(len) AS l FROM o WHERE abs(partner) <> node GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY l DESC, abs(partner), partner DESC) AS rn FROM w)
    SELECT node, cast(partner as bigint) AS opposite FROM r WHERE rn = 1""", "nodes"))
def opposite_nodes(spark, d):
    p = parts(spark, d, once=True).where("node > 0").select("node", "contig", (F.col("end") - F.col("start")).alias("len"))
    o = p.select(F.abs("contig").alias("contig")).distinct().select("contig", (F.col("contig") + 13).alias("opposite"))
    return sc.opposite_nodes(p, o)


@query("division_at_gaps", "G82 W7", sql(_PT + " SELECT node, idx FROM pp WHERE e0 IS NOT NULL AND s - e0 > 100", "nodes"))
def division_at_gaps(spark, d):
    return dv.gap_breaks(parts(spark, d), 100)


@query("division_sparse_ends", "G80", sql(_PT + " SELECT node, idx FROM pp WHERE e0 IS NOT NULL AND ((idx = 1 AND s - e0 > e0 - s0) OR (idx = last AND s - e0 > e - s))", "nodes"))
def division_sparse_ends(spark, d):
    return dv.sparse_end_breaks(parts(spark, d)).distinct()


_USED = ", un AS (SELECT abs(contig) AS c FROM parts GROUP BY 1 HAVING count(*) = 1)"


@query("division_repeat_ends", "G81", sql(_PT.replace("p_partkey % 400", "(p_partkey * p_size) % 900") + _USED + """, g AS (SELECT node, min(idx) AS a, max(idx) AS b FROM parts WHERE abs(contig) IN (SELECT c FROM un) GROUP BY 1),
    z AS (SELECT node, max(idx) AS last FROM parts GROUP BY 1)
    SELECT node, a AS idx FROM g WHERE a > 0 UNION SELECT g.node, b + 1 FROM g JOIN z ON z.node = g.node WHERE b > 0 AND b + 1 <= last""", "nodes"))
def division_repeat_ends(spark, d):
    p = fx.table(spark, d, "part").select((F.col("p_partkey") * F.col("p_size") % 900 + 1).alias("c"), F.floor(F.col("p_partkey") / 10).alias("node"), (F.col("p_partkey") % 10).alias("idx"))
    t = parts(spark, d).join(p, ["node", "idx"]).withColumn("contig", F.signum("contig").cast("int") * F.col("c")).drop("c")
    return dv.repeat_end_breaks(t)


@query("division_chimeric_clusters", "G83", sql(_PT + """, l AS (SELECT p.node, idx, CASE WHEN n.cluster % 3 <> 0 THEN n.cluster ELSE 0 END AS c FROM parts p JOIN nodes n ON n.node + 1 = abs(contig)),
    v AS (SELECT node, idx, c, lag(c) OVER (PARTITION BY node ORDER BY idx) AS c0, lag(idx) OVER (PARTITION BY node ORDER BY idx) AS i0 FROM l WHERE c <> 0 OR idx = 0),
    h AS (SELECT * FROM v WHERE i0 IS NOT NULL AND c <> 0 AND c <> c0) SELECT node, i0 + 1 AS idx FROM h UNION SELECT node, idx FROM h""", "nodes"))
def division_chimeric_clusters(spark, d):
    c = fx.nodes(spark, d).select((F.col("node") + 1).alias("contig"), F.when(F.col("cluster") % 3 != 0, F.col("cluster")).otherwise(0).alias("cluster"))
    return dv.cluster_breaks(parts(spark, d), c)


@query("division_label_changes", "W7 G84 G86 G87 J39", sql(_PT + """, v AS (SELECT node, idx, p.contig % 3 AS l, lag(p.contig % 3) OVER (PARTITION BY node ORDER BY idx) AS l0 FROM parts p)
    SELECT node, idx FROM v WHERE idx > 0 AND l <> l0""", "nodes"))
def division_label_changes(spark, d):
    return dv.label_breaks(parts(spark, d).select("node", "idx", (F.col("contig") % 3).alias("label")))


@query("division_bubbles_isolated", "G89", sql(_PT + """, t AS (SELECT node, idx, last FROM pp WHERE last > 0 AND abs(contig) % 5 = 0 AND node % 4 <> 0)
    SELECT node, idx FROM t WHERE idx > 0 UNION SELECT node, idx + 1 FROM t WHERE idx + 1 <= last""", "nodes"))
def division_bubbles_isolated(spark, d):
    p = parts(spark, d)
    b = p.select(F.abs("contig").alias("contig")).distinct().where("contig % 5 = 0")
    return dv.isolated_breaks(p, b, p.select("node").distinct().where("node % 4 = 0"))


def _part_overlaps(p):
    """Recorded overlaps between the contigs of neighbouring parts."""
    from ..operators.overlap import canonical_pair
    t = dv.with_previous(p)
    o = t.select(canonical_pair("p_contig", "contig").alias("k"), (F.abs("contig") % 40 + F.abs("p_contig") % 3 + 5).cast("int").alias("length"))
    return o.groupBy("k").agg(F.max("length").alias("length")).select("k.id1", "k.id2", "length")


_POV = """, ok AS (SELECT CASE WHEN abs(c0) > abs(contig) THEN -contig ELSE c0 END AS k1, CASE WHEN abs(c0) > abs(contig) THEN -c0 ELSE contig END AS k2, abs(contig) % 40 + abs(c0) % 3 + 5 AS n FROM pp WHERE c0 IS NOT NULL),
    og AS (SELECT k1, k2, max(n) AS n FROM ok GROUP BY 1, 2),
    po AS (SELECT pp.*, og.n AS ov FROM pp JOIN og ON k1 = CASE WHEN abs(c0) > abs(contig) THEN -contig ELSE c0 END AND k2 = CASE WHEN abs(c0) > abs(contig) THEN -c0 ELSE contig END WHERE c0 IS NOT NULL)"""


@query("division_bubble_junctions", "G85", sql(_PT + _POV + " SELECT DISTINCT node, idx FROM po WHERE (abs(contig) % 3 = 0 OR abs(c0) % 3 = 0) AND ov < 30", "nodes"))
def division_bubble_junctions(spark, d):
    p = parts(spark, d)
    j = p.select(F.abs("contig").alias("contig")).distinct().where("contig % 3 = 0")
    return dv.bubble_junction_breaks(p, j, _part_overlaps(p), 30)


@query("division_end_flags", "G88", None)
def division_end_flags(spark, d):
    p = parts(spark, d)
    o = p.select(F.abs("contig").alias("contig")).distinct().where("contig % 4 < 2").select(
        "contig", F.when(F.col("contig") % 4 == 0, F.col("contig") + 1).otherwise(F.col("contig") - 1).alias("opposite"))
    return dv.end_flag_breaks(p, o, dv.gap_breaks(p, 150))


def _pairs_on_parts(spark, d):
    """Orders as read pairs: two places on scaffolds of parts."""
    li = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.min("l_suppkey").alias("s"))
    return li.select(F.col("l_orderkey").alias("pair"), "a", "b", "s")


_PR = ", oq AS (SELECT l_orderkey AS pair, min(l_partkey) AS a, max(l_partkey) AS b, min(l_suppkey) AS s FROM lineitem GROUP BY 1)"


@query("gap_spanning_pairs", "G72 G75 A17", sql(_PR + """, sp AS (SELECT pair, a // 40 AS node, least(a % 40, b % 40) AS x, greatest(a % 40, b % 40) AS y FROM oq WHERE a // 40 = b // 40)
    SELECT node, idx, count(*) AS n FROM (SELECT node, unnest(range(x + 1, y + 1)) AS idx FROM sp) GROUP BY 1, 2""", "nodes"))
def gap_spanning_pairs(spark, d):
    p = _pairs_on_parts(spark, d).where("floor(a / 40) = floor(b / 40)").select("pair", F.floor(F.col("a") / 40).alias("node"), (F.col("a") % 40).alias("idx1"), (F.col("b") % 40).alias("idx2"))
    return dv.spanning(p)


_MATE = _PT + _PR + """, mt AS (SELECT pair, p.node, CASE WHEN oq.s % 2 = 0 THEN 1 ELSE -1 END AS strand, p.s + 5 AS pos, p.idx FROM oq JOIN parts p ON p.node = a // 10 AND p.idx = a % 10)"""


def _mates(spark, d):
    p = parts(spark, d).select("node", "idx", "start")
    q = _pairs_on_parts(spark, d).select("pair", F.floor(F.col("a") / 10).alias("node"), (F.col("a") % 10).alias("idx"), F.when(F.col("s") % 2 == 0, 1).otherwise(-1).alias("strand"))
    return q.join(p, ["node", "idx"]).select("pair", "node", "strand", (F.col("start") + 5).alias("pos"), "idx")


_INSIDE = """, ib AS (SELECT DISTINCT pair, m.node, p.idx + 1 AS cut FROM mt m JOIN pp p ON p.node = m.node AND m.strand = 1 AND p.idx >= m.idx AND p.idx < p.last AND p.e - m.pos <= 400
      UNION SELECT DISTINCT pair, m.node, p.idx FROM mt m JOIN pp p ON p.node = m.node AND m.strand = -1 AND p.idx <= m.idx AND p.idx > 0 AND m.pos - p.s <= 400),
    ic AS (SELECT node, cut AS idx, count(*) AS n FROM ib GROUP BY 1, 2)"""


@query("gap_inside_links", "G72 G76", sql(_MATE + _INSIDE + " SELECT node, idx, n FROM ic", "nodes"))
def gap_inside_links(spark, d):
    return dv.inside_links(_mates(spark, d), parts(spark, d), 400)


@query("gap_contradicting_mates", "G72", sql(_MATE + """, z AS (SELECT node, 2000 AS len FROM parts GROUP BY 1),
    pq AS (SELECT m.pair, m.node AS n1, m.strand AS s1, m.pos AS p1, w.node AS n2, -m.strand * CASE WHEN m.pair % 3 = 0 THEN -1 ELSE 1 END AS s2, w.pos + 300 AS p2 FROM mt m JOIN mt w ON w.pair = m.pair + 1),
    ov AS (SELECT *, CASE WHEN s1 > 0 THEN 2000 - p1 ELSE p1 END + CASE WHEN s2 > 0 THEN 2000 - p2 ELSE p2 END AS o FROM pq)
    SELECT pair, count(*) * 2 AS mates FROM ov WHERE NOT (n1 = n2 AND s1 = -s2) AND o > 1500 GROUP BY 1""", "nodes"))
def gap_contradicting_mates(spark, d):
    m = _mates(spark, d)
    nxt = m.select((F.col("pair") - 1).alias("pair"), F.col("node").alias("n2"), (F.col("pos") + 300).alias("p2"), F.col("idx").alias("i2"))
    q = m.join(nxt, "pair").select("pair", F.col("node").alias("n1"), F.col("strand").alias("s1"), F.col("pos").alias("p1"), F.col("idx").alias("i1"), "n2",
                                   (-F.col("strand") * F.when(F.col("pair") % 3 == 0, -1).otherwise(1)).alias("s2"), "p2", "i2")
    z = parts(spark, d).select("node").distinct().select("node", F.lit(2000).alias("len"))
    return dv.contradicting_mates(q, z, 1400, 100).groupBy("pair").agg(F.count(F.lit(1)).alias("mates"))


@query("switch_error_pairs", "G73 G74", None)
def switch_error_pairs(spark, d):
    p = parts(spark, d, once=True).where("node > 0")
    # scaffolds 2i and 2i + 1 are partners, contigs at the same place of both are arms
    c = p.select(F.abs("contig").alias("contig")).distinct()
    opp = c.select("contig", F.when(F.floor((F.col("contig") - 1) / 10) % 2 == 0, F.col("contig") + 10).otherwise(F.col("contig") - 10).alias("opposite"))
    home = sc.placed_once(p)
    # an order pairs its first part with a part of the partner scaffold
    away = F.when(F.floor(F.col("a") / 10) % 2 == 0, F.col("a") + 10).otherwise(F.col("a") - 10)
    pairs = _pairs_on_parts(spark, d).select("pair", (F.col("a") + 1).alias("c1"), (away - away % 10 + F.col("b") % 10 + 1).alias("c2"))
    partner = home.select("node").distinct().select("node", F.when(F.col("node") % 2 == 0, F.col("node") + 1).otherwise(F.col("node") - 1).alias("opposite"))
    return dv.spanning(dv.switched(pairs, opp, home, partner))


_PRO = """, pr AS (SELECT node, idx, count(*) AS n FROM (SELECT a // 10 AS node, unnest(range(a % 10 + 1, b % 10 + 1)) AS idx FROM oq WHERE a // 10 = b // 10) GROUP BY 1, 2)"""


def _pro(spark, d):
    p = _pairs_on_parts(spark, d).where("floor(a / 10) = floor(b / 10)").select("pair", F.floor(F.col("a") / 10).alias("node"), (F.col("a") % 10).alias("idx1"), (F.col("b") % 10).alias("idx2"))
    return dv.spanning(p)


@query("division_erroneous", "G77", sql(_MATE + _INSIDE + _PRO + """ SELECT pp.node, pp.idx FROM pp LEFT JOIN pr ON pr.node = pp.node AND pr.idx = pp.idx LEFT JOIN ic ON ic.node = pp.node AND ic.idx = pp.idx
    WHERE pp.idx > 0 AND coalesce(ic.n, 0) > coalesce(pr.n, 0) AND coalesce(ic.n, 0) >= 4""", "nodes"))
def division_erroneous(spark, d):
    p = parts(spark, d)
    return dv.erroneous_breaks(p, _pro(spark, d), dv.inside_links(_mates(spark, d), p, 400), "switch", 4)


_CUT = _PT + """, br AS (SELECT node, idx FROM pp WHERE e0 IS NOT NULL AND s - e0 > 100),
    sg AS (SELECT parts.*, sum(CASE WHEN br.idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY parts.node ORDER BY parts.idx) AS seg FROM parts LEFT JOIN br ON br.node = parts.node AND br.idx = parts.idx),
    fs AS (SELECT abs(contig) AS c, min(row(node, seg)) AS f FROM sg GROUP BY 1),
    kp AS (SELECT DISTINCT sg.node, sg.seg FROM sg JOIN fs ON fs.c = abs(contig) AND f = row(node, seg)),
    zs AS (SELECT node, seg, min(idx) AS z, min_by(s, idx) AS zs FROM sg GROUP BY 1, 2)"""


@query("division_applied", "G78 G79 G71 G90", sql(_CUT + """
    SELECT sg.node AS parent, cast(sg.seg as bigint) AS seg, sg.idx - z AS idx, contig, s - zs AS "start", e - zs AS "end" FROM sg JOIN kp ON kp.node = sg.node AND kp.seg = sg.seg JOIN zs ON zs.node = sg.node AND zs.seg = sg.seg""", "nodes"))
def division_applied(spark, d):
    p = parts(spark, d)
    return dv.split_at(p, dv.gap_breaks(p, 100), unique=True)


@query("division_renumbered", "G71 G78", sql(_CUT + """
    SELECT cast(dense_rank() OVER (ORDER BY sg.node, sg.seg) as bigint) AS node, sg.idx - z AS idx, contig, s - zs AS "start", e - zs AS "end", sg.node AS parent
    FROM sg JOIN kp ON kp.node = sg.node AND kp.seg = sg.seg JOIN zs ON zs.node = sg.node AND zs.seg = sg.seg""", "nodes"))
def division_renumbered(spark, d):
    p = parts(spark, d)
    return dv.renumbered_nodes(dv.split_at(p, dv.gap_breaks(p, 100), unique=True))


@query("majority_runs", "W17 A37", sql(_PT + """, w AS (SELECT node, contig % 3 AS l, sum(e - s) AS t, min(idx) AS first, max(idx) AS last FROM parts WHERE contig % 3 <> 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t DESC, l) AS rn FROM w),
    x AS (SELECT node, idx, l, last, CASE WHEN contig % 3 = l THEN s - e WHEN contig % 3 <> 0 THEN e - s ELSE 0 END AS x
      FROM parts JOIN r USING (node) WHERE rn = 1 AND idx BETWEEN first AND last),
    b AS (SELECT *, sum(x) OVER (PARTITION BY node ORDER BY idx ROWS UNBOUNDED PRECEDING) - x AS before,
      sum(x) OVER (PARTITION BY node ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) - x AS after FROM x),
    st AS (SELECT node, l, idx AS first FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY before DESC, idx) AS k FROM b) WHERE k = 1),
    en AS (SELECT node, idx AS last FROM (SELECT b.*, row_number() OVER (PARTITION BY b.node ORDER BY after DESC, idx DESC) AS k FROM b JOIN st ON st.node = b.node AND idx > st.first) WHERE k = 1)
    SELECT st.node, l AS label, first, coalesce(en.last, first) AS last FROM st LEFT JOIN en ON en.node = st.node""", "nodes"))
def majority_runs(spark, d):
    return dv.majority_run(parts(spark, d).select("node", "idx", (F.col("contig") % 3).alias("label"), (F.col("end") - F.col("start")).alias("len")))


@query("labels_smoothed", "W18 J40", None)
def labels_smoothed(spark, d):
    return dv.smoothed(parts(spark, d).select("node", "idx", (F.col("contig") % 3).alias("label"), (F.col("end") - F.col("start")).alias("len")))


@query("contig_to_scaffold_lift", "J22 J23", sql(_PT1 + _USED + """
    SELECT l_orderkey AS pair, sign(v.c) * CASE WHEN p.contig > 0 THEN p.node ELSE -p.node END AS id, CASE WHEN p.contig > 0 THEN l_linenumber ELSE e - s - l_linenumber - 1 END + s AS "offset", p.idx
    FROM (SELECT *, (l_partkey + 1) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS c FROM lineitem) v JOIN parts p ON abs(p.contig) = abs(v.c) WHERE abs(v.c) IN (SELECT c FROM un)""", "nodes"))
def contig_to_scaffold_lift(spark, d):
    h = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), ((F.col("l_partkey") + 1) * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("id"),
                                              F.col("l_linenumber").alias("offset"))
    return lk.lift(h, parts(spark, d, once=True)).select("pair", "id", "offset", "idx")


@query("linked_node_paths", "G30 G31", None)
def linked_node_paths(spark, d):
    e = chain_edges(spark, d)
    n = nodes(spark, d).select("node", F.lit(100).alias("len"))
    pairs = nodes(spark, d).select(F.col("node").alias("id1"), (F.col("node") + 6).alias("id2"), F.lit(300).cast("bigint").alias("gap"))
    return sc.bounded_paths(e, n, pairs, 50)


@query("scaffold_layouts_in_seed_order", "G22 G23 O11", None)
def scaffold_layouts_in_seed_order(spark, d):
    """Edges that leave a block of eight nodes are cut; every node of rank 5 in its block is a repeat."""
    e = chain_edges(spark, d).where("(abs(id1) - 1) div 8 = (abs(id2) - 1) div 8")
    k = F.col("node") - 1
    n = nodes(spark, d).select("node", F.least("len", F.lit(900)).alias("len"), F.when(F.col("cluster") < 4, 0).otherwise(F.col("cluster")).alias("cluster"),
                               (k % 8 == 5).alias("repeat"))
    return gr.layouts_in_seed_order(n, e, 30)


@query("scaffold_layouts", "G22 G23 G24 O11 L4", None)
def scaffold_layouts(spark, d):
    e = chain_edges(spark, d).withColumn("gap", F.greatest("gap", F.lit(0)))
    n = nodes(spark, d).select("node", F.lit(500).alias("len"), "cluster", F.lit(False).alias("repeat"))
    return sc.grow_layouts(n, e, 50)
