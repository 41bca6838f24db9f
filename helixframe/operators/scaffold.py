"""Joining nodes of the scaffold graph: unambiguous joins, crosses, bubbles,
bounded path search and layout growth.

Nodes are directed (sign of the id). Everything runs in rounds over the whole
graph; conflicts inside a round are settled by the smaller id, which makes the
result independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import is_empty, materialize
from .edges import half_edges

CROSS_LINK_RATE = 0.25      # fixed values of the cross rule
CROSS_SCORE_RATE = 0.5


def directed(edges: DataFrame) -> DataFrame:
    """(u, v, ...) for both readings of each edge: u runs into v."""
    both = F.explode(F.array(F.struct(F.col("id1").alias("u"), F.col("id2").alias("v")),
                             F.struct((-F.col("id2")).alias("u"), (-F.col("id1")).alias("v"))))
    rest = [x for x in edges.columns if x not in ("id1", "id2")]
    return edges.select(both.alias("d"), *rest).select("d.*", *rest)


def mutual_unique(edges: DataFrame) -> DataFrame:
    """Edges that are the only one at their outgoing and at their incoming end."""
    d = directed(edges).where(F.abs("u") != F.abs("v"))
    out = d.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u")
    into = d.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("v")
    return d.join(out, "u", "left_semi").join(into, "v", "left_semi")


def pair_joins(edges: DataFrame) -> DataFrame:
    """Pairs to merge in one round. Every node asks for one pair (its left side
    first); among pairs that share a node the one asked for by the smallest
    node wins, then of the rest, as in a first-come order over node ids."""
    m = mutual_unique(edges).select("u", "v")
    # a node's left partner comes before its right one
    ask = m.select(F.abs("v").alias("self"), F.when(F.col("v") > 0, 0).otherwise(1).alias("o"), "u", "v").unionByName(
        m.select(F.abs("u").alias("self"), F.when(F.col("u") > 0, 1).otherwise(0).alias("o"), "u", "v"))
    own = ask.groupBy("self").agg(F.min(F.struct("o", "u", "v")).alias("p")).select("self", "p.u", "p.v")
    # both readings of a pair are the same pair
    a, b = F.abs("u"), F.abs("v")
    pairs = own.select("self", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"),
                       F.when(a < b, F.struct("u", "v")).otherwise(F.struct((-F.col("v")).alias("u"), (-F.col("u")).alias("v"))).alias("p"))
    pairs = pairs.groupBy("a", "b", "p").agg(F.min("self").alias("self"))
    return greedy_matching(pairs).select("p.u", "p.v")


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """First-come choice over pairs (a, b, self): in each round the pairs that
    are first (self, a, b) at both of their nodes are taken and their nodes
    leave, so the outcome equals a pass over all pairs in that order."""
    left = materialize(pairs, "pairs")
    taken = None
    while True:
        if is_empty(left):
            break
        rank = F.struct("self", "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("node"), rank.alias("r"))
        first = ends.groupBy("node").agg(F.min("r").alias("r"))
        both = first.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("r.*")
        win = materialize(left.join(both, ["self", "a", "b"], "left_semi"), "won")
        taken = win if taken is None else taken.unionByName(win)
        used = win.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        left = materialize(left.join(used.withColumnRenamed("node", "a"), "a", "left_anti").join(
            used.withColumnRenamed("node", "b"), "b", "left_anti"), "pairs")
    return taken if taken is not None else left


def path_joins(edges: DataFrame) -> DataFrame:
    """Maximal chains of mutually unique edges: (head, node signed, dist)."""
    from .dbg import _chains
    m = mutual_unique(edges)
    keys = m.select(F.col("u").alias("k")).unionByName(m.select(F.col("v").alias("k"))).distinct()
    text = lambda x: F.col(x).cast("string")
    chain = materialize(_chains(m.select(text("v").alias("key"), text("u").alias("prev")), keys.select(text("k").alias("key"))), "paths")
    num = F.col("key").cast("bigint")
    g = chain.groupBy("head").agg(F.max_by("key", "dist").alias("t"), F.min(num).alias("low"), F.min(-num).alias("back"))
    # chains are read from the end with the larger signed id, rings from the
    # direction that holds the lower one
    ring = g.join(m.select(text("v").alias("head")).distinct(), "head", "left_semi").where("low <= back").select("head")
    line = g.join(m.select(text("v").alias("head")).distinct(), "head", "left_anti").where(
        F.col("head").cast("bigint") >= -F.col("t").cast("bigint")).select("head")
    keep = line.unionByName(ring)
    return chain.join(keep, "head").select(F.col("head").cast("bigint").alias("head"), F.col("key").cast("bigint").alias("node"), "dist")


def crosses(edges: DataFrame) -> DataFrame:
    """Centres with two neighbours on either side that have no other neighbour
    on the side of the centre: (centre, l1, l2, r1, r2), all signed."""
    d = directed(edges)
    out = d.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("n = 2")
    lone = d.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("v")
    side = out.join(lone.withColumnRenamed("v", "v1"), "v1", "left_semi").join(lone.withColumnRenamed("v", "v2"), "v2", "left_semi").select("u", "v1", "v2")
    right = side.where("u > 0").select(F.col("u").alias("centre"), F.col("v1").alias("r1"), F.col("v2").alias("r2"))
    # neighbours on the left, read from the turned centre
    left = side.where("u < 0").select((-F.col("u")).alias("centre"), (-F.col("v2")).alias("l1"), (-F.col("v1")).alias("l2"))
    x = right.join(left, "centre")
    same = F.array_distinct(F.array(*[F.abs(c) for c in ("centre", "l1", "l2", "r1", "r2")]))
    return x.where(F.size(same) == 5)


def cross_evidence(found: DataFrame, evidence: DataFrame, value: str) -> DataFrame:
    """Evidence for the parallel (l1-r1, l2-r2) and crossed pairing. ``evidence``
    is (id1, id2, value, gap) between outer nodes, either order."""
    from .overlap import canonical_pair
    want = found.select("*", F.explode(F.array(*[F.struct(F.col(l).alias("x"), F.col(r).alias("y"), F.lit(p).alias("parallel"))
                                                 for l, r, p in (("l1", "r1", True), ("l2", "r2", True), ("l1", "r2", False), ("l2", "r1", False))])).alias("w"))
    key = want.withColumn("_k", canonical_pair("w.x", "w.y"))
    have = evidence.select(F.struct("id1", "id2").alias("_k"), F.col(value).alias("_v"), F.col("gap").alias("_g"))
    j = key.join(have, "_k", "left")
    p = F.col("w.parallel")
    total = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("_v"))), F.lit(0)).cast("bigint")
    return j.groupBy("centre", "l1", "l2", "r1", "r2").agg(
        total(p).alias("parallel"), total(~p).alias("crossed"),
        F.count(F.when(p, F.col("_v"))).alias("n_parallel"), F.count(F.when(~p, F.col("_v"))).alias("n_crossed"),
        F.avg(F.when(p, F.col("_g"))).alias("gap_parallel"), F.avg(F.when(~p, F.col("_g"))).alias("gap_crossed"))


def resolved_crosses(found: DataFrame, rate: float, min_link: int = 0, lengths: DataFrame | None = None,
                     tolerance: int | None = None) -> DataFrame:
    """Paths (left, centre, right) through resolved centres, two per centre. The
    weaker pairing has at most ``rate`` of the stronger; with lengths given the
    stronger one's mean gap must match the centre within the tolerance."""
    t = found.where(F.greatest("parallel", "crossed") >= min_link)
    crossed = (F.col("parallel") <= F.col("crossed") * rate) & (F.col("n_crossed") > 0)
    parallel = (F.col("crossed") <= F.col("parallel") * rate) & (F.col("n_parallel") > 0)
    t = t.withColumn("_x", F.when(crossed, True).when(parallel, False)).where("_x is not null")
    if lengths is not None:
        t = t.join(lengths.select(F.col("node").alias("centre"), "len"), "centre").where(
            F.abs(F.col("len") - F.when(F.col("_x"), F.col("gap_crossed")).otherwise(F.col("gap_parallel"))) <= tolerance)
    r1, r2 = F.when(F.col("_x"), F.col("r2")).otherwise(F.col("r1")), F.when(F.col("_x"), F.col("r1")).otherwise(F.col("r2"))
    return t.select("centre", F.explode(F.array(F.struct(F.col("l1").alias("left"), r1.alias("right")),
                                                F.struct(F.col("l2").alias("left"), r2.alias("right")))).alias("p")).select("centre", "p.*")


def disjoint_crosses(paths: DataFrame) -> DataFrame:
    """Of resolved centres that share outer nodes the smaller centre goes first."""
    nodes = paths.select("centre", F.explode(F.array(F.abs("left"), F.abs("right"), F.col("centre"))).alias("n")).distinct()
    left = materialize(nodes, "cross-nodes")
    taken = None
    while not is_empty(left):
        first = left.groupBy("n").agg(F.min("centre").alias("c"))
        lost = left.join(first, "n").where("centre <> c").select("centre").distinct()
        win = materialize(left.select("centre").distinct().join(lost, "centre", "left_anti"), "cross-won")
        taken = win if taken is None else taken.unionByName(win)
        used = left.join(win, "centre", "left_semi").select("n").distinct()
        gone = left.join(used, "n", "left_semi").select("centre").distinct()
        left = materialize(left.join(gone, "centre", "left_anti"), "cross-nodes")
    return paths.join(taken, "centre", "left_semi") if taken is not None else paths.limit(0)


def crosses_by_coverage(found: DataFrame, nodes: DataFrame, near: float, far: float) -> DataFrame:
    """Pairing by coverage: partners within ``near`` of each other while the two
    pairs differ by more than ``far``."""
    t = found
    for x in ("l1", "l2", "r1", "r2"):
        t = t.withColumn("node", F.abs(x)).join(nodes.select("node", F.col("cov").alias("c_" + x)), "node").drop("node")
    close = lambda a, b, r: (F.col("c_" + a) * r >= F.col("c_" + b)) & (F.col("c_" + b) * r >= F.col("c_" + a))
    par = close("l1", "r1", near) & close("l2", "r2", near) & ~close("l1", "l2", far) & ~close("r1", "r2", far)
    cro = close("l1", "r2", near) & close("l2", "r1", near) & ~close("l1", "l2", far) & ~close("r1", "r2", far)
    return t.withColumn("crossed", F.when(par & ~cro, False).when(cro & ~par, True)).where("crossed is not null").select(
        "centre", "l1", "l2", "r1", "r2", "crossed")


def bubble_pairs(edges: DataFrame, both_ends: bool = True) -> DataFrame:
    """Two successors of a node side that each have one successor, the same for
    both; with ``both_ends`` that sink has just these two on its side."""
    d = directed(edges)
    out = d.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    two = out.where("n = 2 and abs(a) <> abs(b)").select("u", "a", "b")
    one = out.where("n = 1").select(F.col("u").alias("x"), F.col("a").alias("sink"))
    t = two.join(one.select(F.col("x").alias("a"), F.col("sink").alias("s1")), "a").join(
        one.select(F.col("x").alias("b"), F.col("sink").alias("s2")), "b").where("s1 = s2")
    if both_ends:
        # seen from the sink, two ways in
        t = t.join(d.groupBy(F.col("v").alias("s1")).agg(F.count(F.lit(1)).alias("m")).where("m = 2").select("s1"), "s1", "left_semi")
    turn = (F.abs("a") > F.abs("b"))
    p = t.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    # one row per bubble: the smaller arm forward
    s = F.signum("a").cast("bigint")
    return p.select((F.col("a") * s).alias("node"), (F.col("b") * s).alias("opposite")).distinct()


def gapped_bubble_pairs(edges: DataFrame, nodes: DataFrame, tolerance: int) -> DataFrame:
    """As ``bubble_pairs`` on gapped edges: the two successors collide, and each
    has a single neighbour on both sides."""
    d = materialize(directed(edges), "directed")
    deg = d.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")
    out = d.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "gap")).alias("a"), F.max(F.struct("v", "gap")).alias("b")).where("n = 2")
    t = out.select("u", F.col("a.v").alias("a"), F.col("a.gap").alias("ga"), F.col("b.v").alias("b"), F.col("b.gap").alias("gb")).where("abs(a) <> abs(b)")
    size = nodes.select("node", "len")
    t = t.withColumn("node", F.abs("a")).join(size.withColumnRenamed("len", "la"), "node").drop("node").withColumn(
        "node", F.abs("b")).join(size.withColumnRenamed("len", "lb"), "node").drop("node")
    e1, e2 = F.col("ga") + F.col("la"), F.col("gb") + F.col("lb")
    t = t.where((e1 > F.col("gb")) & (e2 > F.col("ga")) & (F.abs(e1 - F.col("gb")) > tolerance) & (F.abs(e2 - F.col("ga")) > tolerance))
    for x in ("a", "b"):
        t = t.join(deg.select(F.col("u").alias(x), F.col("v").alias("s_" + x)), x).join(
            deg.select((-F.col("u")).alias(x)), x, "left_semi")
    t = t.where("s_a = s_b and abs(s_a) <> abs(u)")
    turn = F.abs("a") > F.abs("b")
    p = t.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    s = F.signum("a").cast("bigint")
    return p.select((F.col("a") * s).alias("node"), (F.col("b") * s).alias("opposite")).distinct()


def conflicting_pairs(edges: DataFrame, nodes: DataFrame, tolerance: int, max_cov: float) -> DataFrame:
    """Gapped bubble pairs whose two nodes both stay at or below a coverage."""
    p = gapped_bubble_pairs(edges, nodes, tolerance)
    low = nodes.where(F.col("cov") <= max_cov).select("node")
    return p.join(low, "node", "left_semi").withColumn("_o", F.abs("opposite")).join(low.withColumnRenamed("node", "_o"), "_o", "left_semi").drop("_o")


def crush_alike(pairs: DataFrame, nodes: DataFrame, rate: float) -> DataFrame:
    """Lower arms of bubbles whose sequences differ by at most ``rate`` edits a
    base: (node, keeper). ``nodes`` carries seq and cov."""
    from ..functions.bases import revcomp
    n = nodes.select("node", "seq", "cov", F.length("seq").alias("len"))
    t = pairs.join(n, "node").withColumn("_o", F.abs("opposite")).join(
        n.select(F.col("node").alias("_o"), F.col("seq").alias("seq2"), F.col("cov").alias("cov2"), F.col("len").alias("len2")), "_o")
    other = F.when(F.col("opposite") > 0, F.col("seq2")).otherwise(revcomp("seq2"))
    ok = t.where(F.levenshtein(F.col("seq"), other) <= F.floor(F.greatest("len", "len2") * rate + 0.5))
    lower = F.struct("cov", "len", (-F.col("node")).alias("i")) < F.struct("cov2", "len2", (-F.col("_o")).alias("i"))
    return ok.select(F.when(lower, F.col("node")).otherwise(F.col("_o")).alias("node"), F.when(lower, F.col("_o")).otherwise(F.col("node")).alias("keeper"))


def alike_overlaps(overlaps: DataFrame, contigs: DataFrame, max_diff: float = 0.05) -> DataFrame:
    """Overlaps (id1, id2, length) to drop because two ends that overlap the same
    third end are nearly equal there: of each group of such ends only the one
    with the longest overlap (then smallest id) stays."""
    d = directed(overlaps.select("id1", "id2", "length"))
    best = d.groupBy("u").agg(F.max(F.struct("length", (-F.abs("v")).alias("i"), "v")).alias("b"))
    t = d.join(best, "u").where(F.col("v") != F.col("b.v"))
    text = contigs.select((F.col("contig_id") + 1).alias("c"), "seq")
    from ..functions.bases import revcomp
    t = t.withColumn("c", F.abs("v")).join(text, "c").drop("c").withColumnRenamed("seq", "s1").withColumn("c", F.abs("b.v")).join(text, "c").drop("c")
    s1 = F.when(F.col("v") > 0, F.col("s1")).otherwise(revcomp("s1"))
    s2 = F.when(F.col("b.v") > 0, F.col("seq")).otherwise(revcomp("seq"))
    n = F.least(F.length("s1"), F.length("seq"))
    near = F.levenshtein(F.left(s1, n), F.left(s2, n)) <= F.floor(n * max_diff)
    from .overlap import canonical_pair
    return t.where(near).select(canonical_pair("u", "v").alias("p")).select("p.*").distinct()


def classified(nodes: DataFrame, bubble_counts: DataFrame, average: float) -> DataFrame:
    """Homozygous when bubbles lie on the node or its coverage reaches the average."""
    return nodes.join(bubble_counts, "node", "left").na.fill(0, ["bubbles"]).select(
        "node", ((F.col("bubbles") >= 1) | (F.col("cov") >= average)).alias("homo"))


def opposite_nodes(parts: DataFrame, opposite: DataFrame) -> DataFrame:
    """Partner of each node: the signed node that holds the largest total length
    of the opposite contigs of its parts. parts: (node, contig signed, len);
    opposite: (contig, opposite signed)."""
    home = parts.select(F.abs("contig").alias("c"), (F.signum("contig").cast("bigint") * F.col("node")).alias("home"))
    once = home.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("home").alias("home")).where("n = 1").select("c", "home")
    t = parts.withColumn("c", F.abs("contig")).join(opposite.withColumnRenamed("contig", "c"), "c").select(
        "node", "len", (F.signum("contig").cast("bigint") * F.col("opposite")).alias("o"))
    t = t.withColumn("c", F.abs("o")).join(once, "c").select("node", "len", (F.signum("o").cast("bigint") * F.col("home")).alias("partner"))
    w = t.where("abs(partner) <> node").groupBy("node", "partner").agg(F.sum("len").alias("l"))
    return w.groupBy("node").agg(F.max(F.struct("l", (-F.abs("partner")).alias("i"), "partner")).alias("b")).select("node", F.col("b.partner").alias("opposite"))


def node_clusters(parts: DataFrame, clusters: DataFrame) -> DataFrame:
    """First cluster other than 0 among the parts in order: (node, cluster)."""
    t = parts.withColumn("c", F.abs("contig")).join(clusters.select(F.col("contig").alias("c"), "cluster"), "c", "left").na.fill(0, ["cluster"])
    g = t.groupBy("node").agg(F.min(F.when(F.col("cluster") != 0, F.struct("idx", "cluster"))).alias("f"))
    return g.select("node", F.coalesce("f.cluster", F.lit(0)).alias("cluster"))


def placed_once(parts: DataFrame) -> DataFrame:
    """Home of the contigs that are placed exactly once: (contig, node, idx)."""
    return parts.groupBy(F.abs("contig").alias("contig")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "idx")).alias("p")).where(
        "n = 1").select("contig", "p.node", "p.idx")


def node_coverage(parts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Length-weighted coverage over the uniquely placed parts, over all parts
    when there are none. coverage: (contig, len, cov)."""
    once = placed_once(parts).select("contig", F.lit(True).alias("once"))
    t = parts.select("node", F.abs("contig").alias("contig")).join(coverage, "contig").join(once, "contig", "left")
    u = F.col("once").isNotNull()
    total = lambda c, x: F.sum(F.when(c, x))
    m = F.col("cov") * F.col("len")
    return t.groupBy("node").agg((F.coalesce(total(u, m), F.sum(m)) / F.coalesce(total(u, F.col("len")), F.sum("len"))).alias("cov"))


def bounded_paths(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, tolerance: int) -> DataFrame:
    """Unique ways along overlap edges between linked nodes: (id1, id2, path).

    A frontier of all searches moves one edge per round; a node is entered once
    per search, by the shortest way of the round, and never beyond the link's
    gap + tolerance. Nodes that are entered in several ways of a round make the
    way to the target ambiguous, which drops the pair.
    """
    step = materialize(directed(edges.select("id1", "id2", "gap")).join(nodes.select(F.col("node").alias("_n"), "len"), F.abs("v") == F.col("_n")).select(
        "u", "v", (F.col("gap") + F.col("len")).alias("add")), "path-steps")
    front = materialize(pairs.select("id1", "id2", F.col("gap").alias("limit"), F.col("id1").alias("at"),
                                     F.lit(0).cast("bigint").alias("dist"), F.array("id1").alias("path"), F.lit(False).alias("many")), "front")
    seen = front.select("id1", "id2", "at")
    found = None
    while True:
        nxt = (front.join(step, F.col("at") == F.col("u")).withColumn("dist", F.col("dist") + F.col("add"))
               .where(F.col("dist") - F.col("add") <= F.col("limit") + tolerance)
               .select("id1", "id2", "limit", F.col("v").alias("at"), "dist", "path", "many"))
        one = nxt.groupBy("id1", "id2", "limit", "at").agg(
            F.min(F.struct("dist", "path")).alias("b"), (F.bool_or("many") | (F.count(F.lit(1)) > 1)).alias("many"))
        new = one.join(seen, ["id1", "id2", "at"], "left_anti")
        front = materialize(new.select("id1", "id2", "limit", "at", "b.dist", F.concat("b.path", F.array("at")).alias("path"), "many"), "front")
        hit = front.where("at = id2")
        found = hit if found is None else found.unionByName(hit)
        seen = seen.unionByName(front.select("id1", "id2", "at"))
        front = front.where("at <> id2")
        if is_empty(front):
            break
    return found.where(~F.col("many")).select("id1", "id2", "path", "dist")


def grow_layouts(nodes: DataFrame, edges: DataFrame, tolerance: int) -> DataFrame:
    """Scaffolds by growth: (scaffold, node signed, start, end).

    Every scaffold starts as one node. In each round each scaffold proposes its
    best joint: the edge from one of its nodes to a node of another scaffold
    with most links (then the smallest gap and ids) among those that keep all
    intervals apart beyond the tolerance and do not mix clusters. Joints that
    are best for both sides are made, coordinates are shifted (and turned) into
    those of the smaller scaffold, and rounds go on until nothing joins.
    Repeat nodes (``repeat``) are left out of growth and stay alone.

    The reference grows from one seed after the other; this joins everywhere at
    once. All data stay in tables: a scaffold is never gathered in one task.
    """
    use = nodes.where("not repeat")
    lay = materialize(use.select(F.col("node").alias("scaffold"), "node", F.lit(1).alias("strand"), F.lit(0).cast("bigint").alias("start"),
                                 F.col("len").cast("bigint").alias("end"), "cluster"), "layout")
    d = materialize(directed(edges.select("id1", "id2", "gap", "n_link")).where(F.abs("u") != F.abs("v")), "layout-edges")
    refused = None
    while True:
        side = lay.select("node", "scaffold", "strand", "start", "end", "cluster")
        label = lay.groupBy("scaffold").agg(F.max("cluster").alias("c"))
        a = side.select(F.col("node").alias("_a"), F.col("scaffold").alias("s1"), F.col("strand").alias("d1"), F.col("start").alias("a1"), F.col("end").alias("e1"))
        b = side.select(F.col("node").alias("_b"), F.col("scaffold").alias("s2"), F.col("strand").alias("d2"), F.col("start").alias("a2"), F.col("end").alias("e2"))
        j = (d.withColumn("_a", F.abs("u")).withColumn("_b", F.abs("v")).join(a, "_a").join(b, "_b").where("s1 < s2"))
        # u in the direction it has in s1: v then lies to its right or left
        turn = F.signum("u").cast("int") * F.col("d1")
        vdir = F.signum("v").cast("int") * turn          # strand of v in s1 coordinates
        size = F.col("e2") - F.col("a2")
        vs = F.when(turn > 0, F.col("e1") + F.col("gap")).otherwise(F.col("a1") - F.col("gap") - size)
        flip = F.when(vdir == F.col("d2"), 1).otherwise(-1)
        # s2 coordinate x becomes shift + flip * x
        shift = F.when(flip > 0, vs - F.col("a2")).otherwise(vs + F.col("e2"))
        joint = j.select("s1", "s2", flip.alias("flip"), shift.alias("shift"), "n_link", "gap").groupBy("s1", "s2", "flip", "shift").agg(
            F.sum("n_link").alias("n_link"), F.min("gap").alias("gap"))
        joint = joint.join(label.select(F.col("scaffold").alias("s1"), F.col("c").alias("c1")), "s1").join(
            label.select(F.col("scaffold").alias("s2"), F.col("c").alias("c2")), "s2").where("c1 = c2 or c1 * c2 = 0")
        if refused is not None:
            joint = joint.join(refused, ["s1", "s2", "flip", "shift"], "left_anti")
        joint = materialize(joint.select("s1", "s2", "flip", "shift", "n_link", "gap"), "joints")
        if is_empty(joint):
            break
        rank = F.struct("n_link", (-F.col("gap")).alias("g"), (-F.col("s1")).alias("x"), (-F.col("s2")).alias("y"), "flip", "shift")
        ends = joint.select(F.explode(F.array("s1", "s2")).alias("s"), rank.alias("r"))
        best = ends.groupBy("s").agg(F.max("r").alias("r"))
        pick = best.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(
            (-F.col("r.x")).alias("s1"), (-F.col("r.y")).alias("s2"), "r.flip", "r.shift")
        pick = materialize(pick, "picked")
        moved = (pick.join(lay.withColumnRenamed("scaffold", "s2"), "s2").select(
            "s1", "s2", "flip", "shift", "node", (F.col("strand") * F.col("flip")).alias("strand"),
            F.when(F.col("flip") > 0, F.col("start") + F.col("shift")).otherwise(F.col("shift") - F.col("end")).alias("start"),
            F.when(F.col("flip") > 0, F.col("end") + F.col("shift")).otherwise(F.col("shift") - F.col("start")).alias("end"), "cluster"))
        moved = materialize(moved, "moved")
        # a joint fails when a moved part lies on a part of the other scaffold
        width = max(4096, 4 * tolerance)
        bin_of = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
        mb = moved.select("s1", "s2", F.col("start").alias("ms"), F.col("end").alias("me"), bin_of("start", "end").alias("_w"))
        lb = lay.join(pick.select(F.col("s1").alias("scaffold")), "scaffold", "left_semi").select(
            F.col("scaffold").alias("s1"), "start", "end", bin_of("start", "end").alias("_w"))
        hit = mb.join(lb, ["s1", "_w"]).where((F.col("ms") < F.col("end")) & (F.col("me") > F.col("start")) & (
            F.abs(F.col("ms") - F.col("end")) > tolerance) & (F.abs(F.col("me") - F.col("start")) > tolerance))
        clash = materialize(hit.select("s1", "s2").distinct(), "clash")
        no = pick.join(clash, ["s1", "s2"], "left_semi").select("s1", "s2", "flip", "shift")
        yes = moved.join(clash, ["s1", "s2"], "left_anti")
        keep = lay.join(yes.select(F.col("s2").alias("scaffold")).distinct(), "scaffold", "left_anti")
        lay = materialize(keep.unionByName(yes.select(F.col("s1").alias("scaffold"), "node", "strand", "start", "end", "cluster")), "layout")
        # a scaffold keeps its coordinates while it exists and only gains parts,
        # so a refused joint stays refused
        refused = materialize(no if refused is None else refused.unionByName(no), "refused")
    low = lay.groupBy("scaffold").agg(F.min("start").alias("z"))
    grown = lay.join(low, "scaffold").select("scaffold", (F.col("node") * F.col("strand")).alias("node"),
                                             (F.col("start") - F.col("z")).alias("start"), (F.col("end") - F.col("z")).alias("end"))
    alone = nodes.where("repeat").select(F.col("node").alias("scaffold"), F.col("node"), F.lit(0).cast("bigint").alias("start"),
                                         F.col("len").cast("bigint").alias("end"))
    return grown.unionByName(alone)
