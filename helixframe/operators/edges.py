"""Filters on scaffold-graph edges.

An edge is stored once, as the signed pair (id1, id2) with |id1| < |id2|; its
two views from a node (``half_edges``) carry a direction. Each rule names the
edges to delete on a snapshot; ``without`` applies it as an anti join.

Rules that compare edges of one node work on classes: edges of a node side
with the same interval (gap, length) behave alike, so they collapse to one row
with their best evidence before rows meet, and classes meet only inside the
coordinate bins they share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import discard, is_empty, materialize

LINK_RATE = 0.25        # fixed values: evidence ratios of the edge rules
EXPECTED_RATE = 0.5
EXPECTED_UPPER = 4.0
SAME_TARGET_RATIO = 2.0
CONDITIONAL_CUT = 0.01
MIN_COMPOSITION_LENGTH = 10_000


def half_edges(edges: DataFrame) -> DataFrame:
    """Both views of every edge: (src, dir, dst signed, and the edge columns)."""
    s = F.signum("id1").cast("int") * F.signum("id2").cast("int")
    one = F.struct(F.abs("id1").alias("src"), F.signum("id1").cast("int").alias("dir"), (F.abs("id2") * s).alias("dst"))
    two = F.struct(F.abs("id2").alias("src"), (-F.signum("id2")).cast("int").alias("dir"), (F.abs("id1") * s).alias("dst"))
    return edges.select(F.explode(F.array(one, two)).alias("h"), *edges.columns).select("h.*", *edges.columns)


def without(edges: DataFrame, bad: DataFrame) -> DataFrame:
    return edges.join(bad.select("id1", "id2").distinct(), ["id1", "id2"], "left_anti")


def edge_order(half: DataFrame) -> DataFrame:
    """Edges of a node by direction, then target."""
    return half.orderBy("src", "dir", "dst")


def thin(edges: DataFrame, min_link: int, keep_overlap: bool = False) -> DataFrame:
    bad = F.col("n_link") < min_link
    return edges.where(bad & ~F.col("is_overlap") if keep_overlap else bad)


def longer_than(edges: DataFrame, max_gap: int) -> DataFrame:
    return edges.where(F.col("gap") > max_gap)


def _with_nodes(edges: DataFrame, nodes: DataFrame, columns) -> DataFrame:
    for i in ("1", "2"):
        side = nodes.select(F.col("node").alias("_n" + i), *[F.col(x).alias(x + i) for x in columns])
        edges = edges.withColumn("_n" + i, F.abs("id" + i)).join(side, "_n" + i).drop("_n" + i)
    return edges


def from_short_nodes(edges: DataFrame, nodes: DataFrame, cutoff: int, keep_bubbles: bool = False) -> DataFrame:
    cols = ["len", "bubble"] if keep_bubbles else ["len"]
    e = _with_nodes(edges, nodes, cols)
    short = lambda i: (F.col("len" + i) < cutoff) & (~F.col("bubble" + i) if keep_bubbles else F.lit(True))
    return e.where(short("1") | short("2"))


def from_abnormal_nodes(edges: DataFrame, nodes: DataFrame, cutoff: int, low: float, high: float) -> DataFrame:
    """Edges that touch a short node with coverage outside [low, high]."""
    e = _with_nodes(edges, nodes, ["len", "cov"])
    bad = lambda i: (F.col("len" + i) < cutoff) & ((F.col("cov" + i) < low) | (F.col("cov" + i) > high))
    return e.where(bad("1") | bad("2"))


def below_expectation(edges: DataFrame, nodes: DataFrame, library_coverage: float, average_coverage: float,
                      insert: int, sd: float, read_len: int) -> DataFrame:
    """Fewer links than half of the whole expected number at insert distance."""
    from ..functions.numeric import expected_links
    e = _with_nodes(edges, nodes, ["len", "cov"])
    cov = F.least("cov1", "cov2") * F.lit(library_coverage / average_coverage)
    x = expected_links(cov, F.col("len1"), F.col("len2"), F.lit(float(max(insert, 0))), F.lit(float(insert)), F.lit(float(sd)), F.lit(float(read_len)))
    whole = F.floor(x + 0.5)
    return e.where(F.col("n_link") < F.floor(whole / 2.0 + 0.5))


def expected_long_links(edges: DataFrame, tails: DataFrame, coverage: float) -> DataFrame:
    """Expected long-read links of an edge from the read-length tail: coverage *
    (length of reads >= gap - gap * their number) / total length. ``tails`` is
    the suffix table (len, num, total); a gap uses the next length present."""
    top = tails.agg(F.max("total").alias("t")).scalar()
    gaps = edges.select(F.greatest("gap", F.lit(0)).alias("at")).distinct().select(
        "at", F.lit(None).cast("bigint").alias("num"), F.lit(None).cast("bigint").alias("total"), F.lit(0).alias("kind"))
    known = tails.select(F.col("len").alias("at"), "num", "total", F.lit(1).alias("kind"))
    # read lengths and gaps are bounded, so this ordered table is short
    w = Window.orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    look = gaps.unionByName(known).withColumn("n", F.first("num", ignorenulls=True).over(w)).withColumn(
        "t", F.first("total", ignorenulls=True).over(w)).where("kind = 0").withColumn("_top", top)
    x = F.coalesce(F.lit(coverage) * (F.col("t") - F.col("at") * F.col("n")) / F.col("_top"), F.lit(0.0))
    return edges.withColumn("at", F.greatest("gap", F.lit(0))).join(look.select("at", x.alias("expected")), "at").drop("at")


def thin_for_long_reads(edges: DataFrame, tails: DataFrame, coverage: float, rate: float) -> DataFrame:
    e = expected_long_links(edges, tails, coverage)
    return e.where((F.col("expected") != 0) & (F.col("n_link") / F.col("expected") < rate))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def _best_rivals(tolerance: int):
    """The best rival of each class of one bin. Rivals come in blocks from the
    largest value down, and a class that has met one is done."""
    reach = max(tolerance, 0)

    def run(group: pa.Table) -> pa.Table:
        gap, size, n, v = (group[c].to_numpy() for c in ("gap", "dlen", "n", "v"))
        end = gap + size
        rank = np.argsort(v, kind="stable")[::-1]
        best, left = np.full(len(v), -1), np.arange(len(v))
        for a in range(0, len(rank), 64):
            r = rank[a:a + 64]
            hit = (end[left][:, None] - gap[r] > reach) & (end[r] - gap[left][:, None] > reach)
            hit &= (left[:, None] != r) | (n[left] > 1)[:, None]
            met = hit.any(axis=1)
            best[left[met]] = r[hit[met].argmax(axis=1)]
            left = left[~met]
            if not len(left):
                break
        found = np.flatnonzero(best >= 0)
        out = {c: group[c].take(pa.array(found)) for c in ("src", "dir", "gap", "dlen")}
        return pa.table(out | {"best": group["v"].take(pa.array(best[found]))})
    return run


def rival_best(half: DataFrame, nodes: DataFrame, tolerance: int, value: str, width: int = 2048) -> DataFrame:
    """For each node side and interval class: the largest ``value`` among the
    classes that collide with it (src, dir, gap, dlen, best).

    Two edges collide when their target intervals [gap, gap + len) overlap by
    more than the tolerance at both ends. Edges of a class collide with each
    other when the target is longer than the tolerance. Pairs of classes are
    never rows: in each bin the classes meet their rivals from the best one down.
    """
    t = half.withColumn("node", F.abs("dst")).join(nodes.select("node", F.col("len").alias("dlen")), "node")
    cls = t.groupBy("src", "dir", "gap", "dlen").agg(F.max(value).alias("v"), F.count(F.lit(1)).alias("n"))
    b = cls.select("src", "dir", "gap", "dlen", "v", "n", _bins(F.col("gap"), F.col("gap") + F.greatest("dlen", F.lit(1)), width).alias("_b"))
    best = b.groupBy("src", "dir", "_b").applyInArrow(_best_rivals(tolerance), T.StructType([
        *[T.StructField(c, cls.schema[c].dataType) for c in ("src", "dir", "gap", "dlen")], T.StructField("best", cls.schema["v"].dataType)]))
    return best.groupBy("src", "dir", "gap", "dlen").agg(F.max("best").alias("best"))


def colliding(half: DataFrame, nodes: DataFrame, tolerance: int, value: str = "n_link") -> DataFrame:
    """Half edges with the best ``value`` of a colliding rival (column best)."""
    t = half.withColumn("node", F.abs("dst")).join(nodes.select("node", F.col("len").alias("dlen")), "node").drop("node")
    return t.join(rival_best(half, nodes, tolerance, value), ["src", "dir", "gap", "dlen"])


def weak_by_rate(edges: DataFrame, nodes: DataFrame, tolerance: int, value: str = "n_link", rate: float = LINK_RATE) -> DataFrame:
    """Edges with less than ``rate`` of the evidence of a colliding edge."""
    c = colliding(half_edges(edges), nodes, tolerance, value)
    return c.where(F.col(value) < F.col("best") * rate).select("id1", "id2").distinct()


def weak_by_tags(edges: DataFrame, nodes: DataFrame, counts: DataFrame, tolerance: int) -> DataFrame:
    from .links import common_tags
    pairs = edges.select(F.abs("id1").alias("id1"), F.abs("id2").alias("id2"))
    tags = common_tags(pairs, counts).select(F.col("id1").alias("_a"), F.col("id2").alias("_b"), "common")
    e = edges.withColumn("_a", F.abs("id1")).withColumn("_b", F.abs("id2")).join(tags, ["_a", "_b"]).drop("_a", "_b")
    return weak_by_rate(materialize(e, "tag-edges"), nodes, tolerance, "common")


def weak_by_expectation(edges: DataFrame, nodes: DataFrame, tolerance: int, expected: str = "expected") -> DataFrame:
    """Of two colliding edges whose links exceed expectation at most fourfold,
    the one with fewer links and at most half the other's rate. An edge falls
    when any such rival has enough of both; rivals are compared as classes of
    (interval, links, expectation)."""
    half = half_edges(edges).withColumn("rate", F.col("n_link") / F.greatest(F.col(expected), F.lit(1.0))).where(F.col("rate") <= EXPECTED_UPPER)
    t = half.withColumn("node", F.abs("dst")).join(nodes.select("node", F.col("len").alias("dlen")), "node")
    width = 2048
    cls = t.select("src", "dir", "gap", "dlen", "n_link", "rate").distinct().withColumn(
        "_b", _bins(F.col("gap"), F.col("gap") + F.greatest("dlen", F.lit(1)), width))
    # keep per bin and interval only rivals that no other beats in both measures
    w = Window.partitionBy("src", "dir", "_b", "gap", "dlen").orderBy(F.col("n_link").desc(), F.col("rate").desc())
    top = cls.withColumn("_m", F.max("rate").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_m is null or rate > _m")
    y = top.select("src", "dir", "_b", F.col("gap").alias("g2"), F.col("dlen").alias("l2"), F.col("n_link").alias("n2"), F.col("rate").alias("r2"))
    x = cls.select("src", "dir", "_b", F.col("gap").alias("g1"), F.col("dlen").alias("l1"), F.col("n_link").alias("n1"), F.col("rate").alias("r1"))
    e1, e2 = F.col("g1") + F.col("l1"), F.col("g2") + F.col("l2")
    over = (e1 > F.col("g2")) & (e2 > F.col("g1")) & (F.abs(e1 - F.col("g2")) > tolerance) & (F.abs(e2 - F.col("g1")) > tolerance)
    lost = x.join(y, ["src", "dir", "_b"]).where(over & (F.col("n1") < F.col("n2")) & (F.col("r1") <= F.col("r2") * EXPECTED_RATE))
    lost = lost.select("src", "dir", F.col("g1").alias("gap"), F.col("l1").alias("dlen"), F.col("n1").alias("n_link"), F.col("r1").alias("rate")).distinct()
    return t.join(lost, ["src", "dir", "gap", "dlen", "n_link", "rate"], "left_semi").select("id1", "id2").distinct()


def same_target(edges: DataFrame) -> DataFrame:
    """Edges of different direction between the same two nodes: both fall when
    their links are within a factor of two, else the smaller one. A pair of
    nodes has at most four directed edges."""
    key = [F.abs("id1").alias("a"), F.abs("id2").alias("b")]
    # rows of one direction are one edge, not rivals
    g = edges.groupBy("id1", "id2").agg(F.sum("n_link").alias("n_link")).select(*key, "id1", "id2", "n_link")
    best = g.groupBy("a", "b").agg(F.sort_array(F.collect_list("n_link"), False).alias("v"), F.count(F.lit(1)).alias("m")).where("m > 1")
    t = g.join(best, ["a", "b"])
    top = F.get("v", F.lit(0))
    second = F.get("v", F.lit(1))
    mine = F.col("n_link")
    rival = F.when(mine == top, second).otherwise(top)
    close = (mine * SAME_TARGET_RATIO >= rival) & (rival * SAME_TARGET_RATIO >= mine)
    # with more than two edges any larger or close one counts; the largest suffices
    return t.where(close | (mine < rival)).select("id1", "id2")


def across_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = _with_nodes(edges, nodes, ["cluster"])
    return e.where((F.col("cluster1") != F.col("cluster2")) & (F.col("cluster1") * F.col("cluster2") != 0))


def between_species(edges: DataFrame, nodes: DataFrame, cov_dist: DataFrame, comp_dist: DataFrame,
                    min_len: int = MIN_COMPOSITION_LENGTH, bin_size: float = 0.0001, cut: float = CONDITIONAL_CUT) -> DataFrame:
    """Edges whose joint tail probability of the coverage ratio and the
    composition distance is below ``cut``; short nodes count one half for the
    composition. ``edges`` carries the distance of its two nodes."""
    from .stats import tail_probability
    e = _with_nodes(edges, nodes, ["len", "cov"]).withColumn(
        "ratio", F.greatest("cov1", "cov2") / F.least("cov1", "cov2"))
    e = tail_probability(e, "ratio", cov_dist, "p_cov", bin_size)
    e = tail_probability(e, "distance", comp_dist, "p_comp", bin_size)
    long = (F.col("len1") >= min_len) & (F.col("len2") >= min_len)
    p = F.col("p_cov") * F.when(long, F.col("p_comp")).otherwise(0.5)
    return e.withColumn("p", p).where(F.col("p") < cut)


def from_parent(edges: DataFrame, links_by_part: DataFrame, min_link: int) -> DataFrame:
    """Edges that fall below ``min_link`` once links between parts divided from
    one parent are taken off. ``links_by_part``: (id1, id2, part, n, same_parent)."""
    off = links_by_part.where("same_parent").groupBy("id1", "id2").agg(F.sum("n").alias("off"))
    return edges.join(off, ["id1", "id2"]).where(F.col("n_link") - F.col("off") < min_link)


def homozygous(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without sequence overlap unless both nodes are heterozygous."""
    e = _with_nodes(edges, nodes, ["hetero"])
    return e.where(~F.col("is_overlap") & ~(F.col("hetero1") & F.col("hetero2")))


def heterozygous_conflicts(edges: DataFrame, nodes: DataFrame, tolerance: int) -> DataFrame:
    """Edges that collide with an edge to another heterozygous node."""
    h = half_edges(edges).withColumn("node", F.abs("dst")).join(nodes.where("hetero").select("node"), "node", "left_semi").drop("node")
    return colliding(h, nodes, tolerance).select("id1", "id2").distinct()


def bubble_conflicts(edges: DataFrame, bubbles: DataFrame, rate: float = LINK_RATE) -> DataFrame:
    """Two edges of one node side to both arms of a bubble: the one with less
    than ``rate`` of the other's links falls. ``bubbles``: (node, opposite)."""
    h = half_edges(edges).withColumn("node", F.abs("dst"))
    mine = h.join(bubbles, "node")
    other = h.select("src", "dir", F.col("node").alias("opposite"), F.col("n_link").alias("n2"))
    best = other.groupBy("src", "dir", "opposite").agg(F.max("n2").alias("n2"))
    return mine.join(best, ["src", "dir", "opposite"]).where(F.col("n_link") < F.col("n2") * rate).select("id1", "id2").distinct()


def between_bubbles(edges: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Edges between arms of different bubbles, where a bubble is named by its
    smaller node; edges between the two arms of one bubble fall as well."""
    names = bubbles.select("node", F.least("node", "opposite").alias("bubble"))
    a = edges.withColumn("_a", F.abs("id1")).join(names.select(F.col("node").alias("_a"), F.col("bubble").alias("b1")), "_a")
    b = a.withColumn("_b", F.abs("id2")).join(names.select(F.col("node").alias("_b"), F.col("bubble").alias("b2")), "_b")
    return b.select("id1", "id2")


def secondary_arms(bubbles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lower arm of each bubble: less coverage, then shorter, then larger id."""
    n = nodes.select("node", "cov", "len")
    b = bubbles.join(n, "node").join(n.select(F.col("node").alias("opposite"), F.col("cov").alias("cov2"), F.col("len").alias("len2")), "opposite")
    mine, theirs = F.struct("cov", "len", (-F.col("node")).alias("i")), F.struct("cov2", "len2", (-F.col("opposite")).alias("i"))
    return b.where(mine < theirs).select("node").distinct()


def weak_branches(edges: DataFrame, nodes: DataFrame, max_len: int, max_cov: float) -> DataFrame:
    """Short low-coverage nodes with edges on at most one side."""
    sides = half_edges(edges).groupBy(F.col("src").alias("node")).agg(F.count_distinct("dir").alias("sides"))
    n = nodes.join(sides, "node", "left").na.fill(0, ["sides"])
    return n.where((F.col("len") < max_len) & (F.col("cov") < max_cov) & (F.col("sides") < 2)).select("node")


def of_nodes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges that touch any of the nodes."""
    n = names.select("node").distinct()
    a = edges.withColumn("node", F.abs("id1")).join(n, "node", "left_semi").select("id1", "id2")
    b = edges.withColumn("node", F.abs("id2")).join(n, "node", "left_semi").select("id1", "id2")
    return a.unionByName(b).distinct()


def repeats(edges: DataFrame, nodes: DataFrame, tolerance: int, parts: str | None = None, average: float | None = None) -> DataFrame:
    """Nodes with two colliding edges on one side; given the average coverage,
    also single-part nodes above 1.5 times of it."""
    c = colliding(half_edges(edges), nodes, tolerance).select(F.col("src").alias("node")).distinct()
    if average is not None and parts:
        c = c.unionByName(nodes.where((F.col(parts) == 1) & (F.col("cov") > 1.5 * average)).select("node")).distinct()
    return c


def _sides(half: DataFrame, parts: DataFrame) -> DataFrame:
    """Links of each half edge on the parts of its node: (src, dir, dst, id1, id2, part, n)."""
    side = F.when(F.col("src") == F.abs("id1"), 1).otherwise(2)
    return half.withColumn("side", side).join(parts, ["id1", "id2", "side"]).select("src", "dir", "dst", "id1", "id2", "part", "n")


def last_collision(half: DataFrame, nodes: DataFrame, tolerance: int, bubbles: DataFrame | None = None) -> DataFrame:
    """The last colliding pair of edges of each node, pairs in the order of their
    first and then their second edge: (src, first, second), structs of (dir, dst).
    Edges to the two arms of a bubble (``bubbles``: node, opposite) collide too.
    The last partner of an edge is a maximum over its rivals' classes, so pairs are
    never formed."""
    key = lambda d, x: F.struct(F.col(d).alias("dir"), F.col(x).alias("dst"))
    pairs = colliding(half, nodes, tolerance, "dst").where("best > dst").select("src", key("dir", "dst").alias("first"), key("dir", "best").alias("second"))
    if bubbles is not None:
        arms = half.withColumn("node", F.abs("dst")).join(bubbles, "node").select("src", F.col("opposite").alias("other"), key("dir", "dst").alias("second"))
        pairs = pairs.unionByName(half.select("src", F.abs("dst").alias("other"), key("dir", "dst").alias("first")).join(arms, ["src", "other"])
                                  .where(F.col("first") < F.col("second")).drop("other"))
    return pairs.groupBy("src").agg(F.max(F.struct("first", "second")).alias("p")).select("src", "p.*")


def repeat_edge_links(edges: DataFrame, parts: DataFrame, nodes: DataFrame, tolerance: int, min_link: int, bubbles: DataFrame | None = None) -> DataFrame:
    """Edges of multi-part nodes that fall below ``min_link`` when colliding edges
    have taken the links that they share on a part off all edges of the node, pair
    after pair. ``parts``: (id1, id2, side, part, n).

    A pair subtracts the smaller of its two counts, as they stand by then, from
    every edge. With s the sum taken off so far, that is min(n1, n2) - s, and the
    new sum is min(n1, n2): whatever came before, the sum after a pair is the
    smaller of its two first counts. So the last pair of a node decides, and the
    scan needs no order of execution."""
    view = half_edges(edges)
    last = last_collision(view, nodes, tolerance, bubbles)
    per = _sides(view, parts)
    counts = lambda which: last.select("src", f"{which}.dir", f"{which}.dst").join(per, ["src", "dir", "dst"]).select("src", "part", F.col("n").alias(which))
    loss = counts("first").join(counts("second"), ["src", "part"]).groupBy("src").agg(F.sum(F.least("first", "second")).alias("loss"))
    left = F.col("n_link") - F.coalesce("loss", F.lit(0))
    return view.join(loss, "src", "left").where(left < min_link).select("id1", "id2").distinct()


def repeat_parts(edges: DataFrame, parts: DataFrame, nodes: DataFrame, tolerance: int, min_link: int) -> tuple[DataFrame, DataFrame]:
    """Parts (src, part) on which two colliding edges of a node have ``min_link``
    links each, and the edges (id1, id2) that fall below ``min_link`` when all links
    on such parts are taken off. A part is cleared for all edges at once, so no
    pair of it counts again and the order does not matter."""
    view = half_edges(edges)
    per = _sides(view, parts)
    strong = view.join(per.where(F.col("n") >= min_link).select("src", "dir", "dst", "part"), ["src", "dir", "dst"])
    # the part number joins the node side, so rivals are those of that part
    hit = colliding(strong.withColumn("dir", F.col("dir") * (F.col("part") + 1)), nodes, tolerance)
    cleared = materialize(hit.select("src", "part").distinct(), "cleared-parts")
    loss = per.join(cleared, ["src", "part"]).groupBy("src", "dir", "dst").agg(F.sum("n").alias("loss"))
    left = F.col("n_link") - F.coalesce("loss", F.lit(0))
    return cleared, view.join(loss, ["src", "dir", "dst"], "left").where(left < min_link).select("id1", "id2").distinct()


def until_stable(edges: DataFrame, rule) -> DataFrame:
    """Apply a rule (edges -> edges to delete) until it names none."""
    edges = materialize(edges, "edges")
    while True:
        bad = materialize(rule(edges).select("id1", "id2").distinct(), "bad-edges")
        if is_empty(bad):
            return edges
        before, edges = edges, materialize(without(edges, bad), "edges")
        discard(before)
        discard(bad)
