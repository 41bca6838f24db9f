"""Evidence for edges: links from pairs, long reads and barcodes.

Links are reduced to distinct (pair, gap) rows before anything is ordered, so
a pair of nodes with any number of links stays a short group. Reads and barcodes
of few nodes are opened into their pairs, a bounded number of rows for each row
given. Pairs that need support from larger ones are found by prefix filtering:
with support c, two nodes must also meet outside the c-1 most populous groups of
each, so the largest groups never have to be expanded into all their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import is_empty, materialize
from .overlap import canonical_pair
from .skew import lagged, ordered_blocks, running_sum

SESSION_GAP = 10_000        # fixed values: barcode sessions and molecules
DEFAULT_MOLECULE = 50_000
MIN_MOLECULES = 20
SMALL_GROUP = 32            # nodes of a group that is opened into its pairs


def lift(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """Contig coordinates to node coordinates: flip on the minus strand and add
    the start of the part. Contigs placed more than once are dropped.

    hits: (.., id signed, offset); parts: (node, idx, contig signed, start, end).
    """
    once = parts.groupBy(F.abs("contig").alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("node", "idx", "contig", "start", "end")).alias("_p")).where("_n = 1").select("_c", "_p")
    j = hits.withColumn("_c", F.abs("id")).join(once, "_c")
    plus = F.col("_p.contig") > 0
    size = F.col("_p.end") - F.col("_p.start")
    off = F.when(plus, F.col("offset")).otherwise(size - F.col("offset") - 1) + F.col("_p.start")
    nid = F.signum("id").cast("int") * F.when(plus, F.col("_p.node")).otherwise(-F.col("_p.node"))
    return j.withColumn("id", nid).withColumn("offset", off).withColumn("idx", F.col("_p.idx")).drop("_c", "_p")


def merge_links(links: DataFrame, min_link: int, keys: Sequence[str] = ("id1", "id2")) -> DataFrame:
    """Links to edges: number, summed score, middle gap and overlap mark; kept
    with at least ``min_link`` links or an overlap. Overlap rows do not count; an
    edge with one has the overlap's gap (the largest of several) and score 0."""
    keys = list(keys)
    has = "is_overlap" in links.columns
    flag = F.col("is_overlap") if has else F.lit(False)
    per = links.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.bool_or(flag).alias("o"))
    w = Window.partitionBy(*keys).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("cum", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    half = F.floor(F.col("all") / 2)
    odd = F.col("all") % 2 == 1
    edge = run.groupBy(*keys).agg(
        F.max("all").alias("n_link"), F.when(F.bool_or("o"), F.lit(0)).otherwise(F.sum("s")).cast("bigint").alias("score"), F.bool_or("o").alias("is_overlap"),
        F.max(F.when(F.col("o"), F.col("gap"))).alias("_og"),
        F.min(F.when(F.col("cum") > half, F.col("gap"))).alias("_hi"),
        F.min(F.when(F.col("cum") >= half, F.col("gap"))).alias("_lo"))
    total = (F.col("_hi") + F.col("_lo")).cast("bigint")
    halved = F.when(total >= 0, F.floor(total / 2)).otherwise(F.ceil(total / 2))
    odd = F.col("n_link") % 2 == 1
    mid = F.when(odd, F.col("_hi")).otherwise(F.when(halved >= 0, halved).otherwise(F.ceil(halved + 0.5))).cast("bigint")
    return (edge.where((F.col("n_link") >= min_link) | F.col("is_overlap"))
            .select(*keys, (F.col("n_link") - F.when(F.col("is_overlap"), 1).otherwise(0)).cast("bigint").alias("n_link"),
                    "score", F.coalesce("_og", mid).cast("bigint").alias("gap"), "is_overlap"))


def average_gap(links: DataFrame, min_link: int) -> DataFrame:
    """Edges with the mean gap instead of the middle one."""
    return links.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n_link"), F.avg("gap").alias("gap")).where(
        F.col("n_link") >= min_link)


def breakdown(links: DataFrame) -> DataFrame:
    """Number of links per part of either node: (id1, id2, side, part, n)."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("off1").alias("part")),
                             F.struct(F.lit(2).alias("side"), F.col("off2").alias("part"))))
    return links.select("id1", "id2", side.alias("x")).groupBy("id1", "id2", "x.side", "x.part").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(rows: DataFrame, min_reads: int = 1) -> DataFrame:
    """Reads per (tag, node), from ``min_reads`` on."""
    t = rows.groupBy("tag", "node").agg(F.count(F.lit(1)).alias("n"))
    return t.where(F.col("n") >= min_reads) if min_reads > 1 else t


def tag_counts_by_scaffold(counts: DataFrame, parts: DataFrame, min_reads: int) -> DataFrame:
    """Counts per contig summed to scaffolds: parts is (scaffold, node)."""
    return (counts.join(parts, "node").groupBy("tag", "scaffold").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_reads))


def _by_size(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts of groups of up to ``SMALL_GROUP`` nodes and those of the larger ones."""
    size = counts.groupBy("tag").agg(F.count(F.lit(1)).alias("size"))
    sized = materialize(counts.select("tag", "node", "n").join(size, "tag"), "sized-groups")
    return sized.where(F.col("size") <= SMALL_GROUP), sized.where(F.col("size") > SMALL_GROUP)


def _in_small_groups(small: DataFrame) -> DataFrame:
    """Sum of min(n1, n2) for all pairs that meet in a small group: (lo, hi, c), lo < hi."""
    a = small.select("tag", F.col("node").alias("lo"), F.col("n").alias("na"))
    b = small.select("tag", F.col("node").alias("hi"), F.col("n").alias("nb"))
    return a.join(b, "tag").where("lo < hi").groupBy("lo", "hi").agg(F.sum(F.least("na", "nb")).cast("bigint").alias("c"))


def _in_large_groups(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """The same sum over large groups, for given pairs (lo, hi) that meet in one.

    Each pair is opened from the node with fewer groups and meets the other node
    by (node, tag), which is unique there: the work is bounded by the smaller
    side of every pair, and a tag that covers all nodes makes no pairs.
    """
    deg = large.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    d = (pairs.select("lo", "hi").join(deg.select(F.col("node").alias("lo"), F.col("d").alias("d1")), "lo")
         .join(deg.select(F.col("node").alias("hi"), F.col("d").alias("d2")), "hi"))
    first = F.col("d1") <= F.col("d2")
    d = d.select("lo", "hi", F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("few"),
                 F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("many"))
    a = d.join(large.select(F.col("node").alias("few"), "tag", F.col("n").alias("na")), "few")
    b = a.join(large.select(F.col("node").alias("many"), "tag", F.col("n").alias("nb")), ["many", "tag"])
    return b.groupBy("lo", "hi").agg(F.sum(F.least("na", "nb")).cast("bigint").alias("c"))


def common_tags(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum over tags of min(n1, n2) for given pairs of different nodes (0 when none).

    Tags of few nodes are opened into their pairs, whatever the number of pairs
    asked for; only for the tags of more nodes are the pairs opened.
    """
    p = pairs.select("id1", "id2").distinct()
    keyed = p.withColumn("lo", F.least("id1", "id2")).withColumn("hi", F.greatest("id1", "id2"))
    small, large = _by_size(counts)
    s = _in_small_groups(small)
    if not is_empty(large):
        keyed = materialize(keyed, "asked-pairs")
        s = s.unionByName(_in_large_groups(keyed.select("lo", "hi").distinct(), large)).groupBy("lo", "hi").agg(F.sum("c").alias("c"))
    return keyed.join(s, ["lo", "hi"], "left").select("id1", "id2", F.coalesce("c", F.lit(0)).cast("bigint").alias("common"))


def co_occurring(incidence: DataFrame, group: str, item: str, support: int) -> DataFrame:
    """Pairs (id1 < id2) of items that share at least ``support`` groups, with
    the number of shared groups. With a support of 1 the result itself is all
    pairs of every group: only for groups of bounded size, such as a read."""
    ones = incidence.select(F.col(group).alias("tag"), F.col(item).alias("node")).distinct().withColumn("n", F.lit(1))
    small, large = _by_size(ones)
    met = _in_small_groups(small)
    if not is_empty(large):
        met = materialize(met, "small-groups")
        # rank of a group among the large ones of the item, most populous first; an
        # item keeps the (support - 1) best rows to leave out by repeated maximum
        skip = large
        drop = None
        for _ in range(max(support, 1) - 1):
            top = skip.groupBy("node").agg(F.max(F.struct("size", "tag")).alias("t")).select("node", F.col("t.tag").alias("tag"))
            drop = top if drop is None else drop.unionByName(top)
            skip = large.join(drop, ["node", "tag"], "left_anti")
        prefix = materialize(skip.select("tag", "node"), "prefix")
        cand = (prefix.withColumnRenamed("node", "lo").join(prefix.withColumnRenamed("node", "hi"), "tag")
                .where("lo < hi").select("lo", "hi").distinct())
        # pairs that also meet in small groups may need fewer large ones
        asked = materialize(cand.unionByName(met.select("lo", "hi")).distinct(), "asked-pairs")
        met = met.unionByName(_in_large_groups(asked, large)).groupBy("lo", "hi").agg(F.sum("c").alias("c"))
    return met.where(F.col("c") >= support).select(F.col("lo").alias("id1"), F.col("hi").alias("id2"), F.col("c").alias("common"))


def merged_hits(hits: DataFrame) -> DataFrame:
    """Hits of a read on one node: best-scoring place, summed score."""
    return hits.groupBy("read_id", "node").agg(
        F.max(F.struct("score", (-F.col("q_start")).alias("_q"), "q_start", "q_end", "t_start")).alias("b"),
        F.sum("score").cast("bigint").alias("score")).select("read_id", "node", "b.q_start", "b.q_end", "b.t_start", "score")


def long_read_links(hits: DataFrame, lengths: DataFrame, min_link: int, tolerance: int) -> DataFrame:
    """Links between nodes that reads pass one after the other, one per read and
    pair, for pairs with at least ``min_link`` reads in common.

    A negative node is met on its reverse strand; its start counts from the
    other end then. Ids keep that sign. A node's extent in read coordinates is
    [q_start - t_start, + len); extents must follow each other on both ends,
    gaps below -tolerance are refused.
    """
    m = materialize(merged_hits(hits).withColumn("_n", F.abs("node")), "merged-hits")
    pairs = materialize(co_occurring(m, "read_id", "_n", min_link).select("id1", "id2"), "read-pairs")
    turned = F.col("len") - F.col("t_start") - (F.col("q_end") - F.col("q_start"))
    left = F.col("q_start") - F.when(F.col("node") >= 0, F.col("t_start")).otherwise(turned)
    ext = m.join(lengths.withColumnRenamed("node", "_n"), "_n").select("read_id", "_n", "node", left.alias("l"), (left + F.col("len") - 1).alias("r"), "score")
    a = ext.select("read_id", F.col("_n").alias("id1"), F.col("node").alias("n1"), F.col("l").alias("l1"), F.col("r").alias("r1"), F.col("score").alias("s1"))
    b = ext.select("read_id", F.col("_n").alias("id2"), F.col("node").alias("n2"), F.col("l").alias("l2"), F.col("r").alias("r2"), F.col("score").alias("s2"))
    j = pairs.join(a, "id1").join(b, ["id2", "read_id"])
    ahead = (F.col("l1") <= F.col("l2")) & (F.col("r1") <= F.col("r2"))
    behind = (F.col("l1") > F.col("l2")) & (F.col("r2") <= F.col("r1"))
    gap = F.when(ahead, F.col("l2") - F.col("r1") - 1).otherwise(F.col("l1") - F.col("r2") - 1)
    return (j.where(ahead | behind).withColumn("gap", gap).where(F.col("gap") >= -tolerance)
            .select("read_id", F.col("n1").alias("id1"), F.col("n2").alias("id2"), F.when(ahead, 1).otherwise(-1).alias("direction"), "gap",
                    (F.col("s1") + F.col("s2")).alias("score")))


def sessions(rows: DataFrame, gap: int = SESSION_GAP, min_reads: int = 1) -> DataFrame:
    """Stretches of (tag, node) positions without a step above ``gap``: first
    and last position and number of reads. Equal positions collapse first; the
    rest runs over range-partitioned blocks, so a tag of any size is spread."""
    at = rows.groupBy("tag", "node", "pos").agg(F.count(F.lit(1)).alias("n"))
    keys = ["tag", "node"]
    blocks = ordered_blocks(at, keys, ["pos"], "sessions")
    step = lagged(blocks, keys, ["pos"], {"pos": "_p"})
    marked = step.withColumn("_new", F.when(F.col("_p").isNull() | (F.col("pos") - F.col("_p") > gap), 1).otherwise(0)).drop("_p")
    numbered = running_sum(marked, keys, ["pos"], "_new", "session")
    out = numbered.groupBy(*keys, "session").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("n").alias("n"))
    return out.where(F.col("n") >= min_reads)


def molecule_length(spans: DataFrame, min_number: int = MIN_MOLECULES, default: int = DEFAULT_MOLECULE) -> DataFrame:
    """Length-weighted mean of session spans, a default when there are few."""
    d = (F.col("last") - F.col("first")).cast("double")
    return spans.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= min_number, F.sum(d * d) / F.nullif(F.sum(d), F.lit(0.0)))
                     .otherwise(F.lit(float(default))).alias("mean"))


def barcode_links(spans: DataFrame, lengths: DataFrame, reach: int, support: int) -> DataFrame:
    """Links between node ends that the same barcodes reach: a session whose
    first (last) position lies within ``reach`` of the node start (end) marks
    that end; ends of different nodes with ``support`` common tags are linked.
    The end is coded in the sign of the node id."""
    pairs = co_occurring(barcode_ends(spans, lengths, reach), "tag", "end", support).where(F.abs("id1") != F.abs("id2"))
    turned = pairs.select(canonical_pair("id1", -F.col("id2")).alias("p"), F.col("common").alias("n_link"))
    return turned.select("p.id1", "p.id2", "n_link")


def barcode_ends(spans: DataFrame, lengths: DataFrame, reach: int) -> DataFrame:
    """(tag, end): ends that a session of the barcode reaches, the start of a
    node as its negative id."""
    s = spans.join(lengths, "node")
    return s.select("tag", F.explode(F.array_compact(F.array(
        F.when(F.col("first") <= reach, -F.col("node")), F.when(F.col("len") - F.col("last") <= reach, F.col("node"))))).alias("end"))


def lift_hits(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """Long-read hits on contigs as hits on nodes: both ends of the hit move."""
    first = hits.select("*", F.col("node").alias("id"), F.col("t_start").alias("offset"))
    last = F.col("t_start") + F.greatest(F.col("q_end") - F.col("q_start"), F.lit(1)) - 1
    moved = lift(first, parts).drop("idx").withColumnsRenamed({"id": "_id1", "offset": "_o1"})
    both = lift(moved.select("*", F.col("node").alias("id"), last.alias("offset")), parts)
    return both.select("read_id", F.col("id").alias("node"), "q_start", "q_end", F.least("_o1", "offset").alias("t_start"), "score")


def lift_barcodes(barcodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Barcode positions on contigs as positions on nodes."""
    moved = lift(barcodes.select("tag", F.col("node").alias("id"), F.col("pos").alias("offset")), parts)
    return moved.select("tag", F.abs("id").alias("node"), F.col("offset").alias("pos"))


def pooled_links(rows: DataFrame | None, ends: DataFrame | None, min_link: int) -> DataFrame:
    """Edges from all evidence at once: links of pairs, reads and overlaps (id1,
    id2, gap, score) plus the barcodes that the two facing ends share, one row
    per edge and one threshold. Common barcodes are counted for every pair that
    other evidence names; pairs that only barcodes name need at least two."""
    edges = None
    if rows is not None:
        pair = canonical_pair("id1", "id2")
        rows = rows.withColumn("_p", pair).withColumn("id1", F.col("_p.id1")).withColumn("id2", F.col("_p.id2")).drop("_p")
        edges = merge_links(rows, 1)
    if ends is None:
        return edges.where((F.col("n_link") >= min_link) | F.col("is_overlap"))
    ends = materialize(ends.distinct(), "ends")
    alone = co_occurring(ends, "tag", "end", max(min_link, 2)).where(F.abs("id1") != F.abs("id2"))
    alone = alone.select(canonical_pair("id1", -F.col("id2")).alias("p"), F.col("common")).select("p.id1", "p.id2", "common")
    if edges is not None:
        edges = materialize(edges, "evidence")
        counts = ends.select("tag", F.col("end").alias("node"), F.lit(1).alias("n"))
        named = common_tags(edges.select("id1", (-F.col("id2")).alias("id2")), counts).select("id1", (-F.col("id2")).alias("id2"), "common")
        new = alone.join(edges.select("id1", "id2"), ["id1", "id2"], "left_anti")
        told = edges.join(named, ["id1", "id2"], "left").na.fill(0, ["common"])
        told = told.select("id1", "id2", (F.col("n_link") + F.col("common")).alias("n_link"), (F.col("score") + F.col("common")).alias("score"), "gap", "is_overlap")
    else:
        new, told = alone, None
    tagged = new.select("id1", "id2", F.col("common").alias("n_link"), F.col("common").alias("score"), F.lit(0).cast("bigint").alias("gap"), F.lit(False).alias("is_overlap"))
    return (tagged if told is None else told.unionByName(tagged)).where((F.col("n_link") >= min_link) | F.col("is_overlap"))


def evidence(mode: set, sources: dict[str, DataFrame]) -> DataFrame:
    """Union of the link sources that a mode names (overlap, pair, long, tag)."""
    parts = [sources[m] for m in ("overlap", "pair", "long", "tag") if m in mode and m in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def alignment_filter(hits: DataFrame, identity: float = 0.8, coverage: float = 0.8, min_len: int = 200) -> DataFrame:
    """Identity and length test of an alignment; the aligned length is the
    longer of the two spans."""
    aln = F.greatest(F.col("q_end") - F.col("q_start"), F.col("t_end") - F.col("t_start"))
    return hits.where((F.col("match") >= aln * identity) & (
        (aln >= min_len) | (aln >= F.least("q_len", "t_len") * coverage)))


def span_ratio(hits: DataFrame) -> DataFrame:
    return hits.agg((F.sum(F.col("q_end") - F.col("q_start")) / F.sum(F.col("t_end") - F.col("t_start"))).alias("ratio"))


def suppress_unique(hits: DataFrame, tolerance: int) -> DataFrame:
    """Per read: an alignment goes when it overlaps a better one by more than
    ``tolerance``, and the better one goes too when twice the lower score is
    above the higher. Overlaps are found inside coordinate bins of a read, so
    a read with very many alignments does not form all pairs."""
    pairs = _overlapping(hits, tolerance)
    worse = pairs.select(F.col("hit_b").alias("hit"))
    both = pairs.where(F.col("score_b") * 2 > F.col("score_a")).select(F.col("hit_a").alias("hit"))
    return hits.join(worse.unionByName(both).distinct(), "hit", "left_anti")


def _overlapping(hits: DataFrame, tolerance: int, width: int = 512) -> DataFrame:
    """Pairs (a better than b) of alignments of a read that overlap by more than
    ``tolerance``; the better has (score, span) larger, then the smaller id."""
    span = F.col("q_end") - F.col("q_start")
    b = hits.select("read_id", "hit", "q_start", "q_end", "score", span.alias("span"),
                    F.explode(F.sequence(F.floor(F.col("q_start") / width), F.floor((F.col("q_end") - 1) / width))).alias("bin"))
    left = b.select("read_id", "bin", *[F.col(x).alias(x + "_a") for x in ("hit", "q_start", "q_end", "score", "span")])
    right = b.select("read_id", "bin", *[F.col(x).alias(x + "_b") for x in ("hit", "q_start", "q_end", "score", "span")])
    j = left.join(right, ["read_id", "bin"])
    better = F.struct("score_a", "span_a", (-F.col("hit_a")).alias("h")) > F.struct("score_b", "span_b", (-F.col("hit_b")).alias("h"))
    over = F.least("q_end_a", "q_end_b") - F.greatest("q_start_a", "q_start_b")
    return j.where(better & (over > tolerance)).select("read_id", "hit_a", "hit_b", "score_a", "score_b").distinct()


def suppress_greedy(hits: DataFrame, tolerance: int) -> DataFrame:
    """Best-first choice per read: keep the best alignment, drop what overlaps a
    kept one, go on. In rounds over all reads at once: an alignment without a
    better undecided rival is kept, its rivals are dropped."""
    rivals = materialize(_overlapping(hits, tolerance).select("hit_a", "hit_b"), "rivals")
    kept = hits.select("hit").join(rivals.select(F.col("hit_b").alias("hit")).distinct(), "hit", "left_anti")
    while True:
        if is_empty(rivals):
            break
        # winners: better side of an open rivalry that nobody better opposes
        win = rivals.select(F.col("hit_a").alias("hit")).distinct().join(
            rivals.select(F.col("hit_b").alias("hit")).distinct(), "hit", "left_anti")
        lost = materialize(rivals.join(win.withColumnRenamed("hit", "hit_a"), "hit_a", "left_semi").select(
            F.col("hit_b").alias("hit")).distinct(), "lost")
        left = rivals.join(lost.withColumnRenamed("hit", "hit_a"), "hit_a", "left_anti").join(
            lost.withColumnRenamed("hit", "hit_b"), "hit_b", "left_anti")
        left = materialize(left, "rivals")
        # beaten ones are out; those whose better rivals are all out come in
        freed = (rivals.select(F.col("hit_b").alias("hit")).distinct().join(lost, "hit", "left_anti")
                 .join(left.select(F.col("hit_b").alias("hit")), "hit", "left_anti"))
        kept = materialize(kept.unionByName(freed), "kept")
        rivals = left
    return hits.join(kept, "hit", "left_semi")
