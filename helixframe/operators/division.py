"""Dividing scaffolds: evidence counters per inner boundary, break rules and
the applier.

Parts are rows (node, idx, contig signed, start, end); a break (node, idx)
stands before part idx. Neighbour values and segment numbers come from
range-partitioned blocks, so a node with very many parts is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import is_empty, materialize
from .skew import lagged, ordered_blocks, running_sum


def with_previous(parts: DataFrame) -> DataFrame:
    """Parts with the part before (p_contig, p_start, p_end), first parts left out."""
    blocks = ordered_blocks(parts.select("node", "idx", "contig", "start", "end"), ["node"], ["idx"], "parts")
    t = lagged(blocks, ["node"], ["idx"], {"contig": "p_contig", "start": "p_start", "end": "p_end"})
    return t.where("p_end is not null").drop("_blk")


def gap_breaks(parts: DataFrame, min_gap: int) -> DataFrame:
    return with_previous(parts).where(F.col("start") - F.col("p_end") > min_gap).select("node", "idx")


def sparse_end_breaks(parts: DataFrame) -> DataFrame:
    """The first or last part goes when its gap is longer than the part itself."""
    last = parts.groupBy("node").agg(F.max("idx").alias("last"))
    t = with_previous(parts).join(last, "node").withColumn("gap", F.col("start") - F.col("p_end"))
    first = (F.col("idx") == 1) & (F.col("gap") > F.col("p_end") - F.col("p_start"))
    end = (F.col("idx") == F.col("last")) & (F.col("gap") > F.col("end") - F.col("start"))
    return t.where(first | end).select("node", "idx")


def repeat_end_breaks(parts: DataFrame) -> DataFrame:
    """Breaks around the stretch between the first and last part used once."""
    used = parts.groupBy(F.abs("contig").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("c")
    t = parts.withColumn("c", F.abs("contig")).join(used, "c", "left_semi")
    g = t.groupBy("node").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    size = parts.groupBy("node").agg(F.max("idx").alias("last"))
    x = g.join(size, "node").select("node", "last", F.explode(F.array(F.col("a"), F.when(F.col("b") > 0, F.col("b") + 1).otherwise(F.lit(0)))).alias("idx"))
    return x.where("idx > 0 and idx <= last").select("node", "idx").distinct()


def cluster_breaks(parts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Where the cluster label changes (0 has no say): before the part with the
    new label and after the last part with the old one."""
    t = parts.join(clusters.select(F.col("contig").alias("c"), "cluster"), F.abs("contig") == F.col("c"), "left").na.fill(0, ["cluster"])
    # the first part opens with its label even when that is 0
    voice = t.where("cluster <> 0 or idx = 0").select("node", "idx", "cluster")
    b = lagged(ordered_blocks(voice, ["node"], ["idx"], "labels"), ["node"], ["idx"], {"cluster": "p_cluster", "idx": "p_idx"})
    hit = b.where("p_idx is not null and cluster <> 0 and cluster <> p_cluster")
    return hit.select("node", F.explode(F.array(F.col("p_idx") + 1, F.col("idx"))).alias("idx")).distinct()


def label_breaks(labels: DataFrame) -> DataFrame:
    """Where the label of a part differs from that of the part before: labels is
    (node, idx, label). Serves haplotype, opposite-arm and boundary labels."""
    b = lagged(ordered_blocks(labels, ["node"], ["idx"], "labels"), ["node"], ["idx"], {"label": "p_label", "idx": "p_idx"})
    return b.where("p_idx is not null and not (label <=> p_label)").select("node", "idx")


def isolated_breaks(parts: DataFrame, bubbles: DataFrame, hetero_nodes: DataFrame) -> DataFrame:
    """Breaks on both sides of each bubble contig inside a multi-part node that
    has no partner node."""
    size = parts.groupBy("node").agg(F.max("idx").alias("last")).where("last > 0")
    t = parts.join(bubbles.select(F.col("contig").alias("c")), F.abs("contig") == F.col("c"), "left_semi").join(size, "node").join(hetero_nodes, "node", "left_anti")
    x = t.select("node", "last", F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("idx"))
    return x.where("idx > 0 and idx <= last").select("node", "idx").distinct()


def bubble_junction_breaks(parts: DataFrame, junctions: DataFrame, overlaps: DataFrame, min_overlap: int, gapped: bool = False,
                           bubble_nodes: DataFrame | None = None) -> DataFrame:
    """Between two parts of which one is a bubble junction and whose overlap is
    below ``min_overlap``; in gap mode, at gaps or overlaps below 20 outside
    bubble nodes."""
    from .overlap import lookup_overlap
    t = with_previous(parts)
    j = junctions.select(F.col("contig").alias("c")).distinct()
    a = t.join(j, F.abs("contig") == F.col("c"), "left_semi").select("node", "idx")
    b = t.join(j, F.abs("p_contig") == F.col("c"), "left_semi").select("node", "idx")
    near = t.join(a.unionByName(b).distinct(), ["node", "idx"], "left_semi")
    ov = lookup_overlap(near.select("node", "idx", "start", "p_end", F.col("p_contig").alias("id1"), F.col("contig").alias("id2")), overlaps)
    if not gapped:
        return ov.where(F.col("overlap") < min_overlap).select("node", "idx")
    if bubble_nodes is not None:
        ov = ov.join(bubble_nodes, "node", "left_anti")
    return ov.where((F.col("start") > F.col("p_end")) | (F.col("overlap") < 20)).select("node", "idx")


def collision_breaks(parts: DataFrame, support: DataFrame, min_link: int) -> DataFrame:
    """Parts of a repeat node split by which edge supports them: label of a part
    is the edge with most links on it (at least ``min_link``); unsupported parts
    go with the label before. support: (node, idx, edge, n)."""
    best = support.where(F.col("n") >= min_link).groupBy("node", "idx").agg(
        F.max(F.struct("n", (-F.col("edge")).alias("e"))).alias("b")).select("node", "idx", (-F.col("b.e")).alias("label"))
    return label_breaks(best)


def end_flag_breaks(parts: DataFrame, opposite: DataFrame, breaks: DataFrame) -> DataFrame:
    """A break beside a bubble contig is repeated beside its partner, on the
    matching side, until no new break appears. opposite: (contig, opposite)."""
    known = materialize(breaks.select("node", "idx").distinct(), "breaks")
    size = parts.groupBy("node").agg(F.max("idx").alias("last"))
    while True:
        # side 0 = before the contig as it reads, 1 = after it
        plus = F.col("contig") > 0
        before = parts.join(known, ["node", "idx"]).select(F.abs("contig").alias("contig"), F.when(plus, 0).otherwise(1).alias("side"))
        after = parts.join(known.select("node", (F.col("idx") - 1).alias("idx")), ["node", "idx"]).select(
            F.abs("contig").alias("contig"), F.when(plus, 1).otherwise(0).alias("side"))
        flags = before.unionByName(after).distinct().join(opposite, "contig").select(
            F.abs("opposite").alias("contig"), F.when(F.col("opposite") > 0, F.col("side")).otherwise(1 - F.col("side")).alias("side"))
        t = parts.withColumn("c", F.abs("contig")).join(flags.withColumnRenamed("contig", "c"), "c")
        first = (F.col("side") == 0) == (F.col("contig") > 0)
        new = t.select("node", F.when(first, F.col("idx")).otherwise(F.col("idx") + 1).alias("idx")).join(size, "node").where(
            "idx > 0 and idx <= last").select("node", "idx").distinct().join(known, ["node", "idx"], "left_anti")
        new = materialize(new, "new-breaks")
        if is_empty(new):
            return known
        known = materialize(known.unionByName(new), "breaks")
    return known


def spanning(pairs: DataFrame) -> DataFrame:
    """Pairs that span each boundary: (node, idx, n). ``pairs`` is (pair, node,
    idx1, idx2): both mates on one node; a pair counts once per boundary."""
    from .coverage import depth_segments
    span = pairs.groupBy("pair", "node").agg(F.min(F.least("idx1", "idx2")).alias("a"), F.max(F.greatest("idx1", "idx2")).alias("b"))
    d = depth_segments(span.select("node", (F.col("a") + 1).alias("s"), (F.col("b") + 1).alias("e")))
    return d.select("node", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx"), F.col("depth").alias("n"))


def inside_links(mates: DataFrame, parts: DataFrame, insert: int) -> DataFrame:
    """Mates that should reach over boundaries but whose partner lies elsewhere:
    (node, idx, n). ``mates`` is (pair, node, strand, pos, idx); a mate counts
    against every boundary ahead of it within ``insert`` bases.

    The boundary of part i is its end for forward mates (break idx i + 1) and
    its start for backward ones (break idx i). Mates and boundaries meet in
    coordinate bins.
    """
    b = parts.select("node", F.explode(F.array(
        F.struct(F.lit(1).alias("strand"), F.col("end").alias("at"), (F.col("idx") + 1).alias("cut"), F.col("idx").alias("i")),
        F.struct(F.lit(-1).alias("strand"), F.col("start").alias("at"), F.col("idx").alias("cut"), F.col("idx").alias("i")))).alias("b")).select("node", "b.*")
    last = parts.groupBy("node").agg(F.max("idx").alias("last"))
    b = b.join(last, "node").where("cut > 0 and cut <= last").select("node", "strand", "at", "cut", "i", F.floor(F.col("at") / insert).alias("_b"))
    m = mates.select("pair", "node", "strand", "pos", F.col("idx").alias("home"),
                     F.explode(F.array(F.floor(F.col("pos") / insert) - 1, F.floor(F.col("pos") / insert), F.floor(F.col("pos") / insert) + 1)).alias("_b"))
    hit = m.join(b, ["node", "strand", "_b"])
    ahead = F.when(F.col("strand") > 0, (F.col("i") >= F.col("home")) & (F.col("at") - F.col("pos") <= insert)).otherwise(
        (F.col("i") <= F.col("home")) & (F.col("pos") - F.col("at") <= insert))
    return hit.where(ahead).select("pair", "node", F.col("cut").alias("idx")).distinct().groupBy("node", "idx").agg(F.count(F.lit(1)).alias("n"))


def contradicting_mates(pairs: DataFrame, lengths: DataFrame, insert: int, tolerance: int) -> DataFrame:
    """Mates of pairs that do not face each other on one node although they
    would have to overhang their nodes by more than the insert size: input
    (pair, n1, s1, p1, i1, n2, s2, p2, i2), output one row per mate."""
    size = lengths.select("node", "len")
    t = pairs.withColumn("node", F.col("n1")).join(size.withColumnRenamed("len", "l1"), "node").withColumn("node", F.col("n2")).join(
        size.withColumnRenamed("len", "l2"), "node").drop("node")
    over = lambda i: F.when(F.col("s" + i) > 0, F.col("l" + i) - F.col("p" + i)).otherwise(F.col("p" + i))
    facing = (F.col("n1") == F.col("n2")) & (F.col("s1") == -F.col("s2"))
    t = t.where(~facing & (over("1") + over("2") > insert + tolerance))
    return t.select("pair", F.explode(F.array(*[F.struct(F.col("n" + i).alias("node"), F.col("s" + i).alias("strand"), F.col("p" + i).alias("pos"),
                                                         F.col("i" + i).alias("idx")) for i in ("1", "2")])).alias("m")).select("pair", "m.*")


def switched(pairs: DataFrame, opposite: DataFrame, home: DataFrame, partner: DataFrame) -> DataFrame:
    """Pairs that would span a node if one mate lay on the other haplotype:
    rows for ``spanning``. pairs: (pair, c1, c2) unsigned contigs; opposite:
    (contig, opposite); home: (contig, node, idx) once placed; partner: (node,
    opposite)."""
    o = opposite.select("contig", F.abs("opposite").alias("o"))
    h = home.select("contig", "node", "idx")
    t = pairs
    for i in ("1", "2"):
        t = t.join(o.select(F.col("contig").alias("c" + i), F.col("o").alias("o" + i)), "c" + i)
        for kind in ("c", "o"):
            t = t.join(h.select(F.col("contig").alias(kind + i), F.col("node").alias(f"n_{kind}{i}"), F.col("idx").alias(f"x_{kind}{i}")), kind + i)
    t = t.where("c1 <> o2 and n_c1 = n_o2 and n_o1 = n_c2 and n_c1 <> n_c2")
    t = t.join(partner.select(F.col("node").alias("n_c1"), F.abs("opposite").alias("n_c2")), ["n_c1", "n_c2"], "left_semi")
    return t.select("pair", F.explode(F.array(
        F.struct(F.col("n_c1").alias("node"), F.col("x_c1").alias("idx1"), F.col("x_o2").alias("idx2")),
        F.struct(F.col("n_c2").alias("node"), F.col("x_o1").alias("idx1"), F.col("x_c2").alias("idx2")))).alias("m")).select("pair", "m.*")


def erroneous_breaks(parts: DataFrame, pro: DataFrame, contra: DataFrame, mode: str, min_link: int = 1, max_gap: int = 0) -> DataFrame:
    """Boundaries with more evidence against than for them. Mode "switch" also
    asks for ``min_link`` contradicting pairs; "gap" breaks where the parts
    overlap by at least ``max_gap`` and ``min_link`` pairs contradict; "mis"
    compares the counts only."""
    t = (with_previous(parts).select("node", "idx", (F.col("p_end") - F.col("start")).alias("lap"))
         .join(pro.select("node", "idx", F.col("n").alias("pro")), ["node", "idx"], "left")
         .join(contra.select("node", "idx", F.col("n").alias("contra")), ["node", "idx"], "left").na.fill(0, ["pro", "contra"]))
    more = F.col("contra") > F.col("pro")
    rule = {"switch": more & (F.col("contra") >= min_link),
            "gap": (F.col("lap") >= max_gap) & (F.col("contra") >= min_link), "mis": more}[mode]
    return t.where(rule).select("node", "idx")


def split_at(parts: DataFrame, breaks: DataFrame, unique: bool = False) -> DataFrame:
    """Cut nodes at breaks: (parent, seg, idx, contig, start, end) with starts
    counted from the new node. With ``unique`` (division at gaps) segments
    without a contig of their own, one that no earlier segment holds, are
    dropped; every other division keeps all segments."""
    marked = parts.join(breaks.select("node", "idx").distinct().withColumn("_c", F.lit(1)), ["node", "idx"], "left").na.fill(0, ["_c"])
    run = running_sum(ordered_blocks(marked, ["node"], ["idx"], "split"), ["node"], ["idx"], "_c", "seg").drop("_c", "_blk")
    run = materialize(run, "segments")
    zero = run.groupBy("node", "seg").agg(F.min(F.struct("idx", "start")).alias("z"))
    if unique:
        first = run.groupBy(F.abs("contig").alias("c")).agg(F.min(F.struct("node", "seg")).alias("f")).select("f.node", "f.seg").distinct()
        zero = zero.join(first, ["node", "seg"], "left_semi")
    return run.join(zero, ["node", "seg"]).select(
        F.col("node").alias("parent"), "seg", (F.col("idx") - F.col("z.idx")).alias("idx"), "contig",
        (F.col("start") - F.col("z.start")).alias("start"), (F.col("end") - F.col("z.start")).alias("end"))


def renumbered_nodes(split: DataFrame) -> DataFrame:
    """New dense node ids in order of (parent, seg); the parent is remembered."""
    from ..sources.readers import dense_ids
    ids = dense_ids(split.select(F.struct("parent", "seg").alias("k")).distinct(), "k", "node", "nodes")
    return split.withColumn("k", F.struct("parent", "seg")).join(ids, "k").select("node", "idx", "contig", "start", "end", "parent")


def majority_run(labels: DataFrame, score_factor: float = 1.0) -> DataFrame:
    """Longest-total label of each node and its run: (node, label, first, last).
    labels: (node, idx, label, len).

    The run reaches from the first to the last part with the label, without the
    ends where other labels outweigh it: it begins where the parts before count
    most for others (their lengths times ``score_factor`` minus those of the
    label), and ends in the same way. Unlabelled parts weigh nothing."""
    w = labels.where("label <> 0").groupBy("node", "label").agg(F.sum("len").alias("l"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    best = w.groupBy("node").agg(F.max(F.struct("l", (-F.col("label")).alias("i"), "label", "first", "last")).alias("b")).select(
        "node", F.col("b.label").alias("best"), "b.first", "b.last")
    weight = F.when(F.col("label") == F.col("best"), -F.col("len")).when(F.col("label") != 0, F.col("len") * score_factor).otherwise(0).cast("double")
    inside = labels.join(best, "node").where("idx between first and last").select("node", "idx", "best", weight.alias("w"))
    run = materialize(running_sum(ordered_blocks(inside, ["node"], ["idx"], "run"), ["node"], ["idx"], "w", "sum"), "run")
    start = run.groupBy("node").agg(F.max_by("idx", F.struct(F.col("sum") - F.col("w"), -F.col("idx"))).alias("first"),
                                    F.first("best").alias("label"), F.sum("w").alias("all"))
    late = run.select("node", "idx", "sum").join(start, "node").where("idx > first")
    end = late.groupBy("node").agg(F.max_by("idx", F.struct(F.col("all") - F.col("sum"), F.col("idx"))).alias("last"))
    return start.join(end, "node", "left").select("node", "label", "first", F.coalesce("last", "first").alias("last"))


def smoothed(labels: DataFrame) -> DataFrame:
    """Fill the stretch of the majority label, then treat what is left on either
    side the same way, until every part is settled: (node, idx, label)."""
    todo = materialize(labels.select("node", F.col("node").alias("top"), F.lit("").alias("way"), "idx", "label", "len"), "smooth")
    done = None
    while not is_empty(todo):
        keyed = todo.withColumn("_k", F.concat_ws("|", F.col("top").cast("string"), "way"))
        best = majority_run(keyed.select(F.col("_k").alias("node"), "idx", "label", "len")).withColumnRenamed("label", "best")
        t = keyed.join(best.withColumnRenamed("node", "_k"), "_k", "left")
        inside = F.col("best").isNull() | ((F.col("idx") >= F.col("first")) & (F.col("idx") <= F.col("last")))
        fixed = t.where(inside).select("top", "idx", F.coalesce("best", "label").alias("label"))
        done = fixed if done is None else done.unionByName(fixed)
        done = materialize(done, "smooth-done")
        todo = materialize(t.where(~inside).select("node", "top", F.concat("way", F.when(F.col("idx") < F.col("first"), "l").otherwise("r")).alias("way"),
                                                   "idx", "label", "len"), "smooth")
    return (done if done is not None else labels).select(F.col("top").alias("node"), "idx", "label")
