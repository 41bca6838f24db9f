"""Closing gaps for all scaffolds in one job.

The gap id is part of every key: consensus, local graphs and overlap chains of
all gaps are the same grouped joins, so the work is spread over gaps and over
the reads of one gap alike and no gap is ever gathered in a Python task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.bases import revcomp
from ..session import is_empty, materialize
from . import dbg
from .align import end_alignments
from .coverage import unknown_runs
from .kmers import count_kmers, kmer_rows

FLANK = 150             # fixed values of gap closing
LOCAL_K = (20, 80)
MIN_LOCAL_COVERAGE = 2
CONSENSUS_PAIRS = 0.66
CONSENSUS_SMALL = 0.9
SPREAD = 3


def gaps(scaffolds: DataFrame, flank: int = FLANK) -> DataFrame:
    """Maximal N runs with flanks: (gap_id, node, s, e, head, tail). Flanks stop
    at the next N. The id is made of the place, so it never changes."""
    runs = unknown_runs(scaffolds)
    t = runs.join(scaffolds.select("node", "seq"), "node")
    head = F.substring(F.col("seq"), F.greatest(F.col("s") - flank, F.lit(0)).cast("int") + 1, F.least(F.col("s"), F.lit(flank)).cast("int"))
    tail = F.substring(F.col("seq"), F.col("e").cast("int") + 1, F.lit(flank))
    return t.select(F.concat_ws(":", "node", "s").alias("gap_id"), "node", "s", "e",
                    F.regexp_extract(head, "([^N]*)$", 1).alias("head"), F.regexp_extract(tail, "^([^N]*)", 1).alias("tail"))


def gather(mates: DataFrame, gap_rows: DataFrame, insert: int, sd: int, width: int = 4096) -> DataFrame:
    """Reads whose mate places them in a gap: the expected interval [pos + insert
    - 3 sd - len, pos + insert + 3 sd] (mirrored for backward mates) meets the
    gap. Both sides are cut to coordinate bins; mates is (node, strand, pos,
    read_id, seq) with the sequence of the read to place."""
    n = F.length("seq")
    lo = F.when(F.col("strand") > 0, F.col("pos") + insert - SPREAD * sd - n).otherwise(F.col("pos") - insert - SPREAD * sd)
    hi = F.when(F.col("strand") > 0, F.col("pos") + insert + SPREAD * sd).otherwise(F.col("pos") - insert + SPREAD * sd + n)
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    m = mates.select("node", "read_id", lo.alias("lo"), hi.alias("hi")).select("*", bins(F.col("lo"), F.col("hi")).alias("_b"))
    g = gap_rows.select("gap_id", "node", "s", "e", bins(F.col("s"), F.col("e")).alias("_b"))
    hit = m.join(g, ["node", "_b"]).where("lo <= e and hi >= s").select("gap_id", "read_id").distinct()
    return hit


def gap_at(points: DataFrame, gap_rows: DataFrame, width: int = 4096) -> DataFrame:
    """Gap that covers a position, by coordinate bins: points is (node, pos)."""
    g = gap_rows.select("gap_id", "node", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("_b"))
    p = points.withColumn("_b", F.floor(F.col("pos") / width))
    return p.join(g, ["node", "_b"]).where("pos >= s and pos < e").drop("_b", "s", "e")


def gathered_ratio(reads: DataFrame, gap_rows: DataFrame, coverage: DataFrame, sd: int) -> DataFrame:
    """Bases gathered per base of the reachable stretch, over the coverage of
    the scaffold: (gap_id, bases, ratio)."""
    s = reads.groupBy("gap_id").agg(F.sum(F.length("seq").cast("bigint")).alias("bases"))
    size = (F.col("e") - F.col("s") + 1) + 2 * SPREAD * sd
    return gap_rows.join(s, "gap_id").join(coverage.select("node", "cov"), "node").select(
        "gap_id", "bases", (F.col("bases") / size / F.col("cov")).alias("ratio"))


def largest_gathering(reads: DataFrame) -> DataFrame:
    return reads.groupBy("gap_id").agg(F.sum(F.length("seq") + 1).alias("b")).agg(F.max("b").cast("bigint").alias("most"))


def consensus(candidates: DataFrame, rate: float, key: str = "gap_id", min_reads: int = 1) -> DataFrame:
    """Agreed text per gap: (key, length, seq). The most frequent length must
    reach ``rate`` of the reads, then the most frequent base per column is taken
    and the agreeing bases must reach ``rate`` too. Lengths up to 0 mean that the
    flanks touch or overlap. Ties go to the shorter positive length and to the
    first base. ``candidates`` is (key, length, seq).

    Equal candidates collapse to one weighted row before columns are opened, so
    the work follows the distinct texts.
    """
    c = candidates.groupBy(key, "length", "seq").agg(F.count(F.lit(1)).alias("w"))
    by_len = c.groupBy(key, "length").agg(F.sum("w").alias("m"))
    # scan order of the tie rule: 0, 1, -1, 2, -2, ...
    order = F.abs("length") * 2 + F.when(F.col("length") < 0, 1).otherwise(0)
    top = by_len.groupBy(key).agg(F.sum("m").alias("all"), F.max(F.struct("m", (-order).alias("o"), "length")).alias("b")).select(
        key, "all", "b.m", "b.length").where((F.col("m") >= F.col("all") * rate) & (F.col("all") >= min_reads))
    short = top.where("length <= 0").select(key, "length", F.lit("").alias("seq"))
    cols = c.join(top.where("length > 0"), [key, "length"]).select(
        key, "length", "m", "w", F.posexplode(F.split("seq", "")).alias("col", "base")).where("base in ('A', 'C', 'G', 'T')")
    votes = cols.groupBy(key, "length", "m", "col", "base").agg(F.sum("w").alias("v"))
    rank = F.struct("v", (-F.ascii("base")).alias("a"), "base")
    best = votes.groupBy(key, "length", "m", "col").agg(F.max(rank).alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.col("b.base").alias("x")))), lambda x: x["x"]), "")
    full = best.groupBy(key, "length", "m").agg(F.sum("b.v").alias("agree"), text.alias("seq")).where(
        (F.col("agree") >= F.col("length") * F.col("m") * rate) & (F.length("seq") == F.col("length")))
    return short.unionByName(full.select(key, "length", "seq"))


def consensus_bases(columns: DataFrame, rate: float) -> DataFrame:
    """Per (key, col): the base with the largest share, N below ``rate``."""
    v = columns.groupBy("key", "col", "base").agg(F.count(F.lit(1)).alias("v"))
    g = v.groupBy("key", "col").agg(F.sum("v").alias("all"), F.max(F.struct("v", (-F.ascii("base")).alias("a"), "base")).alias("b"))
    return g.select("key", "col", F.when(F.col("b.v") >= F.col("all") * rate, F.col("b.base")).otherwise("N").alias("base"))


def close_small(gap_rows: DataFrame, candidates: DataFrame, rate: float = CONSENSUS_SMALL, min_reads: int = 1) -> DataFrame:
    """Closures from reads that span a gap: (gap_id, length, seq, shrink). A
    negative length is an overlap of the flanks, which must then be equal."""
    c = consensus(candidates, rate, min_reads=min_reads).join(gap_rows, "gap_id")
    n = (-F.col("length")).cast("int")
    fits = (F.col("length") > 0) | (F.right("head", n) == F.left("tail", n))
    return c.where(fits).select("gap_id", F.greatest("length", F.lit(0)).alias("length"), "seq", F.greatest(n, F.lit(0)).alias("shrink"))


def local_graph(reads: DataFrame, k: int, min_cov: int = MIN_LOCAL_COVERAGE) -> DataFrame:
    """One de Bruijn graph per gap, read strand only: segments with the gap as
    scope. ``reads`` is (gap_id, seq), already turned to the scaffold strand."""
    rows = kmer_rows(reads, k, keep=["gap_id"], mode="forward")
    t = rows.groupBy("gap_id", "kmer").agg(F.count(F.lit(1)).cast("int").alias("occ")).where(F.col("occ") >= min_cov)
    return dbg.compact(dbg.as_segments(t, k, scope="gap_id"), k, stranded=True)


def spanning_unitigs(gap_rows: DataFrame, segs: DataFrame, k: int, max_mismatch: float = 0.1, overlap: int | None = None) -> DataFrame:
    """Closures by the only segment of a gap's graph that holds both flanks:
    (gap_id, length, seq, shrink). The last ``overlap`` bases of the head and
    the first of the tail are looked for in the segment; up to ``max_mismatch``
    of the flank may differ."""
    o = overlap or k
    t = segs.select(F.col("scope").alias("gap_id"), F.col("seq").alias("u")).join(gap_rows, "gap_id")
    t = t.where((F.length("head") >= o) & (F.length("tail") >= o) & (F.length("u") >= o))
    h, a = F.right("head", F.lit(o)), F.left("tail", F.lit(o))
    at_h, at_t = F.instr("u", h), F.instr("u", a)
    exact = t.withColumn("_h", at_h).withColumn("_t", at_t).where("_h > 0 and _t > 0")
    body = F.col("_t") - F.col("_h") - o
    from ..functions.bases import mismatches
    # longer flanks are compared next to the anchor words
    left = F.least(F.length("head"), F.col("_h") + o - 1).cast("int")
    right = F.least(F.length("tail"), F.length("u") - F.col("_t") + 1).cast("int")
    miss_l = mismatches(F.right("head", left), F.substring(F.col("u"), F.col("_h") + o - left, left))
    miss_r = mismatches(F.left("tail", right), F.substring(F.col("u"), F.col("_t"), right))
    ok = exact.withColumn("body", body).where((miss_l <= left * max_mismatch) & (miss_r <= right * max_mismatch) & (F.col("body") > -o))
    one = ok.groupBy("gap_id").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("u", "_h", "body")).alias("b")).where("m = 1")
    return one.select("gap_id", F.greatest("b.body", F.lit(0)).alias("length"),
                      F.substring(F.col("b.u"), F.col("b._h") + o, F.greatest("b.body", F.lit(0))).alias("seq"),
                      F.greatest(-F.col("b.body"), F.lit(0)).alias("shrink"))


def partial_closures(gap_rows: DataFrame, segs: DataFrame, k: int) -> DataFrame:
    """Best extension of either flank into the gap: (gap_id, left, right), the
    texts to write at the left and right end. Ends of scaffolds that have only
    one flank are extended the same way."""
    t = segs.select(F.col("scope").alias("gap_id"), F.col("seq").alias("u")).join(gap_rows, "gap_id")
    h, a = F.right("head", F.lit(k)), F.left("tail", F.lit(k))
    at_h = F.when(F.length("head") >= k, F.instr("u", h)).otherwise(0)
    at_t = F.when(F.length("tail") >= k, F.instr("u", a)).otherwise(0)
    x = t.select("gap_id", F.when(at_h > 0, F.substring(F.col("u"), at_h + k, F.length("u"))).alias("l"),
                 F.when(at_t > 0, F.substring(F.col("u"), F.lit(1), at_t - 1)).alias("r"))
    pick = lambda c: F.max(F.when(F.length(c) > 0, F.struct(F.length(c).alias("n"), F.col(c).alias("t"))))["t"]
    return x.groupBy("gap_id").agg(F.coalesce(pick("l"), F.lit("")).alias("left"), F.coalesce(pick("r"), F.lit("")).alias("right")).where(
        "left <> '' or right <> ''")


def read_order(reads: DataFrame) -> DataFrame:
    """Reads of a gap by length, then text (the order ties are settled by)."""
    return reads.orderBy("gap_id", F.length("seq"), "seq")


def overlap_candidates(reads: DataFrame, k: int) -> DataFrame:
    """Pairs of a read and the reads that begin inside it: the first k-mer of
    one occurs in the other: (gap_id, a, b, pos)."""
    from ..functions.bases import pack
    heads = reads.where((F.length("seq") >= k) & ~F.contains("seq", F.lit("N"))).select("gap_id", F.col("read_id").alias("b"), pack(F.left("seq", F.lit(k))).alias("kmer"))
    rows = kmer_rows(reads, k, keep=["gap_id", "read_id"], mode="forward", positions=True).where("pos > 0")
    return rows.select("gap_id", F.col("read_id").alias("a"), "pos", "kmer").join(heads, ["gap_id", "kmer"]).where("a <> b").select("gap_id", "a", "b", "pos")


def read_overlaps(pool: DataFrame, k: int, max_miss: float, band: int) -> DataFrame:
    """Overlaps of a read's end with another read's start: (gap_id, a, b, n, back, add).

    ``n`` bases of b lie on the last ``back`` bases of a, ``add`` is the rest of b.
    Candidates that agree base by base stay in the JVM; the others are aligned, in a
    band around the common word, with insertions and deletions: in a run of one base
    a lacking base looks like few mismatches, but moves the end of the overlap. What
    the alignment refuses stands without gaps, if its mismatches are few.
    """
    from ..functions.bases import mismatches
    c = overlap_candidates(pool, k).where((F.col("a") != -2) & (F.col("b") != -1))
    t = c.join(pool.select("gap_id", F.col("read_id").alias("a"), F.col("seq").alias("sa")), ["gap_id", "a"]).join(
        pool.select("gap_id", F.col("read_id").alias("b"), F.col("seq").alias("sb")), ["gap_id", "b"])
    t = t.withColumn("n", F.length("sa") - F.col("pos"))
    fits = F.col("n") <= F.length("sb")
    same = fits & (F.right("sa", F.col("n")) == F.left("sb", F.col("n")))
    alike = fits & (mismatches(F.right("sa", F.col("n")), F.left("sb", F.col("n"))) <= F.col("n") * max_miss)
    t = materialize(t.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("alike", F.coalesce(alike, F.lit(False))), "overlap-candidates")
    rest = t.where(~F.col("same") & (F.col("n") <= F.length("sb") + band))
    got = materialize(end_alignments(rest.select(
        "gap_id", F.col("a").alias("from_id"), F.col("b").alias("to_id"), "pos", F.length("sa").alias("a_len"), F.col("sb").alias("text"),
        F.col("sa").alias("a"), F.col("sb").alias("b"), F.col("pos").alias("diagonal")), band, k, max_miss), "bent-overlaps")
    bent = got.select("gap_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("b_end").alias("n"),
                      (F.col("a_len") - F.col("a_start")).alias("back"), F.col("text").alias("sb"))
    tried = got.select("gap_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), "pos")
    plain = t.where("same").unionByName(t.where("alike and not same").join(tried, ["gap_id", "a", "b", "pos"], "left_anti")).withColumn("back", F.col("n"))
    return plain.select("gap_id", "a", "b", "n", "back", "sb").unionByName(bent).select(
        "gap_id", "a", "b", "n", "back", F.substring(F.col("sb"), F.col("n") + 1, F.length("sb")).alias("add"))


def overlap_chains(gap_rows: DataFrame, reads: DataFrame, k: int, max_miss: float = 0.1, band: int = 8) -> DataFrame:
    """Closures by chains of reads from head to tail: (gap_id, length, seq,
    shrink). Head and tail take part as reads; each read goes on to the read it
    overlaps most (then the smaller id), and the chain from the head is followed
    for all gaps together until it reaches the tail. Overlaps may hold up to
    ``band`` inserted or deleted bases; the text of the earlier read stands.
    """
    ends = gap_rows.select("gap_id", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("read_id"), F.col("head").alias("seq")),
                                                       F.struct(F.lit(-2).cast("bigint").alias("read_id"), F.col("tail").alias("seq")))).alias("x")).select("gap_id", "x.*")
    distinct = reads.groupBy("gap_id", "seq").agg(F.min("read_id").alias("read_id")).select("gap_id", "read_id", "seq")
    pool = materialize(distinct.unionByName(ends).where(F.length("seq") >= k), "pool")
    t = read_overlaps(pool, k, max_miss, band)
    # the tail wins as soon as it can be reached, else the longest overlap
    best = t.groupBy("gap_id", "a").agg(F.max(F.struct((F.col("b") == -2).alias("end"), "n", (-F.col("b")).alias("i"), "b", "back", "add")).alias("x"))
    nxt = materialize(best.select("gap_id", "a", "x.b", "x.back", "x.add"), "overlaps")
    # where the tail starts in the text: as many bases before the end of the last read as it covers there
    def go(walk, text, seen):
        ends_here = F.col("b") == -2
        return walk.select("gap_id", F.col("b").alias("at"), F.when(ends_here, F.length(text) - F.col("back")).alias("n"),
                           F.when(ends_here, text).otherwise(F.concat(text, F.col("add"))).alias("text"), F.concat(seen, F.array("b")).alias("seen"))

    walk = materialize(go(nxt.where("a = -1"), F.lit(""), F.array().cast("array<bigint>")), "walk")
    done = walk.where("at = -2")
    while not is_empty(walk.where("at <> -2")):
        step = walk.where("at <> -2").drop("n").join(nxt.withColumnRenamed("a", "at"), ["gap_id", "at"]).where(~F.array_contains("seen", F.col("b")))
        walk = materialize(go(step, F.col("text"), F.col("seen")), "walk")
        done = done.unionByName(walk.where("at = -2"))
    return done.select("gap_id", F.greatest("n", F.lit(0)).alias("length"), F.substring(F.col("text"), F.lit(1), F.greatest("n", F.lit(0))).alias("seq"),
                       F.greatest(-F.col("n"), F.lit(0)).alias("shrink"))


def close_with_reads(gap_rows: DataFrame, reads: DataFrame, ks=LOCAL_K, min_cov: int = MIN_LOCAL_COVERAGE) -> DataFrame:
    """Closures from gathered reads, best method first: spanning segment of a
    local graph (each k), overlap chain, extension from the flanks. Later
    methods only see the gaps still open: (gap_id, seq, shrink, remain)."""
    out, left = None, gap_rows
    partial = None
    for k in ks:
        segs = local_graph(reads.join(left.select("gap_id"), "gap_id", "left_semi"), k, min_cov)
        got = materialize(spanning_unitigs(left, segs, k).select("gap_id", "seq", "shrink"), "closed")
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("gap_id"), "gap_id", "left_anti")
        p = partial_closures(left, segs, k)
        partial = p if partial is None else partial.unionByName(p)
    chain = materialize(overlap_chains(left, reads.join(left.select("gap_id"), "gap_id", "left_semi"), min(ks)).select("gap_id", "seq", "shrink"), "chained")
    out = out.unionByName(chain).withColumn("remain", F.lit(0).cast("bigint"))
    left = left.join(chain.select("gap_id"), "gap_id", "left_anti")
    best = partial.groupBy("gap_id").agg(F.max(F.struct((F.length("left") + F.length("right")).alias("n"), "left", "right")).alias("b"))
    size = F.col("e") - F.col("s")
    # what the flanks do not fill stays unknown, at least one base
    rest = F.greatest(size - F.col("b.n"), F.lit(1))
    ext = left.join(best, "gap_id").select("gap_id", F.concat("b.left", F.repeat(F.lit("N"), rest.cast("int")), "b.right").alias("seq"),
                                           F.lit(0).alias("shrink"), rest.alias("remain"))
    return out.unionByName(ext)


def unused_reads(reads: DataFrame, closures: DataFrame) -> DataFrame:
    """Reads of the gaps that no closure has settled yet, for the next pass."""
    return reads.join(closures.where("remain = 0").select("gap_id"), "gap_id", "left_anti")


def apply_closures(scaffolds: DataFrame, gap_rows: DataFrame, closures: DataFrame) -> DataFrame:
    """Scaffolds with closed gaps: (node, seq, closed). Pieces between gaps are
    numbered, an overlap of the flanks shortens the piece after the gap, and
    pieces are put together again in order."""
    c = gap_rows.join(closures.select("gap_id", F.col("seq").alias("fill"), "shrink"), "gap_id").select(
        "node", F.struct("s", "e", "fill", "shrink").alias("g"))
    g = c.groupBy("node").agg(F.array_sort(F.collect_list("g")).alias("g"))
    j = scaffolds.join(g, "node", "left")
    seq = F.col("seq")

    def piece(x, i):
        prev = F.get(F.col("g"), i - 1)
        start = F.when(i == 0, F.lit(0)).otherwise(prev["e"] + prev["shrink"])
        return F.concat(F.substring(seq, (start + 1).cast("int"), F.greatest(x["s"] - start, F.lit(0)).cast("int")), x["fill"])

    end = F.element_at("g", -1)
    tail = F.substring(seq, (end["e"] + end["shrink"] + 1).cast("int"), F.length(seq))
    text = F.concat(F.array_join(F.transform("g", piece), ""), tail)
    return j.select("node", F.when(F.col("g").isNull(), seq).otherwise(text).alias("seq"), F.coalesce(F.size("g"), F.lit(0)).alias("closed"))


def closed_names(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """Names with the new length and coverage; bubble arms keep their mark."""
    t = results.join(coverage, "node", "left").na.fill(1, ["cov"])
    mark = F.when(F.coalesce("bubble", F.lit(False)), F.lit("bubble")).otherwise(F.lit("scaffold")) if "bubble" in t.columns else F.lit("scaffold")
    return t.select("node", F.concat(mark, "node", F.lit("_len"), F.length("seq"), F.lit("_cov"), F.col("cov").cast("bigint")).alias("name"), "seq")


def local_contigs(reads: DataFrame, ks=LOCAL_K, min_cov: int = MIN_LOCAL_COVERAGE, min_len: int = 100) -> DataFrame:
    """Extra contigs of open gaps: local segments of both k, tips cut: (gap_id, seq)."""
    out = None
    for k in ks:
        s = dbg.cut_tips(local_graph(reads, k, min_cov), k, stranded=True)
        t = dbg.unitigs(s).select(F.col("scope").alias("gap_id"), "seq").where(F.length("seq") >= min_len)
        out = t if out is None else out.unionByName(t)
    return out


def circular(results: DataFrame, min_overlap: int = 100) -> DataFrame:
    from ..functions.bases import self_overlap
    return results.withColumn("overlap", self_overlap("seq", min_overlap)).where("overlap > 0")
