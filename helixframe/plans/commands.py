"""The commands a user calls, composed from the operators.

Each takes and returns DataFrames; ``Pipeline`` writes the stage tables with
done markers so that a run can be taken up again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.bases import revcomp
from ..operators import (composition as cp, coverage as cv, dbg, division as dv, edges as ed, gapclose as gc, grow as gr, kmers as km,
                         layout as ly, links as lk, mapping as mp, overlap as ov, scaffold as sc, stats as st)
from ..session import is_empty, materialize
from ..sources import writers as wr
from ..sources.readers import dense_ids

FIRST_K = (22, 25)          # fixed values: word lengths of the first graph
K_SHARE, K_STEPS = 0.9, 4   # and the ladder up to 0.9 of the mean read length


@dataclass
class Assembly:
    contigs: DataFrame
    junctions: DataFrame
    kmers: DataFrame
    k: int


def k_ladder(mean_read_len: float) -> list[int]:
    """Word lengths: the first, then four even steps towards 0.9 of the mean."""
    first = FIRST_K[1] if mean_read_len >= FIRST_K[1] + 1 else FIRST_K[0]
    step = int((K_SHARE * mean_read_len - first) / K_STEPS + 0.5)
    return [first] + ([first + i * step for i in range(1, K_STEPS + 1)] if step > 0 else [])


def assemble(reads: DataFrame, ks: Sequence[int] | None = None, min_cov: int = 2, bubble_rate: float = dbg.BUBBLE_RATE,
             tip_ratio: float = dbg.TIP_RATIO) -> Assembly:
    """Reads (read_id, seq) to contigs over rising word lengths. Each graph is
    seeded with the contigs of the one before and with the read stretches that
    match them; tips, bubbles and weak unitigs are removed to a fixpoint."""
    reads = reads.select("read_id", "seq")
    if ks is None:
        mean = reads.agg(F.avg(F.length("seq"))).first()[0]
        ks = k_ladder(mean)
    segs, first_table = None, None
    for i, k in enumerate(ks):
        if segs is None:
            table = materialize(km.count_sequences(reads, k, min_cov), "kmers")
            first_table = table
        else:
            seeds = dbg.export_kmers(segs, k)
            known = km.kmer_rows(segs.select("seq"), ks[i - 1]).select("kmer").distinct()
            spans = km.matched_region(km.kmer_rows(reads, ks[i - 1], keep=["read_id"], positions=True), known, ks[i - 1])
            table = materialize(km.add_new_counts(seeds, km.trim_to_region(reads, spans), k).where(F.col("occ") >= max(min_cov // 2, 1)), "kmers")
        segs = dbg.compact(dbg.as_segments(table, k), k)
        segs = dbg.cut_tips(segs, k, tip_ratio)
        segs = dbg.crush_bubbles(segs, k, bubble_rate)
        segs = dbg.drop_weak(segs, k, min_cov, 2 * k)
        segs = dbg.cut_tips(segs, k, tip_ratio)
    return Assembly(dbg.unitigs(segs), dbg.junctions(segs), first_table, ks[-1])


def merge_contigs(contigs: DataFrame, k: int, bubble_rate: float = dbg.BUBBLE_RATE) -> DataFrame:
    """Contig sets through one graph: (seq, n_kmer, cov)."""
    table = materialize(km.max_coverage_kmers(contigs, k), "merge-kmers")
    segs = dbg.compact(dbg.as_segments(table, k), k)
    segs = dbg.crush_bubbles(dbg.cut_tips(segs, k), k, bubble_rate)
    return segs.select("seq", "n_kmer", F.floor(F.col("cov") + 0.5).cast("int").alias("cov"))


def cov_trim(contigs: DataFrame, reads: DataFrame, k: int, ratio: float = 2.0, min_len: int = 25, read_len: int = 100,
             window: int = 1000) -> DataFrame:
    """Contigs cut where k-mer coverage changes and trimmed to normal coverage:
    (contig_id, start, end, seq, cov)."""
    table = km.count_among(reads, km.kmer_rows(contigs, k), k)
    cover = materialize(km.position_coverage(contigs, table, k), "cover")
    width = max(window - k + 1, 2)
    points = cv.window_breaks(cover, width, k, ratio).select("contig_id", (F.col("pos") + width + k - 1).alias("pos"))
    ends = cv.trim_points(cover, k, ratio)
    cuts = points.unionByName(ends.select("contig_id", F.explode(F.array("first", "last")).alias("pos")))
    pieces = materialize(cv.pieces_between(cuts, contigs, min_len), "pieces")
    with_cov = cv.piece_coverage(pieces, cover, k, read_len)
    return with_cov.join(contigs.select("contig_id", "seq"), "contig_id").select(
        "contig_id", "start", "end", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"), "cov")


def divide(contigs: DataFrame, intervals: DataFrame, edge: int, rate: float, min_median: int, min_len: int, long_range: bool = False) -> DataFrame:
    """Contigs (node, seq) divided where physical coverage breaks down:
    (node, start, end, seq). ``intervals`` is (node, s, e) of pairs or reads."""
    lengths = contigs.select("node", F.length("seq").cast("bigint").alias("len"))
    seg = cv.within(cv.depth_segments(intervals), lengths)
    breaks = materialize(cv.low_depth_breaks(seg, lengths, edge, rate, min_median, long_range), "breaks")
    points = breaks.select("node", F.explode(F.array("s", "e")).alias("pos"))
    pieces = ly.pieces_at(contigs, points, min_len, "node")
    # the broken stretch itself is not a piece
    bad = breaks.select("node", F.col("s").alias("start"), F.col("e").alias("end"))
    return pieces.join(bad, ["node", "start", "end"], "left_anti")


def polish(contigs: DataFrame, placed: DataFrame, min_identity: float = 0.9, max_odd_ratio: float = 1.0, min_piece: int = 1,
           min_len: int = 1) -> DataFrame:
    """Doubtful bases hidden: contigs (node, seq), reads (node, s, e, identity)."""
    masks = cv.error_masks(cv.pileup(placed, min_identity), max_odd_ratio)
    from ..functions.bases import trim_unknown
    seq = trim_unknown(cv.short_islands_hidden("seq", min_piece))
    return cv.hidden(contigs, masks).select("node", seq.alias("seq")).where(F.length("seq") >= min_len)


def cluster(contigs: DataFrame, min_len: int = cp.MIN_LENGTH, number: int | None = None, max_iter: int = 20) -> DataFrame:
    """Composition clusters (id, cluster from 1; 0 for short contigs)."""
    long = contigs.where(F.length("seq") >= min_len)
    s = cp.spectra(long).join(long.select("id", F.length("seq").alias("len"), "cov"), "id")
    g = cp.bisecting_clusters(s, number, max_iter)
    return contigs.select("id").join(g, "id", "left").select("id", F.coalesce(F.col("cluster") + 1, F.lit(0)).alias("cluster"))


@dataclass
class Scaffolds:
    parts: DataFrame
    results: DataFrame
    components: DataFrame
    links: DataFrame = field(default=None)


def initial_parts(contigs: DataFrame) -> DataFrame:
    """One node per contig."""
    c = F.col("contig_id") + 1
    return contigs.select(c.alias("node"), F.lit(0).alias("idx"), c.alias("contig"), F.lit(0).cast("bigint").alias("start"),
                          F.length("seq").cast("bigint").alias("end"))


def scaffold(contigs: DataFrame, pairs: DataFrame | None = None, hits: DataFrame | None = None, barcodes: DataFrame | None = None,
             seed: int = 31, min_link: int = 3, min_len: int = 500, clusters: DataFrame | None = None, rounds: int = 1,
             min_overlap: int = 32, read_len: int = 100, max_k: int = 31, in_seed_order: bool = False) -> Scaffolds:
    """Contigs (contig_id, seq, cov) to scaffolds. Evidence: read pairs (pair_id,
    mate, seq), long-read hits (read_id, node, q_start, q_end, t_start, score)
    and barcode positions (tag, node, pos). Pairs give links and the insert
    size; thin, conflicting and cross-cluster edges go, repeats stay alone,
    layouts grow, sparse and repeated ends are cut off again. With ``in_seed_order``
    they grow one seed after the other inside each component and may pass repeats."""
    grown = gr.layouts_in_seed_order if in_seed_order else sc.grow_layouts
    overlaps = materialize(ov.exact_overlaps(contigs, min_overlap), "overlaps")
    parts = materialize(initial_parts(contigs), "parts")
    text = contigs.select((F.col("contig_id") + 1).alias("contig"), "seq", "cov")
    label = clusters if clusters is not None else text.select("contig", F.lit(0).cast("bigint").alias("cluster"))
    tolerance, insert, sd, mapped = 3 * max_k, 0, 0, None
    if pairs is not None:
        m = mp.map_with_fallback(pairs, contigs, [seed], keep=["pair_id", "mate"])
        m = m.join(pairs.select("pair_id", "mate", F.length("seq").alias("len")), ["pair_id", "mate"])
        mapped = materialize(mp.pair_up(m), "pairs")
        size = st.insert_size(st.histogram(mp.insert_lengths(mapped), "insert"), "len").first()
        insert, sd = (size["mean"] or 0), (size["sd"] or 0)
        tolerance = max(3 * sd, max_k)
    for _ in range(rounds):
        size = materialize(parts.groupBy("node").agg(F.max("end").alias("len"), F.count(F.lit(1)).alias("n_parts")), "sizes")
        sources = {}
        if mapped is not None:
            sources["pair"] = _pair_evidence(mapped, parts, size, insert)
        if hits is not None:
            long = lk.long_read_links(lk.lift_hits(hits, parts), size.select("node", "len"), 1, tolerance)
            sources["long"] = long.select((F.col("id1") * F.col("direction")).alias("id1"), (F.col("id2") * F.col("direction")).alias("id2"), "gap", "score")
        if not sources and barcodes is None:
            break
        ends = None
        if barcodes is not None:
            spans = lk.sessions(lk.lift_barcodes(barcodes, parts))
            ends = lk.barcode_ends(spans, size.select("node", "len"), lk.SESSION_GAP)
        edges = lk.pooled_links(lk.evidence(set(sources), sources) if sources else None, ends, min_link)
        edges = materialize(edges, "edges")
        cov = sc.node_coverage(parts, text.select("contig", F.length("seq").alias("len"), "cov"))
        nodes = materialize(size.join(cov, "node").join(sc.node_clusters(parts, label), "node"), "nodes")
        edges = ed.without(edges, ed.same_target(edges))
        edges = ed.until_stable(edges, lambda e: ed.weak_by_rate(e, nodes, tolerance))
        edges = materialize(ed.without(edges, ed.across_clusters(edges, nodes)), "edges")
        repeat = ed.repeats(edges, nodes, tolerance).withColumn("repeat", F.lit(True))
        nodes = nodes.join(repeat, "node", "left").withColumn("repeat", F.coalesce("repeat", F.lit(False)))
        lay = materialize(grown(materialize(nodes.select("node", "len", "cluster", "repeat"), "nodes"), edges, tolerance), "layouts")
        parts = materialize(_expanded(lay, parts), "parts")
        cut = dv.sparse_end_breaks(parts).unionByName(dv.repeat_end_breaks(parts)).unionByName(dv.cluster_breaks(parts, label)).distinct()
        parts = materialize(dv.renumbered_nodes(dv.split_at(parts, cut)).drop("parent"), "parts")
    cuts = ly.part_cuts(parts, overlaps, tolerance)
    rendered = materialize(ly.rendered_parts(cuts, text.select("contig", "seq")), "rendered")
    cov = sc.node_coverage(parts, text.select("contig", F.length("seq").alias("len"), "cov"))
    results = materialize(ly.named(ly.result_sequences(rendered, min_len), cov, read_len, max_k), "results")
    unique = ov.without_contained(results.withColumnRenamed("node", "id"), min(max_k, 31)).withColumnRenamed("id", "node")
    return Scaffolds(parts, unique, ly.component_table(rendered))


def _pair_evidence(mapped: DataFrame, parts: DataFrame, size: DataFrame, insert: int) -> DataFrame:
    """Pair links between nodes with their gaps: insert minus what the mates
    overhang their nodes."""
    f = lk.lift(mapped.select("pair_id", F.col("f_id").alias("id"), F.col("f_off").alias("offset")), parts).select(
        "pair_id", F.col("id").alias("f_id"), F.col("offset").alias("f_off"))
    r = lk.lift(mapped.select("pair_id", F.col("r_id").alias("id"), F.col("r_off").alias("offset")), parts).select(
        "pair_id", F.col("id").alias("r_id"), F.col("offset").alias("r_off"))
    l = mp.pair_links(f.join(r, "pair_id"))
    a = size.select(F.col("node").alias("_a"), F.col("len").alias("l1"))
    b = size.select(F.col("node").alias("_b"), F.col("len").alias("l2"))
    j = l.withColumn("_a", F.abs("id1")).withColumn("_b", F.abs("id2")).join(a, "_a").join(b, "_b")
    over1 = F.when(F.col("id1") > 0, F.col("l1") - F.col("off1")).otherwise(F.col("off1") + 1)
    # id2 is turned, so its mate reads towards its start
    over2 = F.when(F.col("id2") < 0, F.col("l2") - F.col("off2")).otherwise(F.col("off2") + 1)
    return j.select("id1", "id2", (F.lit(insert) - over1 - over2).cast("bigint").alias("gap"), F.lit(1).cast("bigint").alias("score"))


def _expanded(lay: DataFrame, parts: DataFrame) -> DataFrame:
    """Layouts of nodes as part lists again, parts of turned nodes reversed."""
    p = parts.select(F.col("node").alias("_n"), "contig", F.col("start").alias("ps"), F.col("end").alias("pe"))
    j = lay.withColumn("_n", F.abs("node")).join(p, "_n")
    plus = F.col("node") > 0
    s = F.when(plus, F.col("start") + F.col("ps")).otherwise(F.col("end") - F.col("pe"))
    e = F.when(plus, F.col("start") + F.col("pe")).otherwise(F.col("end") - F.col("ps"))
    rows = j.select(F.col("scaffold").alias("node"), F.when(plus, F.col("contig")).otherwise(-F.col("contig")).alias("contig"), s.alias("start"), e.alias("end"))
    # number the parts of every scaffold by a running count over ordered blocks
    from ..operators.skew import ordered_blocks, running_sum
    b = ordered_blocks(rows.withColumn("_one", F.lit(1)), ["node"], ["start", "end", "contig"], "expand")
    run = running_sum(b, ["node"], ["start", "end", "contig"], "_one", "n")
    return run.select("node", (F.col("n") - 1).cast("int").alias("idx"), "contig", "start", "end")


def close_gaps(scaffolds: DataFrame, reads: DataFrame, mates: DataFrame | None = None, insert: int = 0, sd: int = 0, word: int = 31,
               ks: Sequence[int] = (20,), min_cov: int = gc.MIN_LOCAL_COVERAGE) -> DataFrame:
    """Scaffolds (node, seq) with gaps filled: first by reads that span a gap
    (reads: read_id, seq), then by gathered reads (mates: node, strand, pos,
    read_id, seq on the scaffold strand)."""
    g = materialize(gc.gaps(scaffolds), "gaps")
    flank = g.select("gap_id", F.col("head").alias("left"), F.col("tail").alias("right"))
    small = materialize(gc.close_small(g, mp.gap_spanning_reads(reads, flank, word)).select(
        "gap_id", "seq", "shrink", F.lit(0).cast("bigint").alias("remain")), "small")
    closed = small
    if mates is not None:
        left = materialize(g.join(small.select("gap_id"), "gap_id", "left_anti"), "open-gaps")
        found = gc.gather(mates, left, insert, sd).join(mates.select("read_id", "seq"), "read_id")
        closed = small.unionByName(gc.close_with_reads(left, materialize(found, "gathered"), ks, min_cov))
    return gc.apply_closures(scaffolds, g, closed)


def cluster_scaffold(contigs: DataFrame, **kw) -> Scaffolds:
    """Scaffolding that never joins different composition clusters."""
    g = cluster(contigs.select(F.col("contig_id").alias("id"), "seq", "cov"))
    return scaffold(contigs, clusters=g.select((F.col("id") + 1).alias("contig"), "cluster"), **kw)


def cluster_fill(scaffolds: DataFrame, reads: DataFrame, prefix: int = 31, cluster: str = "cluster", **kw) -> DataFrame:
    """Gap closing, then removal of contained sequences inside each cluster."""
    filled = close_gaps(scaffolds, reads, **kw).join(scaffolds.select("node", cluster), "node")
    return ov.without_contained(filled, prefix, "node", cluster)


def phase(contigs: DataFrame, overlaps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bubble arms of the overlap graph with the arm to keep: (node, opposite,
    primary)."""
    pairs = materialize(sc.bubble_pairs(overlaps), "bubbles")
    both = pairs.unionByName(pairs.select(F.abs("opposite").alias("node"), (F.signum("opposite").cast("bigint") * F.col("node")).alias("opposite")))
    second = ed.secondary_arms(both.select("node", F.abs("opposite").alias("opposite")), nodes).withColumn("second", F.lit(True))
    return both.join(second, "node", "left").select("node", "opposite", F.col("second").isNull().alias("primary"))


def consensus(contigs: DataFrame, **kw) -> Scaffolds:
    """Scaffolding without haplotype separation."""
    return scaffold(contigs, **kw)


def iterate(contigs: DataFrame, reads: DataFrame, pairs: DataFrame, k: int = 31, rounds: int = 5, **kw) -> DataFrame:
    """Rounds of merging, coverage trimming, scaffolding and gap closing:
    (contig_id, seq, cov)."""
    for _ in range(rounds):
        merged = merge_contigs(contigs, k)
        ids = dense_ids(merged.select("seq").distinct(), "seq", "contig_id", "contigs")
        base = materialize(ids.join(merged.select("seq", "cov"), "seq").select("contig_id", "seq", "cov"), "contigs")
        cut = cov_trim(base, reads, min(k, 25), min_len=k)
        ids = dense_ids(cut.select("seq").distinct(), "seq", "contig_id", "contigs")
        cut = materialize(ids.join(cut.groupBy("seq").agg(F.max("cov").alias("cov")), "seq").select("contig_id", "seq", F.greatest("cov", F.lit(1)).alias("cov")), "contigs")
        s = scaffold(cut, pairs, seed=min(k, 31), min_len=k, max_k=k, **kw)
        filled = close_gaps(s.results.select("node", "seq"), reads, word=min(k, 31))
        pieces = filled.select(F.explode(F.filter(F.split("seq", "N+"), lambda p: F.length(p) >= k)).alias("seq")).distinct()
        ids = dense_ids(pieces, "seq", "contig_id", "contigs")
        contigs = materialize(ids.select("contig_id", "seq", F.lit(1).alias("cov")), "contigs")
    return contigs


class Pipeline:
    """Named stages that are written once; a stage with a done marker is read
    back instead of run again. ``skip`` leaves stages out."""

    def __init__(self, spark: SparkSession, folder: str, skip: Sequence[str] = ()):
        self.spark, self.folder, self.skip = spark, folder.rstrip("/"), set(skip)

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def stage(self, name: str, run, given: DataFrame | None = None) -> DataFrame | None:
        if name in self.skip:
            return given
        path = f"{self.folder}/{name}"
        # the committed output carries the marker
        if not self._exists(f"{path}/_SUCCESS"):
            run().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def run(self, reads: DataFrame, pairs: DataFrame, ks: Sequence[int] | None = None, out: str | None = None, number: int | None = None,
            min_len: int = 500) -> DataFrame:
        """Assembly, iteration, binning, scaffolding with bins, gap closing and
        the final FASTA with cluster names."""
        def first():
            a = assemble(reads, ks)
            t = a.contigs.select("seq", F.floor(F.col("cov") + 0.5).cast("int").alias("cov"))
            return dense_ids(t.select("seq").distinct(), "seq", "contig_id", "contigs").join(t, "seq").select("contig_id", "seq", "cov")

        contigs = self.stage("contig", first)
        contigs = self.stage("iterate", lambda: iterate(contigs, reads, pairs, rounds=1), contigs)
        bins = self.stage("binning", lambda: cluster(contigs.select(F.col("contig_id").alias("id"), "seq", "cov"), min_len, number))
        label = bins.select((F.col("id") + 1).alias("contig"), "cluster") if bins is not None else None
        results = self.stage("scaffold", lambda: scaffold(contigs, pairs, clusters=label, min_len=1).results,
                             contigs.select((F.col("contig_id") + 1).alias("node"), F.concat(F.lit("seq"), "contig_id").alias("name"), "seq"))
        final = self.stage("gap_close", lambda: close_gaps(results.select("node", "seq"), reads).join(results.select("node", "name"), "node"), results)
        if out:
            wr.write_fasta(wr.reformed(final.select("name", "seq")), out, min_len=1)
        return final
