"""From part lists to result sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bases import revcomp
from .skew import lagged, ordered_blocks, running_sum

MIN_GAP = 10            # fixed values: smallest written gap and joining overlap
JOIN_OVERLAP = 32
BLOCK = 1024


def part_cuts(parts: DataFrame, overlaps: DataFrame, tolerance: int, join_overlap: int = JOIN_OVERLAP) -> DataFrame:
    """Bases to cut from the left of each part and N to write before it.

    Overlapping parts lose the exact overlap when it is longer than
    ``join_overlap``, else they get the smallest gap; parts up to ``tolerance``
    apart are joined by such an overlap as well; other gaps stay as they are.
    """
    from .overlap import lookup_overlap
    blocks = ordered_blocks(parts.select("node", "idx", "contig", "start", "end"), ["node"], ["idx"], "layout-parts")
    t = lagged(blocks, ["node"], ["idx"], {"contig": "p_contig", "end": "p_end"}).drop("_blk")
    first = t.where("p_end is null").select("node", "idx", "contig", F.lit(0).alias("left"), F.lit(0).cast("bigint").alias("gap"))
    o = lookup_overlap(t.where("p_end is not null").withColumn("id1", F.col("p_contig")).withColumn("id2", F.col("contig")), overlaps)
    gap = F.col("start") - F.col("p_end")
    joined = (F.col("overlap") > join_overlap) & (gap <= tolerance)
    rest = o.select("node", "idx", "contig", F.when(joined, F.col("overlap")).otherwise(0).alias("left"),
                    F.when(joined, 0).when(gap < 0, MIN_GAP).otherwise(gap).cast("bigint").alias("gap"))
    return first.unionByName(rest)


def end_overlaps(overlaps: DataFrame) -> DataFrame:
    """Largest recorded overlap on either side of a contig: (contig, l, r)."""
    x = F.explode(F.array(F.struct(F.abs("id1").alias("contig"), (F.col("id1") > 0).alias("right")),
                          F.struct(F.abs("id2").alias("contig"), (F.col("id2") < 0).alias("right"))))
    t = overlaps.select(x.alias("x"), "length").select("x.*", "length")
    side = lambda r: F.coalesce(F.max(F.when(F.col("right") == r, F.col("length"))), F.lit(0))
    return t.groupBy("contig").agg(side(False).alias("l"), side(True).alias("r"))


def rendered_parts(cuts: DataFrame, contigs: DataFrame, trims: DataFrame | None = None) -> DataFrame:
    """Text of each part with its gap: (node, idx, contig, gap, left, text)."""
    last = cuts.groupBy("node").agg(F.max("idx").alias("last"))
    t = cuts.join(last, "node").withColumn("c", F.abs("contig")).join(contigs.select(F.col("contig").alias("c"), "seq"), "c")
    if trims is None:
        t = t.withColumn("cut_l", F.col("left")).withColumn("cut_r", F.lit(0))
    else:
        t = t.join(trims.withColumnRenamed("contig", "c"), "c", "left").na.fill(0, ["l", "r"])
        plus = F.col("contig") > 0
        half = lambda a, b: F.floor(F.when(plus, F.col(a)).otherwise(F.col(b)) / 2).cast("int")
        t = t.withColumn("cut_l", F.when(F.col("idx") == 0, half("l", "r")).otherwise(F.col("left"))).withColumn(
            "cut_r", F.when(F.col("idx") == F.col("last"), half("r", "l")).otherwise(0))
    s = F.when(F.col("contig") > 0, F.col("seq")).otherwise(revcomp("seq"))
    size = F.greatest(F.length("seq") - F.col("cut_l") - F.col("cut_r"), F.lit(0)).cast("int")
    return t.select("node", "idx", "contig", "gap", F.col("cut_l").cast("int").alias("left"), F.substring(s, F.col("cut_l").cast("int") + 1, size).alias("text"))


def result_sequences(rendered: DataFrame, min_len: int) -> DataFrame:
    """Node sequences, parts in order with N for gaps: (node, seq). Parts are
    put together in blocks first, so no group holds more than a block of rows."""
    t = rendered.select("node", "idx", F.concat(F.repeat(F.lit("N"), F.col("gap").cast("int")), "text").alias("text"))
    cat = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "text"))), lambda x: x["text"]), "")
    b = t.groupBy("node", F.floor(F.col("idx") / BLOCK).alias("b")).agg(cat("idx").alias("text"))
    return b.groupBy("node").agg(cat("b").alias("seq")).where(F.length("seq") >= min_len)


def component_table(rendered: DataFrame) -> DataFrame:
    """Where each part lies in its result: (node, start, end, contig, strand).
    Parts joined by an overlap reach back over it."""
    t = rendered.select("node", "idx", "contig", "gap", "left", F.length("text").cast("bigint").alias("n")).withColumn("w", F.col("gap") + F.col("n"))
    run = running_sum(ordered_blocks(t, ["node"], ["idx"], "bed"), ["node"], ["idx"], "w", "stop")
    start = F.col("stop") - F.col("n")
    back = F.when((F.col("idx") > 0) & (F.col("gap") == 0), F.col("left")).otherwise(0)
    return run.select("node", (start - back).alias("start"), F.col("stop").alias("end"), F.abs("contig").alias("contig"),
                      F.when(F.col("contig") < 0, "-").otherwise("+").alias("strand"))


def named(results: DataFrame, coverage: DataFrame, read_len: int, max_k: int) -> DataFrame:
    """Results with names scaffold<n>_len.._cov.., numbered in node order."""
    from ..sources.readers import dense_ids
    ids = dense_ids(results.select("node").distinct(), "node", "n", "scaffolds")
    t = results.join(ids, "node").join(coverage.select("node", "cov"), "node", "left").na.fill(1, ["cov"])
    return t.select("node", F.concat(F.lit("scaffold"), "n", F.lit("_len"), F.length("seq"), F.lit("_cov"), F.round("cov").cast("bigint"),
                                     F.lit(f"_read{read_len}_maxK{max_k}")).alias("name"), "seq")


def pieces_at(contigs: DataFrame, points: DataFrame, min_len: int, key: str = "contig") -> DataFrame:
    """Contigs cut at stored points: (key, start, end, seq)."""
    from .coverage import pieces_between
    p = pieces_between(points, contigs, min_len, key)
    return p.join(contigs.select(key, "seq"), key).select(
        key, "start", "end", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"))
