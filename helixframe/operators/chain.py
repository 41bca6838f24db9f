"""Places of sequences by chains of unique seeds, and bubble arms on results.

A word with one place on the targets gives a hit (place in the query, place in the
target). Hits of a query on a strand of a target that rise on both sides form a
chain; the longest chain is the place, whatever was inserted or lost in between.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.bases import common_trim, revcomp
from .kmers import kmer_rows
from .mapping import top_unless_tied, unique_index
from .skew import join_unique

TILE = 4096


def longest_rise(t: np.ndarray) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    ends, at, before = [], [], []
    for i, x in enumerate(t):
        k = bisect_left(ends, x)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def chains(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Chains of ``queries`` (query, seq) on ``targets`` (target, seq): query, id
    (1-based target with the strand as its sign), hits, and the first and last hit
    in the turned query and in the target (q0, t0, q1, t1), len.

    Hits further apart in the target than the query is long start another chain.
    A group holds the hits of one query, at most one for each of its bases."""
    index = unique_index(targets.withColumnRenamed("target", "contig_id"), k)
    words = kmer_rows(queries.select("query", F.length("seq").cast("int").alias("len"), "seq"), k, keep=["query", "len"], mode="both", positions=True)
    words = words.where("kmer <> rkmer").select("query", "len", "pos", F.least("kmer", "rkmer").alias("kmer"), F.when(F.col("kmer") < F.col("rkmer"), 1).otherwise(-1).alias("strand"))
    same = F.col("strand") == F.col("cstrand")
    hits = join_unique(words, index, ["kmer"]).select(
        "query", "len", F.when(same, F.col("cid")).otherwise(-F.col("cid")).alias("id"),
        F.when(same, F.col("pos")).otherwise(F.col("len") - k - F.col("pos")).cast("int").alias("q"), F.col("cpos").cast("long").alias("t"))
    by = hits.groupBy("query", "len", "id").agg(F.array_sort(F.collect_list(F.struct("q", "t"))).alias("h")).select(
        "query", "len", "id", F.transform("h", lambda x: x["q"]).alias("q"), F.transform("h", lambda x: x["t"]).alias("t"))
    kind = by.schema["query"].dataType.simpleString()

    def rise(batches):
        for b in batches:
            q, t = b.column(3), b.column(4)
            at, qs, ts = q.offsets.to_numpy(), q.values.to_numpy(), t.values.to_numpy()
            size = b.column(1).to_numpy()
            rows, found = [], []
            for i in range(len(b)):
                a, z = qs[at[i]:at[i + 1]], ts[at[i]:at[i + 1]]
                order = np.argsort(z, kind="stable")
                run = np.zeros(len(z), np.int64)
                run[order] = np.concatenate([[0], np.cumsum(np.diff(z[order]) > size[i])])
                for r in range(int(run.max()) + 1):
                    inside = np.flatnonzero(run == r)
                    up = inside[longest_rise(z[inside])]
                    rows.append(i)
                    found.append((len(up), a[up[0]], z[up[0]], a[up[-1]], z[up[-1]]))
            head = b.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            cols = np.array(found, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([*head.columns, *[pa.array(c) for c in cols]], ["query", "len", "id", "hits", "q0", "t0", "q1", "t1"])

    return by.mapInArrow(rise, f"query {kind}, len int, id long, hits long, q0 long, t0 long, q1 long, t1 long")


def place(queries: DataFrame, targets: DataFrame, k: int, min_hits: int = 1) -> DataFrame:
    """Place of the longest chain, none on a tie: query, id, start, end (half open,
    in the target as it stands), hits. Ends beyond the outer hits are taken to have
    the length that they have in the query."""
    best = top_unless_tied(chains(queries, targets, k).where(F.col("hits") >= min_hits), ["query"], "hits")
    return best.select("query", "id", (F.col("t0") - F.col("q0")).alias("start"), (F.col("t1") + F.col("len") - F.col("q1")).alias("end"), "hits")


def texts_of(places: DataFrame, targets: DataFrame) -> DataFrame:
    """``places`` (query, id, start, end) cut to their target, with its text. Targets
    travel as tiles, so a long one is never joined whole."""
    tiles = targets.where(F.length("seq") > 0).select(
        F.col("target").alias("_t"), "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / TILE).cast("int"))).alias("_tile")).select(
        "_t", "_tile", F.expr(f"substring(seq, _tile * {TILE} + 1, {TILE})").alias("_text"))
    p = places.withColumn("start", F.greatest("start", F.lit(0))).where("end > start")
    spread = p.withColumn("_t", F.abs("id") - 1).withColumn("_tile", F.explode(F.expr(f"sequence(cast(start div {TILE} as int), cast((end - 1) div {TILE} as int))")))
    cut = spread.join(tiles, ["_t", "_tile"]).withColumn("_a", F.greatest(F.col("start") - F.col("_tile") * TILE, F.lit(0)).cast("int")).withColumn(
        "_p", F.expr(f"substring(_text, _a + 1, cast(least(end - _tile * {TILE}, {TILE}) as int) - _a)"))
    whole = cut.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_tile", "_p"))).alias("_x"))
    text = whole.select("query", F.array_join(F.transform("_x", lambda x: x["_p"]), "").alias("text"))
    return p.join(text, "query").withColumn("end", F.col("start") + F.length("text"))


def bubbles_on_results(bubbles: DataFrame, results: DataFrame, k: int, min_hits: int = 1) -> DataFrame:
    """What the arms of bubbles change on the results.

    ``bubbles``: (bubble, arm, opposite); the opposite arm is the one that went into
    ``results`` (target, seq). It is placed by its longest chain, ties are not; what
    both arms share at either end is cut off, at most half of the shorter one.
    Result: bubble, target, strand, start, end (half open), arm, removed: the text
    of the arm and the text of the result that it stands for, as the result reads."""
    found = texts_of(place(bubbles.select(F.col("bubble").alias("query"), F.col("opposite").alias("seq")), results, k, min_hits), results)
    arm = F.when(F.col("id") < 0, revcomp("arm")).otherwise(F.col("arm"))
    t = found.join(bubbles.select(F.col("bubble").alias("query"), "arm"), "query").withColumn("arm", arm).withColumn("_c", common_trim("arm", "text"))
    t = t.withColumn("_p", F.col("_c.prefix").cast("int")).withColumn("_s", F.col("_c.suffix").cast("int"))
    inner = lambda x: F.expr(f"substring({x}, _p + 1, greatest(length({x}) - _p - _s, 0))")
    return t.select(F.col("query").alias("bubble"), (F.abs("id") - 1).alias("target"), F.signum("id").cast("int").alias("strand"),
                    (F.col("start") + F.col("_p")).alias("start"), (F.col("end") - F.col("_s")).alias("end"), inner("arm").alias("arm"), inner("text").alias("removed"))
