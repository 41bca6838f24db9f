"""Expected links between nodes that have gaps: reads lie only on stretches
without a gap, so the fragments that can join two nodes are counted over pairs of
stretches.

For a pair of stretches the fragments of length L are counted by a trapezoid over
L. Summed over an insert distribution that is four values of its double running
sum, so an edge costs four lookups for each pair of stretches within reach of the
longest insert, whatever their lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import lagged, ordered_blocks, running_sum


def gapless_stretches(parts: DataFrame) -> DataFrame:
    """Parts (node, start, end: half open) that touch or overlap become one stretch
    (node, start, end). No part may lie inside another one."""
    blocks = ordered_blocks(parts.select("node", "start", "end").distinct(), ["node"], ["start", "end"], "stretches")
    cut = lagged(blocks, ["node"], ["start", "end"], {"end": "before"})
    new = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    run = running_sum(cut.withColumn("new", new), ["node"], ["start", "end"], "new", "stretch")
    return run.groupBy("node", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def insert_sums(inserts: DataFrame) -> DataFrame:
    """Double running sum of an insert distribution (insert, n), for each length
    from the shortest to the longest: (at, h), h = sum of n * (at - insert + 1) over
    the inserts up to ``at``. The table is as long as the range of the inserts."""
    top = inserts.agg(F.max("insert").alias("top"))
    open_ = inserts.groupBy("insert").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(top))     # one row
    return (open_.select("insert", "n", F.explode(F.sequence("insert", "top")).alias("at"))
            .groupBy("at").agg(F.sum(F.col("n") * (F.col("at") - F.col("insert") + 1)).cast("long").alias("h")))


def _laid(edges: DataFrame, stretches: DataFrame, lengths: DataFrame, end: str) -> DataFrame:
    """Stretches of one node of each edge on a line where node 1 ends at 0 and
    node 2 begins at the gap, both turned as the edge has them."""
    e = edges.withColumn("node", F.abs(end)).join(lengths.select("node", "len"), "node").join(stretches, "node")
    turned = F.col(end) < 0
    start = F.when(turned, F.col("len") - F.col("end")).otherwise(F.col("start"))
    stop = F.when(turned, F.col("len") - F.col("start")).otherwise(F.col("end"))
    shift = -F.col("len") if end == "id1" else F.col("gap")
    return e.select("id1", "id2", (start + shift).cast("long").alias("from"), (stop + shift).cast("long").alias("to"))


def fragment_ways(edges: DataFrame, stretches: DataFrame, lengths: DataFrame, inserts: DataFrame, read_len: int) -> DataFrame:
    """Edges (id1, id2, gap) with ``ways``: the number of places of fragments, each
    length taken ``n`` times, whose first read lies on a stretch of node 1 and whose
    second read lies on one of node 2. 0 where no fragment reaches."""
    sums = insert_sums(inserts)
    ends = inserts.agg(F.max("insert").cast("long").alias("top"), F.min("insert").cast("long").alias("low"), F.sum("n").cast("long").alias("total"))
    last = sums.agg(F.max_by("h", "at").alias("full"))
    whole = F.broadcast(ends.crossJoin(last))       # one row
    e = edges.select("id1", "id2", "gap").crossJoin(whole.select("top"))
    long_enough = F.col("to") - F.col("from") >= read_len
    # only stretches that the longest insert can reach from the other node meet
    one = _laid(e, stretches, lengths, "id1").where(long_enough)
    two = _laid(e, stretches, lengths, "id2").where(long_enough)
    near = e.select("id1", "id2", "gap", "top")
    one = one.join(near, ["id1", "id2"]).where(F.col("to") - read_len > F.col("gap") + read_len - F.col("top") - 1).select("id1", "id2", F.col("from").alias("f1"), F.col("to").alias("t1"))
    two = two.join(near, ["id1", "id2"]).where(F.col("from") + read_len < F.col("top")).select("id1", "id2", F.col("from").alias("f2"), F.col("to").alias("t2"))
    p0, p1 = F.col("f1"), F.col("t1") - read_len
    e0, e1 = F.col("f2") + read_len, F.col("t2")
    corner = lambda sign, x: F.struct(F.lit(sign).alias("sign"), x.cast("long").alias("x"))
    corners = F.array(corner(1, e1 - p0), corner(-1, e1 - p1 - 1), corner(-1, e0 - 1 - p0), corner(1, e0 - p1 - 2))
    at = (one.join(two, ["id1", "id2"]).select("id1", "id2", F.explode(corners).alias("c")).select("id1", "id2", "c.*")
          .groupBy("id1", "id2", "x").agg(F.sum("sign").alias("sign")).where("sign <> 0").crossJoin(whole).where("x >= low"))
    value = F.when(F.col("x") > F.col("top"), F.col("full") + (F.col("x") - F.col("top")) * F.col("total")).otherwise(F.col("h"))
    ways = at.join(sums, at["x"] == sums["at"], "left").groupBy("id1", "id2").agg(F.sum(F.col("sign") * value).cast("long").alias("ways"))
    return edges.join(ways, ["id1", "id2"], "left").na.fill(0, ["ways"])


def expected_over_stretches(edges: DataFrame, stretches: DataFrame, lengths: DataFrame, inserts: DataFrame, read_len: int) -> DataFrame:
    """Edges (id1, id2, gap, cov) with ``expected``: links when reads of ``cov``
    start evenly on the stretches."""
    total = inserts.agg(F.sum("n").alias("total"))
    w = fragment_ways(edges, stretches, lengths, inserts, read_len).crossJoin(F.broadcast(total))      # one row
    return w.withColumn("expected", F.col("cov") * F.col("ways") / (F.lit(2.0 * read_len) * F.col("total"))).drop("ways", "total")


def below_gapless_expectation(edges: DataFrame) -> DataFrame:
    """Edges with fewer links than half of their whole ``expected`` number."""
    return edges.where(F.col("n_link") < F.floor(F.floor(F.col("expected") + 0.5) / 2.0 + 0.5))
