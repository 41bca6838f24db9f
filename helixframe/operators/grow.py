"""Layouts that grow from seeds in order, for all parts of the graph at once.

Seeds are taken by node id. A seed takes the nearest candidate (steps from the seed,
then distance) that lies apart from all it has, and candidates of a taken node join the
queue; a node belongs to the first seed that takes it. Growth only passes through nodes
that are no repeats, so two seeds can only meet inside one component of these nodes:
every round grows the smallest free seed of each component, all of them side by side,
and the nodes that are still free fall into smaller components for the next round.
Inside a round all layouts move by one step at a time. The candidates of one step are
settled by key: one is taken when no earlier candidate that is still open could
exclude it. Nothing is gathered: a layout is a set of rows.

The number of rounds is the number of layouts that the largest component gives, the
number of steps the depth of the longest layout. Cut colliding edges before
(``edges.weak_by_rate`` and its kin), so that components are close to single layouts;
``scaffold.grow_layouts`` joins everywhere at once where that order does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, is_empty, materialize
from .scaffold import directed

KEY = ("near", "node", "strand", "start")
PACK = 8


def _dealt(df: DataFrame) -> DataFrame:
    """The other side of a join of a step. There are many steps, so a side that the
    planner would hand to all tasks passes through the driver once a step; both
    sides are dealt by key instead."""
    return df.hint("merge")


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that ``pairs`` (a, b) connect it with.

    Each round a node takes the smallest root among its neighbours' and hands it to
    its own old root, then roots are followed one step: depth halves as it goes.
    """
    both = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    at = materialize(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        heard = both.join(_dealt(at.select(F.col("node").alias("b"), "root")), "b").groupBy("a").agg(F.min("root").alias("low"))
        seen = at.join(_dealt(heard), F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", "low").alias("low"))
        told = seen.where("low < root").groupBy("root").agg(F.min("low").alias("told")).withColumnRenamed("root", "node")
        new = seen.join(_dealt(told), "node", "left").select("node", F.least("root", "low", "told").alias("root"))
        new = materialize(new, "heard")
        up = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new2 = materialize(new.join(_dealt(up), "root", "left").select("node", F.least("root", "up").alias("root")), "roots")
        moved = not is_empty(new2.join(_dealt(at.withColumnRenamed("root", "old")), "node").where("root <> old"))
        discard(new)
        discard(at)
        at = new2
        if not moved:
            discard(both)
            return at


def _bins(width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col("start") / width), F.greatest(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))


def _lie_on(x: str, y: str, tolerance: int) -> Column:
    """Two intervals share more than the tolerance at either end."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return ((c(x, "start") < c(y, "end")) & (c(x, "end") > c(y, "start"))
            & (F.abs(c(x, "start") - c(y, "end")) > tolerance) & (F.abs(c(x, "end") - c(y, "start")) > tolerance))


def _against(open_: DataFrame, taken: DataFrame, tolerance: int, width: int) -> DataFrame:
    """Open candidates that nothing taken in the same layout excludes."""
    same = taken.where("not repeat").select("seed", "node")
    placed = taken.where("repeat").select("seed", "node", "strand", "start")
    named = taken.where("cluster <> 0").select("seed", F.col("cluster").alias("_c")).distinct()
    t = open_.join(_dealt(same), ["seed", "node"], "left_anti").join(_dealt(placed), ["seed", "node", "strand", "start"], "left_anti").join(_dealt(named), "seed", "left").where(
        "_c is null or cluster = 0 or cluster = _c").drop("_c")
    x = t.select("seed", *KEY, "end", _bins(width).alias("_w"))
    y = taken.select("seed", "start", "end", _bins(width).alias("_w"))
    hit = x.alias("x").join(_dealt(y.alias("y")), ["seed", "_w"]).where(_lie_on("x", "y", tolerance)).select("seed", *[F.col(f"x.{k}").alias(k) for k in KEY]).distinct()
    return t.join(_dealt(hit), ["seed", *KEY], "left_anti")


def _free_of_earlier(open_: DataFrame, tolerance: int, width: int) -> DataFrame:
    """Open candidates that no earlier open candidate of the layout could exclude."""
    t = open_.withColumn("key", F.struct(*KEY))
    first = t.where("not repeat").groupBy("seed", "node").agg(F.min("key").alias("_k"))
    t = t.join(_dealt(first), ["seed", "node"], "left").where("_k is null or key = _k").drop("_k")
    # clusters: only the first candidate with a cluster may settle that of the layout
    named = open_.where("cluster <> 0").groupBy("seed").agg(
        F.min(F.struct(F.struct(*KEY).alias("k"), "cluster")).alias("f"), F.count_distinct("cluster").alias("n")).where("n > 1").select(
        "seed", F.col("f.k").alias("_k"))
    t = t.join(_dealt(named), "seed", "left").where("_k is null or cluster = 0 or key = _k").drop("_k")
    x = t.select("seed", "key", "start", "end", _bins(width).alias("_w"))
    y = open_.select("seed", F.struct(*KEY).alias("key"), "start", "end", _bins(width).alias("_w"))
    hit = x.alias("x").join(_dealt(y.alias("y")), ["seed", "_w"]).where((F.col("y.key") < F.col("x.key")) & _lie_on("x", "y", tolerance)).select(
        "seed", F.col("x.key").alias("key")).distinct()
    return t.join(_dealt(hit), ["seed", "key"], "left_anti").drop("key")


def _grown(seeds: DataFrame, steps: DataFrame, tolerance: int, width: int) -> DataFrame:
    """Whole layouts of seeds that cannot meet: (seed, node, strand, start, end, repeat, cluster).
    Every ``PACK`` steps the rows of layouts that still grow are written together
    and those of finished layouts put aside."""
    cols = ["seed", "node", "strand", "start", "end", "repeat", "cluster"]
    front = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(1).alias("strand"), F.lit(0).cast("bigint").alias("start"),
                                     F.col("len").alias("end"), "repeat", "cluster"), "layout")
    taken, done, depth = front, None, 0
    while True:
        a = front.where("not repeat").select("seed", F.col("node").alias("_a"), F.col("strand").alias("_s"), F.col("start").alias("_b"), F.col("end").alias("_e"))
        turn = F.col("dir") * F.col("_s")
        start = F.when(turn > 0, F.col("_e") + F.col("gap")).otherwise(F.col("_b") - F.col("gap") - F.col("len"))
        new = steps.join(_dealt(a), "_a").select("seed", "node", (F.col("vdir") * turn).alias("strand"), start.alias("start"),
                                         (start + F.col("len")).alias("end"), "repeat", "cluster").distinct().withColumn("near", F.abs("start"))
        open_ = materialize(_against(new.select(*cols, "near"), taken, tolerance, width), "candidates")
        front = None
        while not is_empty(open_):
            got = materialize(_free_of_earlier(open_, tolerance, width).select(*cols, "near"), "taken")
            front = got.select(*cols) if front is None else front.unionByName(got.select(*cols))
            taken = taken.unionByName(got.select(*cols))
            left = open_.join(_dealt(got.select("seed", *KEY)), ["seed", *KEY], "left_anti")
            # what was taken before excludes nothing more: only the new rows do, and the cluster
            left = materialize(_against(left.select(*cols, "near"), got.select(*cols), tolerance, width), "candidates")
            discard(open_)
            open_ = left
        discard(open_)
        if front is None:
            return taken if done is None else done.unionByName(taken)
        depth += 1
        if depth % PACK == 0:
            live = front.select("seed").distinct()
            rest = materialize(taken.join(_dealt(live), "seed", "left_anti"), "finished")
            done = rest if done is None else done.unionByName(rest)
            taken = materialize(taken.join(_dealt(live), "seed", "left_semi"), "layout")


def layouts_in_seed_order(nodes: DataFrame, edges: DataFrame, tolerance: int) -> DataFrame:
    """Scaffolds as a scan over the seeds makes them: (scaffold, node signed, start, end).

    ``nodes`` is (node, len, cluster, repeat), ``edges`` (id1, id2 signed, gap).

    * Seeds: nodes that are no repeats and belong to no earlier layout, by id.
    * Candidates: by steps from the seed, then distance of the start from the seed's
      start (then node, strand, start). One is left out when its node belongs to a
      layout, when it lies on a part of the layout beyond the tolerance, or when its
      cluster is another one than the layout's (0 goes with all).
    * Repeats may stand in many layouts and several times in one; growth does not pass
      through them and they are cut from both ends. A repeat that is left inside no
      layout stays alone.
    * Edges with an unknown end, null gaps, and edges of a node with itself are not
      used; repeated edges count once.
    """
    n = materialize(nodes.select("node", F.col("len").cast("bigint").alias("len"), F.coalesce("cluster", F.lit(0)).alias("cluster"),
                                 F.coalesce("repeat", F.lit(False)).alias("repeat")), "nodes")
    d = directed(edges.select("id1", "id2", F.col("gap").cast("bigint").alias("gap"))).where("abs(u) <> abs(v) and gap is not null")
    d = d.select(F.abs("u").alias("_a"), F.signum("u").cast("int").alias("dir"), F.abs("v").alias("node"), F.signum("v").cast("int").alias("vdir"), "gap").distinct()
    steps = materialize(d.join(_dealt(n), "node").join(_dealt(n.where("not repeat").select(F.col("node").alias("_a"))), "_a", "left_semi"), "steps")
    width = max(4096, 4 * tolerance)
    free, repeats, grown = n.where("not repeat"), n.where("repeat"), None
    while not is_empty(free):
        steps = materialize(steps.join(_dealt(free.select(F.col("node").alias("_a"))), "_a", "left_semi").join(
            _dealt(free.unionByName(repeats).select("node")), "node", "left_semi"), "steps")
        root = components(free, steps.where("not repeat and _a < node").select(F.col("_a").alias("a"), F.col("node").alias("b")))
        seeds = free.join(_dealt(root.where("node = root").select("node")), "node", "left_semi")
        lay = _grown(seeds, steps, tolerance, width)
        lay = materialize(lay, "layouts")
        grown = lay if grown is None else grown.unionByName(lay)
        free = materialize(free.join(_dealt(lay.where("not repeat").select("node")), "node", "left_anti"), "free")
        discard(root)
    if grown is None:
        inside = None
    else:
        own = grown.where("not repeat").groupBy("seed").agg(F.min(F.struct("start", "end", "node", "strand")).alias("lo"),
                                                            F.max(F.struct("start", "end", "node", "strand")).alias("hi"))
        at = F.struct("start", "end", "node", "strand")
        inside = materialize(grown.join(_dealt(own), "seed").where((at >= F.col("lo")) & (at <= F.col("hi"))).select(
            F.col("seed").alias("scaffold"), (F.col("node") * F.col("strand")).alias("node"),
            (F.col("start") - F.col("lo.start")).alias("start"), (F.col("end") - F.col("lo.start")).alias("end")), "inside")
    alone = repeats if inside is None else repeats.join(_dealt(inside.select(F.abs("node").alias("node"))), "node", "left_anti")
    alone = alone.select(F.col("node").alias("scaffold"), "node", F.lit(0).cast("bigint").alias("start"), F.col("len").alias("end"))
    return alone if inside is None else inside.unionByName(alone)
