"""Bubble arms merged by aligning their layouts.

An arm is a node, a list of parts (contigs with strand and order). Two arms of a
bubble share parts and differ in stretches between them. The parts they share in
the same order are a longest common subsequence of two signed contig lists;
between two shared parts each arm has a stretch, maybe an empty one. Of two
stretches the one of lower coverage is crushed, a stretch that only one arm has
stays, and the arms become one layout.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def common_parts(i: list[int], j: list[int]) -> list[tuple[int, int]]:
    """A longest chain of matches (i, j) that ascends in both. Of equally long
    chains the one that ends at the smallest j at every length."""
    order = sorted(range(len(i)), key=lambda k: (i[k], -j[k]))
    tails: list[int] = []
    last: list[int] = []
    before: dict[int, int] = {}
    for k in order:
        at = bisect_left(tails, j[k])
        before[k] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(j[k])
            last.append(k)
        else:
            tails[at], last[at] = j[k], k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append((i[k], j[k]))
        k = before[k]
    return out[::-1]


def arms(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each pair with the parts of both arms in order, the second one
    turned when its sign says so: node, opposite, one, two (arrays of idx, contig,
    len, cov). Parts are collected to arms before they travel to their pair."""
    own = parts.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("idx", "contig", "len", "cov"))).alias("one"))
    other = F.abs("opposite").alias("_o")
    two = pairs.select("node", "opposite", other).join(own.select(F.col("node").alias("_o"), F.col("one").alias("two")), "_o").drop("_o")
    # an arm turned round counts from its last part
    turned = lambda x: F.struct((F.element_at("two", -1)["idx"] - x["idx"]).alias("idx"), (-x["contig"]).alias("contig"), x["len"].alias("len"), x["cov"].alias("cov"))
    two = two.withColumn("two", F.when(F.col("opposite") < 0, F.transform(F.reverse("two"), turned)).otherwise(F.col("two")))
    return own.join(two, "node").select("node", "opposite", "one", "two")


def matches(one: list[int], two: list[int]) -> tuple[list[int], list[int]]:
    """Places (i, j) where the arms have the same signed contig."""
    places: dict[int, list[int]] = {}
    for j, c in enumerate(two):
        if c is not None:
            places.setdefault(c, []).append(j)
    found = [(i, j) for i, c in enumerate(one) for j in places.get(c, ())]
    return [i for i, _ in found], [j for _, j in found]


def _chained(one: Column, two: Column) -> Column:
    """The shared parts as places (i, j) in both arms."""
    def lists(column: pa.Array) -> Iterator[list[int]]:
        values, cuts = column.values.to_pylist() if column.values.null_count else column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
        return (values[a:b] for a, b in zip(cuts, cuts[1:]))

    def chain(one: pa.Array, two: pa.Array) -> pa.Array:
        found, cuts = [], [0]
        for a, b in zip(lists(one), lists(two)):
            found += common_parts(*matches(a, b))
            cuts.append(len(found))
        places = pa.StructArray.from_arrays([pa.array([p[k] for p in found], pa.int32()) for k in (0, 1)], ["i", "j"])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), places)

    return F.arrow_udf(chain, "array<struct<i:int,j:int>>")(one, two)


def merge_arms(pairs: DataFrame, parts: DataFrame, homo_max: float, hetero_max: float) -> tuple[DataFrame, DataFrame]:
    """Merged layouts and what was crushed.

    pairs: (node, opposite signed), each node in one pair; parts: (node, idx from 0,
    contig signed, len, cov). Arms merge when they share their first and their last
    part (two different contigs), differ in at least one two-sided stretch, and every
    such stretch lies between shared parts of a coverage below ``homo_max`` and has
    length-weighted coverages of at most ``hetero_max`` on both sides. At equal
    coverage the second arm gives way.

    Result: layouts (node, opposite, idx, contig, len, cov, arm: 0 for shared parts,
    node_cov: length-weighted coverage of the merged layout) and crushed (node,
    opposite, stretch, idx, contig, len, cov, arm). Other pairs are left as they are.

    A pair is one row from the aggregation that builds its arms on: only pairs that
    merge are written, as the stretches between their shared parts."""
    ends = lambda k: F.element_at("one", k)["contig"] == F.element_at("two", k)["contig"]
    t = arms(pairs, parts).where(ends(1) & ends(-1) & (F.abs(F.element_at("one", 1)["contig"]) != F.abs(F.element_at("one", -1)["contig"]))
                                 & ((F.col("one.contig") != F.col("two.contig")) | F.exists("one.contig", F.isnull)))
    t = t.withColumn("m", _chained(F.col("one.contig"), F.col("two.contig"))).where(F.size("m") > 1)
    at = lambda k: F.element_at("m", k)
    t = t.where((at(1)["i"] == 0) & (at(1)["j"] == 0) & (at(-1)["i"] == F.size("one") - 1) & (at(-1)["j"] == F.size("two") - 1))
    # the k-th stretch: the shared part before it and what each arm has up to the next one
    between = lambda arm, c, k: F.slice(arm, F.col("m")[k - 1][c] + 2, F.col("m")[k][c] - F.col("m")[k - 1][c] - 1)
    stretch = lambda k: F.struct(k.alias("stretch"), F.col("one")[F.col("m")[k - 1]["i"]].alias("left"), F.col("one")[F.col("m")[k]["i"]].alias("right"),
                                 between("one", "i", k).alias("p1"), between("two", "j", k).alias("p2"))
    total = lambda x, f: F.aggregate(F.filter(x, lambda p: f(p).isNotNull()), F.lit(None).cast("double"), lambda a, p: F.coalesce(a, F.lit(0.0)) + f(p))
    mean = lambda x: total(x, lambda p: p["len"] * p["cov"]) / total(x, lambda p: p["len"])
    t = t.select("node", "opposite", F.element_at("one", -1).alias("last"), F.transform(F.sequence(F.lit(1), F.size("m") - 1), stretch).alias("s"))
    t = t.withColumn("s", F.transform("s", lambda x: x.withField("c1", mean(x["p1"])).withField("c2", mean(x["p2"])).withField("forked", (F.size(x["p1"]) > 0) & (F.size(x["p2"]) > 0))))
    fine = lambda x: (x["left"]["cov"] < homo_max) & (x["right"]["cov"] < homo_max) & (x["c1"] <= hetero_max) & (x["c2"] <= hetero_max)
    good = F.exists("s", lambda x: x["forked"]) & ~F.exists("s", lambda x: F.coalesce(x["forked"] & ~fine(x), F.lit(False)))
    t = materialize(t.where(good), "merged-arms")
    gone = lambda x: F.when(x["forked"], F.when(F.coalesce(x["c1"] < x["c2"], F.lit(False)), 1).otherwise(2)).otherwise(0)
    as_arm = lambda parts, n: F.transform(parts, lambda p: F.struct(*[p[c].alias(c) for c in ("contig", "len", "cov")], F.lit(n).alias("arm")))
    none = lambda x, n: F.when(gone(x) == n, F.slice(x[f"p{n}"], 1, 0)).otherwise(x[f"p{n}"])
    # a shared part comes before its stretch; a stretch of one arm has that arm's order
    whole = F.flatten(F.transform("s", lambda x: F.concat(as_arm(F.array(x["left"]), 0), as_arm(none(x, 1), 1), as_arm(none(x, 2), 2))))
    layout = t.select("node", "opposite", F.concat(whole, as_arm(F.array("last"), 0)).alias("p"))
    layout = layout.select("node", "opposite", mean(F.col("p")).alias("node_cov"), F.posexplode("p").alias("idx", "p")).select("node", "opposite", "idx", "p.*", "node_cov")
    x = F.col("x")
    crushed = t.select("node", "opposite", F.explode("s").alias("x")).where("x.forked").select(
        "node", "opposite", x["stretch"].cast("long").alias("stretch"), gone(x).alias("arm"), F.explode(F.when(gone(x) == 1, x["p1"]).otherwise(x["p2"])).alias("p"))
    return layout, crushed.select("node", "opposite", "stretch", "p.*", "arm")
