"""Composition profiles and clustering of sequences.

A profile has a fixed width (256 four-base words, or 64 codons and 4096 codon
pairs), so a row per sequence holds it; only profiles of pivots and cluster
sums, a number of rows set by the number of clusters, travel to all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import is_empty, materialize
from .kmers import kmer_rows

ORDER = 4                       # fixed values of composition clustering
WORDS = 4 ** ORDER
STOP_CODONS = (48, 50, 56)
EXPECTED_GENOME = 3_000_000
MIN_LENGTH = 1200
TILE_TASKS = 2000       # tasks that share the tiles of a distance matrix, at most


def word_classes() -> list[int]:
    """Canonical word of each of the 256 words."""
    out = []
    for w in range(WORDS):
        turned, x = 0, w
        for _ in range(ORDER):
            turned = turned * 4 + 3 - x % 4
            x //= 4
        out.append(min(w, turned))
    return out


def spectra(seqs: DataFrame, key: str = "id") -> DataFrame:
    """Per sequence: ``counts`` of each word's class plus one, ``freq`` of a word
    given its first three bases, and ``nc``, the number of words plus classes."""
    classes = word_classes()
    n = kmer_rows(seqs, ORDER, keep=[key]).groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))
    # at most 136 classes a sequence
    m = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("m"), F.sum("n").alias("s"))
    table = F.array(*[F.lit(c).cast("bigint") for c in classes])
    t = seqs.select(key).join(m, key, "left")
    counts = F.transform(table, lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(0)).cast("double") + 1.0)
    t = t.select(key, counts.alias("counts"), (F.coalesce("s", F.lit(0)) + len(set(classes))).alias("nc"))
    pre = F.transform(F.sequence(F.lit(0), F.lit(WORDS // 4 - 1)), lambda p: F.lit(4.0) + F.get("counts", p * 4) + F.get(
        "counts", p * 4 + 1) + F.get("counts", p * 4 + 2) + F.get("counts", p * 4 + 3))
    t = t.withColumn("_pre", pre)
    freq = F.transform("counts", lambda x, i: x / F.get("_pre", F.floor(i / 4).cast("int")))
    return t.select(key, "counts", freq.alias("freq"), "nc")


def _frame(seqs: DataFrame, k: int, key: str):
    """Codon windows of coding sequences: an opening ATG-like codon is skipped."""
    start = F.when(F.substring("seq", 2, 2) == "TG", 3).otherwise(0)
    s = seqs.select(key, F.length("seq").alias("_len"), start.alias("_k"), "seq")
    rows = kmer_rows(s, k, keep=[key, "_len", "_k"], mode="forward", positions=True)
    return rows.where((F.col("pos") >= F.col("_k")) & ((F.col("pos") - F.col("_k")) % 3 == 0))


def codon_counts(seqs: DataFrame, key: str = "id") -> DataFrame:
    """(key, codon, n) without stop codons."""
    rows = _frame(seqs, 3, key)
    # the pair loop ends six bases before the end; one more codon follows
    last = F.greatest(F.col("_k"), F.col("_k") + F.ceil((F.col("_len") - 6 - F.col("_k")) / 3) * 3)
    ok = (F.col("pos") <= last) & ~F.col("kmer").isin(*STOP_CODONS)
    return rows.where(ok).groupBy(key, F.col("kmer").alias("codon")).agg(F.count(F.lit(1)).alias("n"))


def codon_pairs(seqs: DataFrame, key: str = "id") -> DataFrame:
    """(key, first, second, n, share): neighbouring codons without stops, with
    the share among pairs of the same first codon."""
    rows = _frame(seqs, 6, key).where(F.col("pos") < F.col("_len") - 6)
    a, b = F.shiftright("kmer", 6), F.col("kmer").bitwiseAND(F.lit(63))
    t = rows.select(key, a.alias("first"), b.alias("second")).where(
        ~F.col("first").isin(*STOP_CODONS) & ~F.col("second").isin(*STOP_CODONS))
    g = t.groupBy(key, "first", "second").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key, "first")))


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                              F.lit(0.0), lambda s, v: s + v))


def pair_distances(pairs: DataFrame, vectors: DataFrame, vec: str = "freq", key: str = "id") -> DataFrame:
    """Euclidean distance of the named pairs (id1, id2), e.g. the two ends of an edge."""
    a = vectors.select(F.col(key).alias("id1"), F.col(vec).alias("_a"))
    b = vectors.select(F.col(key).alias("id2"), F.col(vec).alias("_b"))
    return pairs.join(a, "id1").join(b, "id2").withColumn("distance", _distance("_a", "_b")).drop("_a", "_b")


def _packed(t: pa.Table, tile: int, blocks: int, code: str) -> pa.Table:
    """A group as one row, or several where ids repeat: its number, the ids, the
    sizes of the vectors (-1: null, or a null in it), their numbers in turn."""
    vec, ids = t["v"].combine_chunks(), t["id"].combine_chunks()
    size = np.where(np.asarray(vec.is_valid()), np.asarray(pc.fill_null(pc.list_value_length(vec), 0), np.int64), -1)
    flat = vec.flatten()
    there = np.maximum(size, 0)
    row = np.repeat(np.arange(len(size)), there)
    if flat.null_count:
        size[np.unique(row[~np.asarray(flat.is_valid())])] = -1
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(code)[size[row] >= 0]
    held = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    cuts = [*range(0, len(size), 2 * tile), len(size)]
    pieces = list(zip(cuts, cuts[1:]))
    return pa.table({"t": pa.array([t["g"][0].as_py() + blocks * k for k in range(len(pieces))], pa.int64()),
                     "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids),
                     "sizes": pa.array([size[i:j].astype(np.int64).tobytes() for i, j in pieces], pa.binary()),
                     "data": pa.array([values[held[i]:held[j]].tobytes() for i, j in pieces], pa.binary())})


def _tile_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, squares added up in the order of the columns."""
    total = np.zeros((len(x), len(y)))
    right = np.ascontiguousarray(y.T)
    for a in range(0, len(x), 64):
        own = total[a:a + 64]
        d = np.empty_like(own)
        for c in range(x.shape[1]):
            np.subtract(x[a:a + 64, c, None], right[c], out=d)
            np.multiply(d, d, out=d)
            own += d
    return np.sqrt(total, out=total)


def _pair_distances(batches, code: str):
    """Distances of the two groups of each row, or within its only one. A vector
    that is null, holds a null or differs in length from the other has no distance."""
    def side(batch: pa.RecordBatch, r: int, n: str):
        size = np.frombuffer(batch.column("sizes" + n)[r].as_py(), np.int64)
        return batch.column("ids" + n)[r].values, size, np.frombuffer(batch.column("data" + n)[r].as_py(), code).astype(np.float64)

    def filled(size: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
        x = np.zeros((len(size), width))
        x[np.arange(width) < size[:, None]] = values
        return x

    for batch in batches:
        for r in range(len(batch)):
            (ids, size, values), (ids2, size2, values2) = side(batch, r, ""), side(batch, r, "2")
            width = max(int(size.max()), int(size2.max()), 0)
            total = _tile_distances(filled(size, values, width), filled(size2, values2, width))
            lost = (size[:, None] != size2[None, :]) | (size < 0)[:, None]
            a, b = ids.to_numpy(zero_copy_only=False)[:, None], ids2.to_numpy(zero_copy_only=False)[None, :]
            # of two groups every pair stands once, within a group twice
            for flip, picked in ((False, a < b), (True, a > b))[:1 if batch.column("t")[r] == batch.column("t2")[r] else 2]:
                i, j = np.nonzero(picked)
                one, two = ids.take(pa.array(i)), ids2.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([two, one] if flip else [one, two], ["id1", "id2"]).append_column("distance", pa.array(total[i, j], mask=lost[i, j]))


def distance_matrix(vectors: DataFrame, vec: str = "freq", key: str = "id", tile: int = 512) -> DataFrame:
    """All distances (id1 < id2). The full matrix is the result itself, so it is
    laid out in tiles: sequences get groups of about ``tile``, as many as their
    number asks for, and each pair of groups is computed with a few vector
    operations. A sequence travels once, into its group; groups are dealt to
    partitions that meet in pairs, each read where it is needed."""
    blocks = max(-(-vectors.count() // tile), 1)
    g = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("g")).where("id is not null")
    kind = vectors.schema[key].dataType
    code = "f4" if vectors.schema[vec].dataType.elementType == T.FloatType() else "f8"
    packed = g.groupBy("g").applyInArrow(lambda t: _packed(t, tile, blocks, code), T.StructType([
        T.StructField("t", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType())]))
    # groups are small and their pairs are not: they must not be put together by size
    packed = packed.repartitionByRange(min(blocks, math.isqrt(TILE_TASKS)), "t")
    # each pair once; by turns the lower or the higher number comes first, so partitions get equal shares
    once = (F.col("t") == F.col("t2")) | ((F.col("t") < F.col("t2")) == ((F.col("t") + F.col("t2")) % 2 == 0))
    pairs = packed.join(packed.select(*[F.col(c).alias(c + "2") for c in packed.columns]).hint("shuffle_replicate_nl"), once)
    return pairs.mapInArrow(lambda batches: _pair_distances(batches, code), T.StructType([
        T.StructField("id1", kind), T.StructField("id2", kind), T.StructField("distance", T.DoubleType())]))


def half_distances(seqs: DataFrame, min_len: int, key: str = "id") -> DataFrame:
    """Distance between the two halves of each sequence whose half is long
    enough: the sample of the empirical distance distribution."""
    half = F.floor(F.length("seq") / 2).cast("int")
    s = seqs.where(half >= min_len).select(F.explode(F.array(
        F.struct(F.concat(F.col(key).cast("string"), F.lit(":0")).alias("id"), F.substring(F.col("seq"), F.lit(1), half).alias("seq")),
        F.struct(F.concat(F.col(key).cast("string"), F.lit(":1")).alias("id"), F.substring(F.col("seq"), half + 1, F.length("seq")).alias("seq")))).alias("h")).select("h.*")
    v = spectra(s).withColumn("side", F.right("id", F.lit(1))).withColumn(key, F.regexp_replace("id", ":.$", ""))
    g = v.groupBy(key).agg(F.max(F.when(F.col("side") == "0", F.col("freq"))).alias("_a"), F.max(F.when(F.col("side") == "1", F.col("freq"))).alias("_b"))
    return g.select(key, _distance("_a", "_b").alias("distance"))


def upgma(distances: DataFrame, weights: DataFrame) -> DataFrame:
    """Average-linkage tree: rows (node, child1, child2, height, weight). Names
    of joined nodes are 'child1|child2' digests.

    Pairs that are nearest to each other join in the same round: with average
    linkage this gives the tree of the one-by-one order. Distances between the
    new groups are weighted means, one aggregation over the distance table.
    """
    d = materialize(distances.select(F.col("id1").cast("string").alias("a"), F.col("id2").cast("string").alias("b"), F.col("distance").alias("d")), "upgma")
    w = materialize(weights.select(F.col("id").cast("string").alias("id"), F.col("weight").cast("double").alias("w")), "upgma-weights")
    tree = None
    while True:
        if is_empty(d):
            break
        rank = F.struct("d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        near = d.select(F.explode(F.array("a", "b")).alias("id"), rank.alias("r")).groupBy("id").agg(F.min("r").alias("r"))
        pair = near.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(
            F.col("r.d").alias("d"), F.col("r.x").alias("a"), F.col("r.y").alias("b"))
        wa, wb = w.select(F.col("id").alias("a"), F.col("w").alias("wa")), w.select(F.col("id").alias("b"), F.col("w").alias("wb"))
        made = materialize(pair.join(wa, "a").join(wb, "b").select(
            F.sha2(F.concat_ws("|", "a", "b"), 224).alias("node"), F.col("a").alias("child1"), F.col("b").alias("child2"),
            (F.col("d") / 2).alias("height"), (F.col("wa") + F.col("wb")).alias("weight")), "upgma-made")
        tree = made if tree is None else tree.unionByName(made)
        to = made.select(F.explode(F.array("child1", "child2")).alias("id"), "node")
        name = w.join(to, "id", "left").select("id", F.coalesce("node", "id").alias("new"), "w")
        x = d.join(name.select(F.col("id").alias("a"), F.col("new").alias("na"), F.col("w").alias("wa")), "a").join(
            name.select(F.col("id").alias("b"), F.col("new").alias("nb"), F.col("w").alias("wb")), "b").where("na <> nb")
        m = F.col("wa") * F.col("wb")
        d = materialize(x.groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg((F.sum(m * F.col("d")) / F.sum(m)).alias("d")), "upgma")
        w = materialize(name.groupBy(F.col("new").alias("id")).agg(F.sum("w").alias("w")), "upgma-weights")
    return tree


def cut_tree(tree: DataFrame, tail: DataFrame, threshold: float, bin_size: float = 0.0001) -> DataFrame:
    """Clusters (node, leaf): subtrees whose own doubled height still has a tail
    probability of at least ``threshold`` while their parent's has not. Leaves
    follow their parents up one level a round."""
    from .stats import tail_probability
    t = materialize(tail_probability(tree.withColumn("x", F.col("height") * 2), "x", tail, "p", bin_size).select("node", "child1", "child2", "p"), "tree-p")
    up = t.select(F.explode(F.array("child1", "child2")).alias("id"), F.col("node").alias("parent"), F.col("p").alias("parent_p"))
    leaf = up.select("id").join(t.select(F.col("node").alias("id")), "id", "left_anti")
    at = materialize(leaf.select(F.col("id").alias("leaf"), F.col("id").alias("at")), "climb")
    done = None
    while not is_empty(at):
        j = at.join(up.withColumnRenamed("id", "at"), "at", "left")
        stop = F.col("parent").isNull() | (F.col("parent_p") < threshold)
        end = materialize(j.where(stop).select(F.col("at").alias("node"), "leaf"), "climbed")
        done = end if done is None else done.unionByName(end)
        at = materialize(j.where(~stop).select("leaf", F.col("parent").alias("at")), "climb")
    return done


def newick(tree: DataFrame) -> str:
    """Newick text of a tree; written level by level as a column, only the
    finished text (it is one line of output) reaches the driver."""
    text = materialize(tree.select(F.explode(F.array("child1", "child2")).alias("id")).join(
        tree.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("id").alias("t"), F.lit(0.0).alias("h")), "newick")
    left = tree
    while not is_empty(left):
        a = text.select(F.col("id").alias("child1"), F.col("t").alias("t1"), F.col("h").alias("h1"))
        b = text.select(F.col("id").alias("child2"), F.col("t").alias("t2"), F.col("h").alias("h2"))
        ready = left.join(a, "child1").join(b, "child2")
        piece = F.concat(F.lit("("), "t1", F.lit(":"), (F.col("height") - F.col("h1")).cast("string"), F.lit(","), "t2", F.lit(":"),
                         (F.col("height") - F.col("h2")).cast("string"), F.lit(")"))
        new = materialize(ready.select(F.col("node").alias("id"), piece.alias("t"), F.col("height").alias("h")), "newick")
        text = text.unionByName(new)
        left = materialize(left.join(new.select(F.col("id").alias("node")), "node", "left_anti"), "newick-left")
    root = text.join(tree.select(F.explode(F.array("child1", "child2")).alias("id")), "id", "left_anti")
    return ";".join(r["t"] for r in root.orderBy(F.desc("h")).limit(1).collect()) + ";"


def cluster_profiles(members: DataFrame) -> DataFrame:
    """Log-likelihood profile of each cluster: summed counts as log2 of the share
    among words with the same first three bases, plus mean coverage. members:
    (id, cluster, counts, len, cov)."""
    long = members.select("cluster", F.posexplode("counts").alias("word", "x"))
    s = long.groupBy("cluster", "word").agg(F.sum("x").alias("x"))
    p = s.groupBy("cluster", F.floor(F.col("word") / 4).alias("p")).agg(F.sum("x").alias("px"))
    total = members.groupBy("cluster").agg(F.sum("len").alias("len"), (F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("cov"))
    j = s.withColumn("p", F.floor(F.col("word") / 4)).join(p, ["cluster", "p"])
    vec = F.transform(F.array_sort(F.collect_list(F.struct("word", F.log2(F.col("x") / F.col("px")).alias("l")))), lambda x: x["l"])
    return j.groupBy("cluster").agg(vec.alias("profile")).join(total, "cluster")


def assigned(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Members moved to the cluster with the highest mean log-likelihood; ties go
    to the lower cluster. The profile matrix has one row a cluster and is sent to
    the tasks, where whole Arrow batches are scored by one matrix product."""
    rows = profiles.orderBy("cluster").select("cluster", "profile").collect()
    names = np.array([r["cluster"] for r in rows])
    matrix = np.array([r["profile"] for r in rows])

    @F.pandas_udf("cluster bigint, score double")
    def best(counts: pd.Series, nc: pd.Series) -> pd.DataFrame:
        if len(counts) == 0:
            return pd.DataFrame({"cluster": [], "score": []})
        score = np.stack(counts.to_numpy()) @ matrix.T / nc.to_numpy(float)[:, None]
        top = score.argmax(axis=1)
        return pd.DataFrame({"cluster": names[top], "score": score[np.arange(len(top)), top]})

    t = members.withColumn("_b", best("counts", "nc")).withColumn("_old", F.col("cluster"))
    return t.withColumn("cluster", F.col("_b.cluster")).withColumn("score", F.col("_b.score")).drop("_b")


def moved(members: DataFrame) -> int:
    return members.where("cluster <> _old").count()


def cluster_scores(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Summed log-likelihood per cluster of its own members."""
    dot = F.aggregate(F.zip_with("counts", "profile", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return members.select("cluster", "counts").join(profiles.select("cluster", "profile"), "cluster").groupBy("cluster").agg(F.sum(dot).alias("score"))


def coverage_misfits(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Number of members that lie closer to another cluster's mean coverage. The
    nearest mean is found in the sorted list of cluster means."""
    means = [r["cov"] for r in profiles.select("cov").collect()]
    near = F.array_min(F.array(*[F.abs(F.col("cov") - F.lit(m)) for m in means]))
    own = profiles.select("cluster", F.col("cov").alias("mean"))
    return members.join(own, "cluster").agg(F.count_if(near < F.abs(F.col("cov") - F.col("mean"))).alias("misfits"))


def seeded_halves(members: DataFrame, projections: int = 1) -> DataFrame:
    """Split every cluster in two along a far-apart pair of members: (.., half).

    Six alternating farthest-member steps find the pair; members are projected
    on its axis and parted at the mean projection. Further projections discount
    the axis before. All clusters move together: a step is one aggregation by
    cluster, and only the pivots' profiles, one row a cluster, are joined back.
    """
    t = materialize(members.withColumn("fm", F.lit(0.0)), "halves")
    gap2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    pick = lambda df, rank: df.groupBy("cluster").agg(F.max_by(F.struct("freq", "fm"), rank).alias("p"))
    for _ in range(projections):
        first = t.groupBy("cluster").agg(F.min_by(F.struct("freq", "fm"), "id").alias("p"))
        pivot = [materialize(first.select("cluster", F.col("p.freq").alias("pv"), F.col("p.fm").alias("pf")), "pivot"), None]
        for i in range(6):
            have = pivot[i % 2]
            d = t.join(have, "cluster").withColumn("_d", gap2("freq", "pv") - (F.col("pf") - F.col("fm")) * (F.col("pf") - F.col("fm")))
            far = pick(d, F.struct("_d", (-F.col("id")).alias("i")))
            pivot[1 - i % 2] = materialize(far.select("cluster", F.col("p.freq").alias("pv"), F.col("p.fm").alias("pf")), "pivot")
        a = pivot[0].select("cluster", F.col("pv").alias("_a"))
        b = pivot[1].select("cluster", F.col("pv").alias("_b"))
        d2 = gap2("_a", "_b")
        x = (gap2("_a", "freq") - gap2("_b", "freq") + d2) / F.nullif(F.lit(2.0) * F.sqrt(d2), F.lit(0.0))
        t = materialize(t.join(a, "cluster").join(b, "cluster").withColumn("fm", F.coalesce(x, F.lit(0.0))).drop("_a", "_b"), "halves")
    mean = t.groupBy("cluster").agg(F.avg("fm").alias("_m"))
    return t.join(mean, "cluster").withColumn("half", F.when(F.col("fm") < F.col("_m"), 0).otherwise(1)).drop("_m", "fm")


def bisecting_clusters(members: DataFrame, number: int | None = None, max_iter: int = 20) -> DataFrame:
    """Maximum-likelihood clustering by repeated splitting: (id, cluster).

    Each round tries to split all clusters at once from three seedings, refines
    every trial by re-assignment, makes the split with the largest gain in
    log-likelihood and then re-assigns all members among all clusters. Without a
    number it is the total length over an expected genome size, at least two.
    """
    m = materialize(members.select("id", "counts", "freq", "nc", "len", "cov", F.lit(0).cast("bigint").alias("cluster")), "clusters")
    if number is None:
        number = max(m.agg(F.sum("len")).first()[0] // EXPECTED_GENOME, 2)
    for size in range(2, number + 1):
        base = {r["cluster"]: r["score"] for r in cluster_scores(m, cluster_profiles(m)).collect()}
        best = None
        for k in (1, 2, 3):
            # trial clusters of cluster c are 2c and 2c + 1
            t = seeded_halves(m, k).select("id", "counts", "freq", "nc", "len", "cov", F.col("cluster").alias("home"),
                                           (F.col("cluster") * 2 + F.col("half")).alias("cluster"))
            for _ in range(max_iter):
                t = materialize(_reassigned_within(t), "trial")
                if moved(t) == 0:
                    break
                t = t.drop("_old", "score")
            t = t.drop("_old", "score")
            gain: dict[int, float] = {}
            for r in cluster_scores(t, cluster_profiles(t)).collect():
                gain[r["cluster"] // 2] = gain.get(r["cluster"] // 2, 0.0) + r["score"]
            for c, s in sorted(gain.items()):
                if s - base[c] > 0 and (best is None or s - base[c] > best[0]):
                    best = (s - base[c], c, t)
        if best is None:
            break
        _, c, trial = best
        other = trial.where((F.col("home") == c) & (F.col("cluster") == 2 * c + 1)).select("id", F.lit(1).alias("_n"))
        m = materialize(m.join(other, "id", "left").withColumn(
            "cluster", F.when(F.col("_n") == 1, F.lit(size - 1).cast("bigint")).otherwise(F.col("cluster"))).drop("_n"), "clusters")
        for _ in range(max_iter):
            step = materialize(assigned(m, cluster_profiles(m)), "clusters")
            n = moved(step)
            m = step.drop("_old", "score")
            if n == 0:
                break
    return m.select("id", "cluster")


def _reassigned_within(t: DataFrame) -> DataFrame:
    """One step that moves members between the two halves of their own cluster."""
    p = cluster_profiles(t).select(F.floor(F.col("cluster") / 2).alias("home"), F.col("cluster").alias("_c"), "profile")
    both = p.groupBy("home").agg(F.array_sort(F.collect_list(F.struct("_c", "profile"))).alias("ps"))
    dot = lambda v: F.aggregate(F.zip_with("counts", v, lambda x, y: x * y), F.lit(0.0), lambda s, v2: s + v2) / F.col("nc")
    j = t.join(both, "home")
    a, b = F.get("ps", F.lit(0)), F.get("ps", F.lit(1))
    second = b.isNotNull() & (dot(b["profile"]) > dot(a["profile"]))
    return j.withColumn("_old", F.col("cluster")).withColumn("cluster", F.when(second, b["_c"]).otherwise(a["_c"])).withColumn(
        "score", F.lit(0.0)).drop("ps")
