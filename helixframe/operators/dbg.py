"""De Bruijn graphs as tables of segments.

A segment is a stretch of k-mers (seq, n_kmer, cov) standing for both strands;
a single k-mer is the smallest one. Neighbours meet on their (k-1)-base ends,
where at most four segments come in and four go out, so every group is small
by construction. Chains are joined by pointer doubling: a chain of n segments
takes log2(n) joins. Edits are decided on a snapshot of a round and applied by
anti join, then chains are joined again on the (much smaller) segment table.

``scope`` separates independent graphs (one per gap, say) in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.bases import MAX_OCCURRENCE, canonical, pack, revcomp, unpack
from ..session import is_empty, materialize
from .kmers import PACKED_MAX, kmer_rows

BUBBLE_RATE = 0.02      # fixed values: allowed difference of bubble arms
TIP_RATIO = 0.5         # and coverage ratio below which tips go
BLOCK = 4096


def end_kmers(contigs: DataFrame, k: int, seq: str = "seq", keep=()) -> DataFrame:
    """Canonical k-mers (packed) at both ends of sequences."""
    ends = contigs.where(F.length(seq) >= k).select(
        *keep, F.explode(F.array(F.left(seq, F.lit(k)), F.right(seq, F.lit(k)))).alias("e"))
    return ends.where(~F.contains("e", F.lit("N"))).select(*keep, pack(canonical("e")).alias("kmer")).distinct()


def as_segments(table: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Occurrence table to one-k-mer segments."""
    text = unpack("kmer", k) if k <= PACKED_MAX else F.col("kmer")
    return table.select((F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), text.alias("seq"),
                        F.lit(1).cast("bigint").alias("n_kmer"), F.col("occ").cast("double").alias("cov"))


def segment_key(seq, k: int):
    """A k-mer lies in one segment only, so the first k-mer names a direction."""
    return F.concat(F.col("scope"), F.lit(":"), F.left(seq, F.lit(k)))


def oriented(segs: DataFrame, k: int, stranded: bool = False) -> DataFrame:
    """Both directions of each segment: key, rkey (the other direction), the
    end words pre and suf, n_kmer, cov. Sequence text stays behind."""
    s = F.col("seq")
    tag = lambda x: F.concat(F.col("scope"), F.lit(":"), x)
    fk, rk = segment_key(s, k), tag(revcomp(F.right(s, F.lit(k))))
    fwd = F.struct(fk.alias("key"), rk.alias("rkey"), tag(F.left(s, F.lit(k - 1))).alias("pre"), tag(F.right(s, F.lit(k - 1))).alias("suf"))
    rev = F.struct(rk.alias("key"), fk.alias("rkey"), tag(revcomp(F.right(s, F.lit(k - 1)))).alias("pre"), tag(revcomp(F.left(s, F.lit(k - 1)))).alias("suf"))
    rows = F.array(fwd) if stranded else F.when(fk == rk, F.array(fwd)).otherwise(F.array(fwd, rev))
    return segs.select(F.explode(rows).alias("o"), "n_kmer", "cov").select("o.*", "n_kmer", "cov")


def _chains(links: DataFrame, all_keys: DataFrame) -> DataFrame:
    """(key, head, dist) by pointer doubling over ``links`` (key, prev). Each
    round writes only the rows that are still moving. Keys in rings are opened
    before their smallest member."""
    start = materialize(all_keys.select("key").join(links, "key", "left").select(
        "key", F.coalesce("prev", "key").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("prev").isNull().alias("done"), F.least(F.col("key"), F.coalesce("prev", "key")).alias("low")), "chain")
    finished, active = start.where("done"), start.where("not done")
    while not is_empty(active):
        target = finished.unionByName(active).select(
            F.col("key").alias("head"), F.col("head").alias("h2"), F.col("dist").alias("d2"), F.col("done").alias("end2"), F.col("low").alias("l2"))
        moved = materialize(active.join(target, "head").select(
            "key", F.col("h2").alias("head"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("end2").alias("done"),
            F.least("low", "l2").alias("low")), "chain")
        if is_empty(moved.where("done")):
            # no end was reached: rings, once their low mark has gone all round
            before = active.select("key", F.col("low").alias("l0"))
            if is_empty(moved.join(before, "key").where("low < l0")):
                ring = materialize(moved.select("key", "low"), "rings")
                cut = links.join(ring, "key").where("key <> low").select("key", "prev")
                opened = _chains(materialize(cut, "ring-links"), ring.select("key"))
                return finished.select("key", "head", "dist").unionByName(opened)
        finished, active = finished.unionByName(moved.where("done")), moved.where("not done")
    return finished.select("key", "head", "dist")


def compact(segs: DataFrame, k: int, stranded: bool = False) -> DataFrame:
    """Join all chains without branches: unitigs and junctions in one table
    (scope, seq, n_kmer, cov, n_in, n_out, junction)."""
    segs = materialize(segs.select("scope", "seq", "n_kmer", "cov"), "segments")
    orient = materialize(oriented(segs, k, stranded), "oriented")
    near = materialize(orient.select("key", "rkey").join(neighbours(orient), "key", "left").na.fill(0, ["n_in", "n_out"]), "near")
    plain = near.where("n_in <= 1 and n_out <= 1")
    # a joint needs a straight segment on both sides, and no turning on the spot
    a = plain.where("next is not null").select(F.col("key").alias("prev"), F.col("next").alias("key"), F.col("rkey").alias("_r"))
    links = a.where("key <> prev and key <> _r").join(plain.select("key"), "key", "left_semi").select("key", "prev")
    chain = materialize(_chains(materialize(links, "links"), near.select("key")), "chains")
    # each chain (or ring) appears in both directions; keep the one that holds
    # the lower key
    if stranded:
        keep = chain.select("head").distinct()
    else:
        low = chain.join(near.select("key", "rkey"), "key").groupBy("head").agg(F.min("key").alias("a"), F.min("rkey").alias("b"))
        keep = low.where("a <= b").select("head")
    text = segs.select(segment_key("seq", k).alias("key"), "scope", "seq", "n_kmer", "cov")
    if not stranded:
        text = text.unionByName(segs.select(F.concat("scope", F.lit(":"), revcomp(F.right("seq", F.lit(k)))).alias("key"), "scope",
                                            revcomp("seq").alias("seq"), "n_kmer", "cov")).dropDuplicates(["key"])
    member = chain.join(keep, "head").join(text, "key").join(near.select("key", "n_in", "n_out"), "key")
    piece = F.when(F.col("dist") == 0, F.col("seq")).otherwise(F.expr(f"substring(seq, {k})"))
    part = member.groupBy("head", "scope", F.floor(F.col("dist") / BLOCK).alias("b")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dist", piece.alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.sum("n_kmer").alias("n_kmer"), F.sum(F.col("cov") * F.col("n_kmer")).alias("mass"),
        F.max(F.struct("dist", "n_out")).alias("last"), F.min(F.struct("dist", "n_in")).alias("first"))
    whole = part.groupBy("head", "scope").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "text"))), lambda x: x["text"]), "").alias("seq"),
        F.sum("n_kmer").alias("n_kmer"), (F.sum("mass") / F.sum("n_kmer")).alias("cov"),
        F.max("last").alias("last"), F.min("first").alias("first"))
    out = whole.select("scope", "seq", "n_kmer", "cov", F.col("first.n_in").alias("n_in"), F.col("last.n_out").alias("n_out"))
    return materialize(out.withColumn("junction", (F.col("n_in") > 1) | (F.col("n_out") > 1)), "compact")


def neighbours(orient: DataFrame) -> DataFrame:
    """As ``neighbours`` for all keys, also those with a free end."""
    meet = (orient.select("key", F.explode(F.array(F.struct(F.col("suf").alias("q"), F.lit(0).alias("out")),
                                                   F.struct(F.col("pre").alias("q"), F.lit(1).alias("out")))).alias("m"))
            .select("key", "m.q", "m.out"))
    g = meet.groupBy("q").agg(F.collect_list(F.when(F.col("out") == 0, F.col("key"))).alias("ins"),
                              F.collect_list(F.when(F.col("out") == 1, F.col("key"))).alias("outs"))
    one = lambda a: F.when(F.size(a) == 1, F.get(F.col(a), F.lit(0)))
    none = F.lit(None).cast("string")
    rows = F.concat(
        F.transform("ins", lambda x: F.struct(x.alias("key"), F.size("outs").alias("n_out"), one("outs").alias("next"),
                                              F.lit(0).alias("n_in"), none.alias("prev"))),
        F.transform("outs", lambda x: F.struct(x.alias("key"), F.lit(0).alias("n_out"), none.alias("next"),
                                               F.size("ins").alias("n_in"), one("ins").alias("prev"))))
    t = g.select(F.explode(rows).alias("r")).select("r.*")
    return t.groupBy("key").agg(F.max("n_out").alias("n_out"), F.max("next").alias("next"), F.max("n_in").alias("n_in"), F.max("prev").alias("prev"))


def _around(segs: DataFrame, k: int, stranded: bool = False) -> DataFrame:
    """Directions with degrees, single neighbours and the junction marks of those."""
    o = materialize(oriented(segs, k, stranded), "oriented")
    n = materialize(o.join(neighbours(o), "key", "left").na.fill(0, ["n_in", "n_out"]), "around")
    j = n.select("key", ((F.col("n_in") > 1) | (F.col("n_out") > 1)).alias("j"))
    return (n.join(j.select("key", F.col("j").alias("junction")), "key")
            .join(j.select(F.col("key").alias("prev"), F.col("j").alias("prev_j")), "prev", "left")
            .join(j.select(F.col("key").alias("next"), F.col("j").alias("next_j")), "next", "left"))


def tips(segs: DataFrame, k: int, ratio: float = TIP_RATIO, stranded: bool = False) -> DataFrame:
    """Names (canonical key) of dead-end segments of at most k k-mers on a
    junction, whose coverage is at most ``ratio`` of the best other branch."""
    a = materialize(_around(segs, k, stranded), "tips")
    # branches that leave the same word: at most four
    two = a.groupBy("pre").agg(F.slice(F.sort_array(F.collect_list(F.struct("cov", "key")), False), 1, 2).alias("top"))
    x = a.where((F.col("n_kmer") <= k) & (F.col("n_out") == 0) & (F.col("n_in") == 1) & F.col("prev_j") & ~F.col("junction")).join(two, "pre")
    best = F.when(F.get("top", F.lit(0))["key"] == F.col("key"), F.get("top", F.lit(1))["cov"]).otherwise(F.get("top", F.lit(0))["cov"])
    hit = x.where(F.col("cov") <= F.coalesce(best, F.lit(0.0)) * ratio)
    return hit.select(F.least("key", "rkey").alias("name")).distinct()


def _drop(segs: DataFrame, names: DataFrame, k: int) -> DataFrame:
    named = segs.withColumn("name", F.least(segment_key("seq", k), F.concat("scope", F.lit(":"), revcomp(F.right("seq", F.lit(k))))))
    return named.join(names, "name", "left_anti").drop("name")


def cut_tips(segs: DataFrame, k: int, ratio: float = TIP_RATIO, stranded: bool = False) -> DataFrame:
    """Remove tips until there are none, joining chains after each round."""
    while True:
        t = materialize(tips(segs, k, ratio, stranded), "tip-names")
        if is_empty(t):
            return segs
        segs = compact(_drop(segs, t, k), k, stranded)


def bubble_arms(segs: DataFrame, k: int, rate: float = BUBBLE_RATE) -> DataFrame:
    """Arms between the same two junctions that are alike: (name, keeper, n_kmer,
    cov, keeper_n). The keeper has the highest coverage of its group."""
    a = _around(segs, k).where("not junction and n_in = 1 and n_out = 1 and prev_j and next_j")
    s = F.col("seq")
    text = segs.select(segment_key(s, k).alias("key"), "seq").unionByName(
        segs.select(F.concat("scope", F.lit(":"), revcomp(F.right("seq", F.lit(k)))).alias("key"), revcomp("seq").alias("seq"))).dropDuplicates(["key"])
    # at most four arms leave a junction, so a group has at most six pairs
    multi = a.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("prev", "next")
    arms = materialize(a.join(multi, ["prev", "next"]).join(text, "key").select(
        "prev", "next", "key", F.least("key", "rkey").alias("name"), "n_kmer", "cov", "seq"), "arms")
    x = arms.select("prev", "next", *[F.col(c).alias(c + "1") for c in ("name", "n_kmer", "seq")])
    y = arms.select("prev", "next", *[F.col(c).alias(c + "2") for c in ("name", "n_kmer", "seq")])
    p = x.join(y, ["prev", "next"]).where("name1 < name2")
    longest = F.greatest("n_kmer1", "n_kmer2")
    allowed = F.floor((longest + k - 1) * rate + 0.5).cast("int")
    inner = lambda i: F.substring(F.col(f"seq{i}"), F.lit(k), (F.col(f"n_kmer{i}") - k + 1).cast("int"))
    alike = F.when(F.least("n_kmer1", "n_kmer2") + 1 <= k, F.abs(F.col("n_kmer1") - F.col("n_kmer2")) <= allowed).otherwise(
        F.levenshtein(inner(1), inner(2)) <= allowed)
    same = materialize(p.where(alike).select("prev", "next", "name1", "name2"), "alike")
    both = same.unionByName(same.select("prev", "next", F.col("name2").alias("name1"), F.col("name1").alias("name2")))
    label = arms.select("prev", "next", "name", F.col("name").alias("label"))
    for _ in range(2):      # three steps reach all of four arms; two doublings do
        reach = both.join(label.select("prev", "next", F.col("name").alias("name2"), "label"), ["prev", "next", "name2"]).groupBy(
            "prev", "next", F.col("name1").alias("name")).agg(F.min("label").alias("l2"))
        label = label.join(reach, ["prev", "next", "name"], "left").select(
            "prev", "next", "name", F.least("label", F.coalesce("l2", "label")).alias("label"))
    grouped = arms.join(label, ["prev", "next", "name"])
    best = grouped.groupBy("prev", "next", "label").agg(
        F.max_by(F.struct("name", "n_kmer"), F.struct("cov", F.col("n_kmer"), "name")).alias("b"))
    m = grouped.join(best, ["prev", "next", "label"]).where(F.col("name") != F.col("b.name"))
    return m.select("name", F.col("b.name").alias("keeper"), "n_kmer", "cov", F.col("b.n_kmer").alias("keeper_n")).distinct()


def crush_bubbles(segs: DataFrame, k: int, rate: float = BUBBLE_RATE) -> DataFrame:
    """Merge alike arms into the best covered one until none are left; the
    keeper takes over the coverage, weighted by length."""
    while True:
        arms = materialize(bubble_arms(segs, k, rate), "bubbles")
        if is_empty(arms):
            return segs
        gain = arms.groupBy(F.col("keeper").alias("name")).agg(F.sum(F.col("cov") * F.col("n_kmer")).alias("gain"))
        named = segs.withColumn("name", F.least(segment_key("seq", k), F.concat("scope", F.lit(":"), revcomp(F.right("seq", F.lit(k))))))
        left = named.join(arms.select("name"), "name", "left_anti").join(gain, "name", "left")
        cov = F.when(F.col("gain").isNull(), F.col("cov")).otherwise(
            F.least(F.floor(F.col("cov") + F.col("gain") / F.col("n_kmer") + 0.5), F.lit(MAX_OCCURRENCE)).cast("double"))
        segs = compact(left.select("scope", "seq", "n_kmer", cov.alias("cov")), k)


def weak_segments(segs: DataFrame, max_cov: float, max_kmers: int) -> DataFrame:
    """Low-coverage short unitigs, unless both ends are connected."""
    return segs.where((F.col("cov") < max_cov) & (F.col("n_kmer") < max_kmers) & ~F.col("junction") & ~(
        (F.col("n_in") > 0) & (F.col("n_out") > 0)))


def drop_weak(segs: DataFrame, k: int, max_cov: float, max_kmers: int) -> DataFrame:
    while True:
        bad = F.coalesce((F.col("cov") < max_cov) & (F.col("n_kmer") < max_kmers) & ~F.col("junction") & ~(
            (F.col("n_in") > 0) & (F.col("n_out") > 0)), F.lit(False))
        if is_empty(segs.where(bad)):
            return segs
        segs = compact(segs.where(~bad), k)
    return segs


def unitigs(segs: DataFrame) -> DataFrame:
    return segs.where("not junction")


def junctions(segs: DataFrame) -> DataFrame:
    return segs.where("junction")


def unitig_statistics(segs: DataFrame) -> DataFrame:
    """Coverage histogram by length in k-mers of the unitigs."""
    return unitigs(segs).groupBy(F.round("cov").cast("bigint").alias("cov")).agg(F.sum("n_kmer").alias("n"))


def mean_coverage_without_bubbles(segs: DataFrame, arms: DataFrame, k: int) -> DataFrame:
    """Length-weighted coverage over everything but bubble arms."""
    names = arms.select("name").unionByName(arms.select(F.col("keeper").alias("name"))).distinct()
    return _drop(segs, names, k).agg((F.sum(F.col("cov") * F.col("n_kmer")) / F.sum("n_kmer")).alias("mean"))


def export_kmers(segs: DataFrame, next_k: int) -> DataFrame:
    """Segments as seed counts of the next, longer k: largest coverage per k-mer."""
    from .kmers import max_coverage_kmers
    rows = segs.select("seq", F.least(F.floor(F.col("cov") + 0.5), F.lit(MAX_OCCURRENCE)).cast("int").alias("cov"))
    return max_coverage_kmers(rows, next_k)


def open_end_kmers(segs: DataFrame, k: int) -> DataFrame:
    """(unitig, kmer) of the ends of unitigs without a neighbour outside."""
    u = unitigs(segs).withColumn("unitig", segment_key("seq", k))
    left = u.where("n_in = 0").select("unitig", F.left("seq", F.lit(k)).alias("e"))
    right = u.where("n_out = 0").select("unitig", F.right("seq", F.lit(k)).alias("e"))
    key = pack(canonical("e")) if k <= PACKED_MAX else canonical("e")
    return left.unionByName(right).select("unitig", key.alias("kmer")).distinct()


def split_by_support(segs: DataFrame, reads: DataFrame, k: int, min_len: int) -> DataFrame:
    """Unitigs cut where no read covers the joint of two windows: pieces of
    consecutive windows that reads hold in one piece."""
    from .coverage import islands
    from .kmers import count_kmers
    u = unitigs(segs).select(F.xxhash64("scope", "seq").alias("unitig"), "seq")
    seen = count_kmers(kmer_rows(reads, k + 1)) if k + 1 <= PACKED_MAX else count_kmers(kmer_rows(reads, k + 1))
    joint = kmer_rows(u, k + 1, keep=["unitig"], positions=True).join(seen.select("kmer"), "kmer", "left_semi")
    runs = islands(joint, ["unitig"], "pos", 1)
    return runs.join(u, "unitig").select("unitig", F.substring(F.col("seq"), (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s") + k).cast("int")).alias("seq")).where(
        F.length("seq") >= min_len)
