"""Mapping reads to contigs through seed words.

Places of a seed are only used when they are unique, so the index keeps one
row per canonical word that occurs exactly once: repeats collapse in the
aggregation and the join can never multiply rows. Ids are signed and 1-based;
the sign is the strand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bases import revcomp
from .kmers import kmer_rows
from .skew import join_unique


def seed_places(contigs: DataFrame, k: int, key: str = "contig_id") -> DataFrame:
    """All places (kmer canonical, id, pos, strand) of the contig words."""
    rows = kmer_rows(contigs.select((F.col(key) + 1).alias("cid"), "seq"), k, keep=["cid"], mode="both", positions=True)
    return rows.select(F.least("kmer", "rkmer").alias("kmer"), "cid", F.col("pos").alias("cpos"),
                       F.when(F.col("kmer") < F.col("rkmer"), 1).when(F.col("kmer") > F.col("rkmer"), -1).otherwise(0).alias("cstrand"))


def unique_index(contigs: DataFrame, k: int, key: str = "contig_id") -> DataFrame:
    """Words with exactly one place on either strand."""
    p = seed_places(contigs, k, key)
    one = p.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cid", "cpos", "cstrand")).alias("p"))
    return one.where((F.col("n") == 1) & (F.col("p.cstrand") != 0)).select("kmer", "p.*")


def read_words(reads: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """Non-overlapping words from the 3' end of each read, canonical form."""
    src = reads.select(*keep, F.length("seq").cast("int").alias("len"), "seq")
    rows = kmer_rows(src, k, keep=[*keep, "len"], mode="both", positions=True, words="len")
    return rows.where("kmer <> rkmer").select(*keep, "len", "pos", F.least("kmer", "rkmer").alias("kmer"),
                                              F.when(F.col("kmer") < F.col("rkmer"), 1).otherwise(-1).alias("strand"))


def _placed(words: DataFrame, index: DataFrame, k: int, keep) -> DataFrame:
    """Read start implied by each uniquely placed word: (id, offset)."""
    hit = join_unique(words, index, ["kmer"])
    same = F.col("strand") == F.col("cstrand")
    return hit.select(*keep, "len", "pos", F.when(same, F.col("cid")).otherwise(-F.col("cid")).alias("id"),
                      F.when(same, F.col("cpos") - F.col("pos")).otherwise(F.col("cpos") + F.col("pos") + k - 1).alias("offset"))


def top_unless_tied(votes: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Best row per key, and none when the two best scores are equal. Two
    map-side combined aggregations instead of a ranked group."""
    best = votes.groupBy(*keys).agg(F.max(score).alias("_best"))
    top = votes.join(best, list(keys)).where(F.col(score) == F.col("_best"))
    rest = [x for x in votes.columns if x not in keys]
    one = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_r"))
    return one.where("_n = 1").select(*keys, "_r.*")


def map_by_votes(reads: DataFrame, contigs: DataFrame, k: int, keep: Sequence[str] = ("read_id",), key: str = "contig_id") -> DataFrame:
    """Read place with most words, unmapped on a tie: (keep, id, offset, votes)."""
    placed = _placed(read_words(reads, k, keep), unique_index(contigs, k, key), k, keep)
    votes = placed.groupBy(*keep, "id", "offset").agg(F.count(F.lit(1)).alias("votes"))
    return top_unless_tied(votes, keep, "votes")


def map_by_first_word(reads: DataFrame, contigs: DataFrame, k: int, keep: Sequence[str] = ("read_id",), key: str = "contig_id") -> DataFrame:
    """Place of the first word (5' to 3') that has a unique place."""
    placed = _placed(read_words(reads, k, keep), unique_index(contigs, k, key), k, keep)
    first = placed.groupBy(*keep).agg(F.min(F.struct("pos", "id", "offset")).alias("p"))
    return first.select(*keep, F.col("p.id").alias("id"), F.col("p.offset").alias("offset"))


def map_with_fallback(reads: DataFrame, contigs: DataFrame, seeds: Sequence[int], keep: Sequence[str] = ("read_id",), key: str = "contig_id") -> DataFrame:
    """Try seed lengths in order; later ones only see reads still unmapped.
    The seed length is the score of the place."""
    out, left = None, reads
    for k in seeds:
        got = map_by_first_word(left, contigs, k, keep, key).withColumn("score", F.lit(k))
        out = got if out is None else out.unionByName(got)
        left = reads.join(out.select(*keep), list(keep), "left_anti")
    return out


def map_ungapped(reads: DataFrame, contigs: DataFrame, k: int, identity: float, keep: Sequence[str] = ("read_id",),
                 key: str = "contig_id", penalty: int = 50) -> DataFrame:
    """Places proposed by unique words, extended over the whole read without
    gaps: +1 a match, -penalty a mismatch; the only best place is kept when its
    identity is high enough."""
    placed = _placed(read_words(reads, k, keep), unique_index(contigs, k, key), k, keep).select(*keep, "len", "id", "offset").distinct()
    text = reads.select(*keep, F.col("seq").alias("_r"))
    target = contigs.select((F.col(key) + 1).alias("_c"), F.col("seq").alias("_t"))
    full = placed.withColumn("_c", F.abs("id")).join(text, list(keep)).join(target, "_c")
    start = F.when(F.col("id") > 0, F.col("offset")).otherwise(F.col("offset") - F.col("len") + 1)
    full = full.withColumn("_s", start).where((F.col("_s") >= 0) & (F.col("_s") + F.col("len") <= F.length("_t")))
    from ..functions.bases import mismatches
    region = F.substring(F.col("_t"), F.col("_s") + 1, F.col("len"))
    region = F.when(F.col("id") > 0, region).otherwise(revcomp(region))
    scored = full.withColumn("mismatch", mismatches(F.col("_r"), region)).withColumn(
        "score", F.col("len") - F.col("mismatch") - F.col("mismatch") * penalty)
    ok = scored.where(F.col("mismatch") <= F.floor(F.lit(1 - identity) * F.col("len") + 1e-9))
    return top_unless_tied(ok.select(*keep, "id", "offset", "mismatch", "score"), keep, "score")


def pair_up(mapped: DataFrame, pair: str = "pair_id", mate: str = "mate") -> DataFrame:
    """One row per pair with both mates mapped, by aggregation on the pair."""
    p = F.struct("id", "offset", "len")
    g = mapped.groupBy(pair).agg(F.max(F.when(F.col(mate) == 0, p)).alias("f"), F.max(F.when(F.col(mate) == 1, p)).alias("r"))
    return g.where("f is not null and r is not null").select(
        pair, F.col("f.id").alias("f_id"), F.col("f.offset").alias("f_off"), F.col("r.id").alias("r_id"),
        F.col("r.offset").alias("r_off"), F.least("f.len", "r.len").alias("min_len"))


def insert_lengths(pairs: DataFrame) -> DataFrame:
    """Inner pairs on one contig with facing mates: insert length and left place."""
    same = pairs.where("f_id = -r_id")
    fwd = (F.col("f_id") > 0) & (F.col("f_off") < F.col("r_off"))
    rev = (F.col("r_id") > 0) & (F.col("r_off") < F.col("f_off"))
    t = same.where(fwd | rev).select("*", (F.abs(F.col("f_off") - F.col("r_off")) + 1).alias("insert"))
    return t.where(F.col("insert") >= F.col("min_len")).select(
        "pair_id", F.abs("f_id").alias("contig"), F.least("f_off", "r_off").alias("left"), "insert")


def pair_links(pairs: DataFrame) -> DataFrame:
    """Pairs on two contigs, ordered and turned so that 0 < id1 and id1 < |id2|."""
    t = pairs.where(F.abs("f_id") != F.abs("r_id"))
    low = F.abs("f_id") < F.abs("r_id")
    a = F.when(low, F.col("f_id")).otherwise(F.col("r_id"))
    b = F.when(low, F.col("r_id")).otherwise(F.col("f_id"))
    ao = F.when(low, F.col("f_off")).otherwise(F.col("r_off"))
    bo = F.when(low, F.col("r_off")).otherwise(F.col("f_off"))
    return t.select("pair_id", a.alias("id1"), ao.alias("off1"), (-b).alias("id2"), bo.alias("off2"))


def mapped_coverage(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Average coverage of the library: read bases over contig bases."""
    total = contigs.agg(F.sum(F.length("seq").cast("bigint")).alias("t")).scalar()
    return reads.agg((F.sum(F.length("seq").cast("bigint")) / total).alias("coverage"))


def place_bubbles(bubbles: DataFrame, contigs: DataFrame, k: int, key: str = "bubble_id") -> DataFrame:
    """Bubbles whose two end words lie in order on one contig, same strand:
    (bubble, id, start, end) on that contig."""
    ends = bubbles.where(F.length("seq") >= k).select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.left("seq", F.lit(k)).alias("seq")),
        F.struct(F.lit(1).alias("side"), F.right("seq", F.lit(k)).alias("seq")))).alias("e")).select(key, "e.side", "e.seq")
    m = map_by_votes(ends, contigs, k, keep=[key, "side"])
    # end position of a word on the plus strand is its start + k - 1
    g = m.groupBy(key).agg(F.max(F.when(F.col("side") == 0, F.struct("id", "offset"))).alias("a"),
                           F.max(F.when(F.col("side") == 1, F.struct("id", "offset"))).alias("b"))
    t = g.where("a.id = b.id")
    start = F.when(F.col("a.id") > 0, F.col("a.offset")).otherwise(F.col("b.offset") - k + 1)
    end = F.when(F.col("a.id") > 0, F.col("b.offset") + k - 1).otherwise(F.col("a.offset"))
    return t.select(key, F.col("a.id").alias("id"), start.alias("start"), end.alias("end")).where(F.col("start") <= F.col("end"))


def map_with_bubbles(reads: DataFrame, contigs: DataFrame, bubbles: DataFrame, k: int, keep: Sequence[str] = ("read_id",)) -> DataFrame:
    """Votes over contigs and bubbles together; a place on a bubble is lifted to
    the contig that carries it, so both arms vote for one coordinate."""
    n = F.lit(1 << 40)
    place = place_bubbles(bubbles, contigs, k).select(F.col("bubble_id").alias("_b"), F.col("id").alias("_id"), "start", "end")
    both = contigs.select("contig_id", "seq").unionByName(bubbles.select((F.col("bubble_id") + n).alias("contig_id"), "seq"))
    placed = _placed(read_words(reads, k, keep), unique_index(both, k), k, keep)
    on = placed.withColumn("_b", F.when(F.abs("id") > n, F.abs("id") - n - 1)).join(place, "_b", "left")
    on = on.where("_b is null or _id is not null")
    s = F.signum("id").cast("int")
    lifted_id = F.when(F.col("_b").isNull(), F.col("id")).otherwise(F.col("_id") * s)
    lifted = F.when(F.col("_b").isNull(), F.col("offset")).when(F.col("_id") > 0, F.col("start") + F.col("offset")).otherwise(
        F.col("end") - F.col("offset"))
    votes = on.select(*keep, lifted_id.alias("id"), lifted.alias("offset")).groupBy(*keep, "id", "offset").agg(
        F.count(F.lit(1)).alias("votes"))
    return top_unless_tied(votes, keep, "votes")


def gap_spanning_reads(reads: DataFrame, flanks: DataFrame, k: int, max_mismatch: float = 0.1) -> DataFrame:
    """Reads that hold the left and the right flank word of one gap in order;
    the text between is a candidate for the gap (negative length = overlap).

    ``flanks`` is (gap_id, left, right): the words are the last k bases of the
    left flank and the first k of the right one; words that belong to more than
    one gap are not used. Where the flanks go on beyond their words, the read
    must agree with them as far as both reach (up to ``max_mismatch``): a word
    that comes back inside the gap is not its edge. Of several places the one
    with the fewest mismatches counts, then the one next to the gap.
    """
    from ..functions.bases import mismatches, pack
    flanks = flanks.where((F.length("left") >= k) & (F.length("right") >= k)).select("gap_id", "left", "right")
    ends = flanks.select("gap_id", F.right("left", F.lit(k)).alias("left"), F.left("right", F.lit(k)).alias("right"))
    both = ends.select("gap_id", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.lit(1).alias("strand"), pack("left").alias("kmer")),
        F.struct(F.lit("r").alias("side"), F.lit(1).alias("strand"), pack("right").alias("kmer")),
        F.struct(F.lit("l").alias("side"), F.lit(-1).alias("strand"), pack(revcomp("left")).alias("kmer")),
        F.struct(F.lit("r").alias("side"), F.lit(-1).alias("strand"), pack(revcomp("right")).alias("kmer")))).alias("q")).select("gap_id", "q.*")
    one = both.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("gap_id", "side", "strand")).alias("q")).where(
        "n = 1").select("kmer", "q.*")
    hit = join_unique(kmer_rows(reads, k, keep=["read_id"], mode="forward", positions=True), one, ["kmer"])
    g = hit.groupBy("read_id", "gap_id", "strand").agg(
        F.collect_list(F.when(F.col("side") == "l", F.col("pos"))).alias("l"), F.collect_list(F.when(F.col("side") == "r", F.col("pos"))).alias("r"))
    t = g.where("size(l) > 0 and size(r) > 0").join(reads.select("read_id", "seq"), "read_id").join(flanks, "gap_id")
    # everything on the strand of the gap
    fwd = F.col("strand") > 0
    turned = lambda x: F.transform(x, lambda p: F.when(fwd, p).otherwise(F.length("seq") - p - k))
    t = t.withColumn("l", turned("l")).withColumn("r", turned("r")).withColumn("seq", F.when(fwd, F.col("seq")).otherwise(revcomp("seq")))

    def place(p, side):
        if side == "l":
            n = F.least(F.length("left") - k, p)
            miss = mismatches(F.substring(F.col("seq"), p - n + 1, n), F.substring(F.col("left"), F.length("left") - k - n + 1, n))
        else:
            n = F.least(F.length("right") - k, F.length("seq") - p - k)
            miss = mismatches(F.substring(F.col("seq"), p + k + 1, n), F.substring(F.col("right"), F.lit(k + 1), n))
        return F.struct((miss <= n * max_mismatch).alias("ok"), (-miss).alias("m"), (p if side == "l" else -p).alias("near"), p.alias("p"))

    best = lambda side: F.array_max(F.filter(F.transform(side, lambda p: place(p, side)), lambda x: x["ok"]))["p"]
    t = t.select("gap_id", "read_id", "seq", best("l").alias("l"), best("r").alias("r")).where("l is not null and r is not null")
    t = t.withColumn("length", F.col("r") - F.col("l") - k).where(F.col("length") > -k)
    return t.select("gap_id", "read_id", "length", F.substring(F.col("seq"), F.col("l") + k + 1, F.greatest("length", F.lit(0))).alias("seq"))


def read_on_unitig(reads: DataFrame, unitigs: DataFrame, k: int) -> DataFrame:
    """Reads all of whose k-mers lie on one unitig in step: (read, unitig, start)."""
    rows = kmer_rows(reads.select("read_id", F.length("seq").alias("len"), "seq"), k, keep=["read_id", "len"], mode="both", positions=True)
    q = rows.select("read_id", "len", "pos", F.least("kmer", "rkmer").alias("kmer"), F.when(F.col("kmer") <= F.col("rkmer"), 1).otherwise(-1).alias("strand"))
    hit = join_unique(q, unique_index(unitigs, k), ["kmer"])
    same = F.col("strand") == F.col("cstrand")
    at = hit.select("read_id", "len", F.when(same, F.col("cid")).otherwise(-F.col("cid")).alias("id"),
                    F.when(same, F.col("cpos") - F.col("pos")).otherwise(F.col("cpos") + F.col("pos") + k - 1).alias("offset"))
    g = at.groupBy("read_id", "len").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "offset")).alias("a"), F.max(F.struct("id", "offset")).alias("b"))
    return g.where((F.col("a") == F.col("b")) & (F.col("n") == F.col("len") - k + 1)).select("read_id", "a.*")


def dead_end_bridges(reads: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """Reads that touch open ends of at least two unitigs. ``ends`` is
    (unitig, kmer) of ends whose outward side has no neighbour."""
    # few windows touch an end: the others are dropped before anything is grouped
    hit = kmer_rows(reads, k, keep=["read_id"]).join(ends.select("kmer", "unitig").distinct(), "kmer")
    per = hit.groupBy("read_id").agg(F.min("unitig").alias("a"), F.max("unitig").alias("b"))
    return per.where("a <> b").select("read_id")
