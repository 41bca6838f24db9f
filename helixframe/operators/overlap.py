"""Overlaps between sequence ends and removal of contained sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bases import c, revcomp
from ..session import materialize
from .kmers import kmer_rows, rows_among

# fixed values: masks that give candidate words their different orders
ANCHOR_MASKS = (0x15A3C96E2F4B87D1, 0x2C7E91B5D3A8640F, 0x39D4076AEB512C8E, 0x064FB83C7192DEA5)

_CODES = np.full(256, 5, np.uint64)
_CODES_RC = np.full(256, 5, np.uint64)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b], _CODES_RC[_b] = _i + 1, 4 - _i


def _bounded_levenshtein(a, b, limit) -> Column:
    return F.levenshtein(a, b) <= limit


def approximate_overlap(pairs: DataFrame, low: int, high: int, rate: float = 0.05) -> DataFrame:
    """Longest n in [low, high] whose suffix of ``a`` and prefix of ``b`` differ
    by at most ``rate`` edits a base (0 when there is none)."""
    top = F.least(F.lit(high), F.length("a"), F.length("b")).cast("int")
    lengths = F.when(top >= low, F.sequence(top, F.lit(low), F.lit(-1)))
    ok = F.filter(lengths, lambda n: _bounded_levenshtein(F.right("a", n), F.left("b", n), F.floor(n * rate)))
    return pairs.withColumn("ov", F.coalesce(F.get(ok, F.lit(0)), F.lit(0)))


def canonical_pair(id1, id2) -> Column:
    """Struct (id1, id2) of a signed pair read so that |id1| < |id2|: turning
    round swaps the ends and negates both."""
    a, b = c(id1), c(id2)
    turn = F.abs(a) > F.abs(b)
    return F.struct(F.when(turn, -b).otherwise(a).alias("id1"), F.when(turn, -a).otherwise(b).alias("id2"))


# fixed values: odd bases of the two text digests
DIGEST_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _end_digests(low: int):
    """Digest of every prefix and suffix of at least ``low`` bases, for the text
    and its reverse complement: sums of code times base power, so a suffix is a
    difference of two sums shifted back by an inverse power."""
    inverse = [pow(b, -1, 1 << 64) for b in DIGEST_BASES]

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(text)
                if n < low:
                    continue
                raw = np.frombuffer(text.encode("ascii"), np.uint8)
                sizes = np.arange(low, n + 1)
                for strand in (1, -1):
                    codes = _CODES[raw] if strand > 0 else _CODES_RC[raw[::-1]]
                    pre, suf = [], []
                    for base, back in zip(DIGEST_BASES, inverse):
                        sums = np.zeros(n + 1, np.uint64)
                        sums[1:] = np.cumsum(codes * _powers(base, n), dtype=np.uint64)
                        pre.append(sums[sizes].view(np.int64))
                        suf.append(((sums[n] - sums[n - sizes]) * _powers(back, n + 1)[n - sizes]).view(np.int64))
                    for kind, dig in ((0, pre), (1, suf)):
                        out[0].append(np.full(len(sizes), i * strand, np.int64))
                        out[1].append(np.full(len(sizes), n, np.int32))
                        out[2].append(np.full(len(sizes), kind, np.int8))
                        out[3].append(sizes.astype(np.int32))
                        out[4].append(dig[0])
                        out[5].append(dig[1])
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                for q in range(0, len(cols[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[q:q + (1 << 17)]) for x in cols],
                                                     names=["id", "len", "kind", "n", "h1", "h2"])
    return run


def exact_overlaps(contigs: DataFrame, min_overlap: int, min_len: int = 0, key: str = "contig_id") -> DataFrame:
    """Longest exact overlaps (id1, id2, length), signed 1-based ids with
    |id1| < |id2|; sequence id1 read in its direction runs into id2.

    Suffixes meet prefixes by (length, digest), so only ends that really
    overlap come together: a word that fills the inside of many contigs makes
    no candidates. The text is compared before a pair counts.
    """
    base = contigs.where(F.length("seq") >= max(min_len, min_overlap)).select((F.col(key) + 1).alias("id"), "seq")
    ends = base.mapInArrow(_end_digests(min_overlap), "id bigint, len int, kind byte, n int, h1 bigint, h2 bigint")
    suf = ends.where("kind = 1").select(F.col("id").alias("id1"), "n", "h1", "h2")
    pre = ends.where("kind = 0").select(F.col("id").alias("id2"), "n", "h1", "h2")
    hit = suf.join(pre, ["n", "h1", "h2"]).where(F.abs("id1") < F.abs("id2"))
    text = lambda k: base.select(F.col("id").alias("_" + k), F.col("seq").alias("t_" + k))
    full = (hit.select("id1", "id2", "n").withColumn("_a", F.abs("id1")).withColumn("_b", F.abs("id2"))
            .join(text("a"), "_a").join(text("b"), "_b"))
    # only the two ends are needed: a suffix of the turned text is a turned prefix
    end1 = F.when(F.col("id1") > 0, F.right("t_a", F.col("n"))).otherwise(revcomp(F.left("t_a", F.col("n"))))
    end2 = F.when(F.col("id2") > 0, F.left("t_b", F.col("n"))).otherwise(revcomp(F.right("t_b", F.col("n"))))
    known = full.where((end1 == end2) & ~F.contains(end1, F.lit("N")))
    return known.groupBy("id1", "id2").agg(F.max("n").cast("int").alias("length"))


def lookup_overlap(pairs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Add the overlap length of signed pairs in any order, 0 if none."""
    keyed = pairs.withColumn("_k", canonical_pair("id1", "id2"))
    table = overlaps.select(F.struct("id1", "id2").alias("_k"), F.col("length").alias("overlap"))
    return keyed.join(table, "_k", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))).drop("_k")


def contained(seqs: DataFrame, prefix: int, key: str = "id", cluster: str | None = None) -> DataFrame:
    """Ids of sequences that lie inside a longer one on either strand, or equal
    one with a smaller id. With ``cluster``, only within the same cluster, where
    cluster 0 of the contained side fits any.

    Exact copies go first, by grouping on a digest of the canonical text: a
    group of copies of any size collapses by aggregation and never forms pairs.
    Of the remaining distinct texts, each is looked up by the rarest of a few of
    its words of ``prefix`` bases and the whole text is compared at that place.
    """
    text = F.least(F.col("seq"), revcomp("seq"))
    cl = F.col(cluster) if cluster else F.lit(0)
    base = seqs.select(F.col(key).alias("id"), "seq", cl.alias("cl"), F.length("seq").alias("len"), F.sha2(text, 256).alias("_d"))
    base = materialize(base, "texts")
    if cluster:
        # a copy is redundant when an earlier one has its cluster or it has none
        first_any = base.groupBy("_d").agg(F.min("id").alias("f"))
        first_in = base.groupBy("_d", "cl").agg(F.min("id").alias("g"))
        marked = base.join(first_any, "_d").join(first_in, ["_d", "cl"])
        copies = marked.where(((F.col("cl") == 0) & (F.col("id") > F.col("f"))) | (F.col("id") > F.col("g"))).select("id")
        # any distinct (text, cluster) may hold or be held
        kept = base.join(copies, "id", "left_anti")
    else:
        first = base.groupBy("_d").agg(F.min("id").alias("f"))
        copies = base.join(first, "_d").where("id > f").select("id")
        kept = base.join(copies, "id", "left_anti")
    kept = materialize(kept.select("id", "seq", "cl", "len"), "kept-texts")
    rows = kmer_rows(kept, prefix, keep=["id"])
    # a few candidate words a text, the smallest under different masks; masks
    # only permute letters, so the word comes back by the same mask
    width = (1 << (2 * prefix)) - 1
    masks = [F.lit(m & width).cast("bigint") for m in ANCHOR_MASKS]
    few = rows.groupBy("id").agg(*[F.min(F.col("kmer").bitwiseXOR(m)).alias(f"m{i}") for i, m in enumerate(masks)])
    own = few.select("id", F.explode(F.array_distinct(F.array(*[F.col(f"m{i}").bitwiseXOR(m) for i, m in enumerate(masks)]))).alias("kmer"))
    own = materialize(own, "anchor-words")
    # windows of other words are dropped where they are made
    near = materialize(rows_among(kept, own, prefix, keep=["id", "len", "cl"]), "anchor-places")
    seen = near.groupBy("kmer").agg(F.count(F.lit(1)).alias("seen"))
    # the rarest candidate is the anchor: common words never open groups
    best = own.join(seen, "kmer").groupBy("id").agg(F.min(F.struct("seen", "kmer")).alias("a")).where("a.seen > 1").select(
        "id", F.col("a.kmer").alias("kmer"))
    first = near.join(best, ["id", "kmer"]).groupBy("id", "kmer", "len", "cl").agg(F.min(F.struct("pos", "s")).alias("p"))
    probe = first.select(F.col("id").alias("in_id"), F.col("len").alias("in_len"), F.col("cl").alias("in_cl"), "kmer",
                         F.col("p.pos").alias("in_pos"), F.col("p.s").alias("in_s"))
    hit = near.join(probe, "kmer").where((F.col("id") != F.col("in_id")) & (F.col("len") > F.col("in_len")))
    # start of the inner text in the outer one, read on the strand that agrees;
    # a word that equals its own reverse complement fits both strands
    same = F.col("s") == F.col("in_s")
    fwd = F.struct(F.lit(1).alias("strand"), (F.col("pos") - F.col("in_pos")).alias("pos"))
    rev = F.struct(F.lit(-1).alias("strand"), (F.col("len") - F.col("pos") - prefix - F.col("in_pos")).alias("pos"))
    both_ways = F.lit(prefix % 2 == 0)
    place = F.explode(F.when(both_ways, F.array(fwd, rev)).when(same, F.array(fwd)).otherwise(F.array(rev)))
    hit = hit.select("id", "len", "cl", "in_id", "in_len", "in_cl", place.alias("p")).select(
        "id", "len", "cl", "in_id", "in_len", "in_cl", "p.strand", "p.pos")
    hit = hit.where((F.col("pos") >= 0) & (F.col("pos") + F.col("in_len") <= F.col("len")))
    if cluster:
        hit = hit.where((F.col("in_cl") == 0) | (F.col("in_cl") == F.col("cl")))
    hit = hit.select("id", "strand", "pos", "in_id", "in_len")
    texts = kept.select("id", F.col("seq").alias("outer"))
    inner = kept.select(F.col("id").alias("in_id"), F.col("seq").alias("inner"))
    # only the piece of the outer text meets the inner one
    outer = F.when(F.col("strand") > 0, F.col("outer")).otherwise(revcomp("outer"))
    piece = hit.join(texts, "id").select("in_id", F.substring(outer, F.col("pos") + 1, F.col("in_len")).alias("piece"))
    inside = piece.join(inner, "in_id").where(F.col("piece") == F.col("inner")).select(F.col("in_id").alias("id"))
    return copies.unionByName(inside).distinct().withColumnRenamed("id", key)


def without_contained(seqs: DataFrame, prefix: int, key: str = "id", cluster: str | None = None) -> DataFrame:
    return seqs.join(contained(seqs, prefix, key, cluster), key, "left_anti")
