"""k-mer extraction, counting and membership.

Keys up to 31 bases are one BIGINT (two bits a base, A<C<G<T, so the numeric
order is the letter order); they are made from whole Arrow batches with a few
vector operations, which beats per-row substrings about three times. Longer
keys are strings cut in the JVM. Counting itself is always a Spark hash
aggregation with map-side combining, so a k-mer that makes up a third of the
input costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.bases import MAX_OCCURRENCE, c, revcomp
from ..session import materialize

PACKED_MAX = 31
PIECE = 1 << 16      # longer sequences are cut into overlapping pieces first
SLICE = 1 << 20      # bases handled at once inside a task
DENSE_MAX = 12       # counts of all keys up to this length are one array (4 ** 12 numbers)
WORD_STEPS = 10      # a minimizer is that many bases shorter than its key
PART = 1 << 22       # windows counted in one task
TRAVEL = 1 << 20     # keys that may be sent to all tasks
FILTER_BITS = 28     # a filter of keys is that many binary digits of address: 32 MB


def cut_long(df: DataFrame, k: int, seq: str = "seq", piece: int = PIECE) -> DataFrame:
    """Cut sequences into pieces that overlap by k-1 (column ``_off`` is the
    start), so that no single row is large. Sequences shorter than k go."""
    step = piece - k + 1
    starts = F.sequence(F.lit(0), F.floor((F.length(seq) - k) / step).cast("int"))
    cuts = F.transform(starts, lambda i: F.struct(
        (i * step).alias("o"), F.substring(F.col(seq), i * step + 1, F.lit(piece)).alias("s")))
    whole = F.array(F.struct(F.lit(0).alias("o"), F.col(seq).alias("s")))
    rest = [x for x in df.columns if x != seq]
    return (df.where(F.length(seq) >= k)
            .select(*rest, F.explode(F.when(F.length(seq) <= piece, whole).otherwise(cuts)).alias("_p"))
            .select(*rest, F.col("_p.o").alias("_off"), F.col("_p.s").alias(seq)))


_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i
    _CODE[_b + 32] = _i


def _packed(codes: np.ndarray, k: int) -> np.ndarray:
    """All windows of k bases, two bits a base, the first base highest. Windows of
    twice the length are two windows side by side, so a few steps do for any k."""
    have, width, out, done = (codes & 3).astype(np.int64), 1, None, 0
    n = len(codes) - k + 1
    while True:
        if k & width:
            # the windows so far stand before this one
            out = have if out is None else out[:len(have) - done] << 2 * width | have[done:]
            done += width
        if done == k:
            return out[:n]
        have = have[:-width] << 2 * width | have[width:]
        width *= 2


def _packed_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward keys, reverse-complement keys and validity of all windows."""
    fwd = _packed(codes, k)
    rev = _packed(3 - (codes[::-1] & 3), k)[::-1]
    unknown = np.concatenate(([0], np.cumsum(codes == 4)))
    return fwd, rev, unknown[k:] == unknown[:-k]


def _slices(batch: pa.RecordBatch, seq: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last of about ``SLICE`` bases, their borders and base codes."""
    text = batch.column(batch.schema.get_field_index(seq)).cast(pa.large_binary())
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offs, offs[first] + SLICE, side="right")) - 1
        last = min(max(last, first + 1), len(text))
        yield first, last, offs[first:last + 1] - offs[first], _CODE[data[offs[first]:offs[last]]]
        first = last


def _within_rows(ok: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Windows of ``k`` bases must not run over the end of their own row."""
    for end in bounds[1:-1]:
        ok[max(0, end - k + 1):end] = False
    return ok


def _emit(k: int, mode: str, positions: bool, seq: str, names: Sequence[str], words: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for first, last, bounds, codes in _slices(batch, seq):
                if len(codes) >= k:
                    fwd, rev, ok = _packed_windows(codes, k)
                    ok = _within_rows(ok, bounds, k)
                    at = np.flatnonzero(ok)
                    row = np.searchsorted(bounds, at, side="right") - 1
                    if words:
                        size = batch.column(batch.schema.get_field_index(words)).slice(first, last - first)
                        size = np.asarray(size.to_numpy(zero_copy_only=False), np.int64)[row]
                        off = batch.column(batch.schema.get_field_index("_off")).slice(first, last - first)
                        place = at - bounds[row] + np.asarray(off.to_numpy(zero_copy_only=False), np.int64)[row]
                        take = ((size - k - place) % k == 0) | (place == 0)
                        at, row = at[take], row[take]
                    cols = [batch.column(batch.schema.get_field_index(x)).slice(first, last - first).take(pa.array(row))
                            for x in names]
                    if positions:
                        base = batch.column(batch.schema.get_field_index("_off")).slice(first, last - first)
                        start = np.asarray(base.to_numpy(zero_copy_only=False), np.int64)
                        cols.append(pa.array((at - bounds[row] + start[row]).astype(np.int32)))
                    f, r = fwd[at], rev[at]
                    if mode == "canonical":
                        cols.append(pa.array(np.minimum(f, r)))
                    elif mode == "forward":
                        cols.append(pa.array(f))
                    else:
                        cols += [pa.array(f), pa.array(r)]
                    out = list(names) + (["pos"] if positions else [])
                    out += ["kmer", "rkmer"] if mode == "both" else ["kmer"]
                    whole = pa.RecordBatch.from_arrays(cols, names=out)
                    for q in range(0, whole.num_rows, 1 << 17):
                        yield whole.slice(q, 1 << 17)
    return run


def kmer_rows(df: DataFrame, k: int, keep: Sequence[str] = (), seq: str = "seq",
              mode: str = "canonical", positions: bool = False, words: str | None = None) -> DataFrame:
    """One row per window of k bases without N: ``keep`` columns, optional
    ``pos`` (0-based) and ``kmer`` (BIGINT for k <= 31, else STRING). Mode
    "canonical" gives the smaller strand, "forward" the text as it stands and
    "both" the two strands side by side (``kmer``, ``rkmer``). With ``words``
    (a kept column with the sequence length) only every k-th window is given,
    counted from the 3' end, and the first window of the sequence."""
    src = df.select(*keep, seq)
    if k > PACKED_MAX:
        rows = _string_rows(src, k, keep, seq, mode, positions or bool(words))
        if words:
            rows = rows.where(((F.col(words) - k - F.col("pos")) % k == 0) | (F.col("pos") == 0))
        return rows if positions else rows.drop("pos")
    src = cut_long(src, k, seq)
    fields = [src.schema[x] for x in keep]
    if positions:
        fields.append(T.StructField("pos", T.IntegerType()))
    fields.append(T.StructField("kmer", T.LongType()))
    if mode == "both":
        fields.append(T.StructField("rkmer", T.LongType()))
    return src.mapInArrow(_emit(k, mode, positions, seq, list(keep), words), T.StructType(fields))


def _string_rows(src: DataFrame, k: int, keep, seq: str, mode: str, positions: bool) -> DataFrame:
    # small pieces: substring on UTF-8 text costs time in proportion to the offset
    src = cut_long(src, k, seq, piece=256 + k - 1).withColumn("_rc", revcomp(seq))
    at = src.select("*", F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias("_i"))
    fwd = F.substring(F.col(seq), F.col("_i"), F.lit(k))
    rev = F.substring(F.col("_rc"), F.length(seq) - k + 2 - F.col("_i"), F.lit(k))
    cols = list(keep)
    if positions:
        cols.append((F.col("_off") + F.col("_i") - 1).cast("int").alias("pos"))
    if mode == "both":
        cols += [fwd.alias("kmer"), rev.alias("rkmer")]
    else:
        cols.append((fwd if mode == "forward" else F.least(fwd, rev)).alias("kmer"))
    return at.select(*cols).where(~F.contains("kmer", F.lit("N")))


def saturate(n) -> Column:
    return F.least(c(n), F.lit(MAX_OCCURRENCE)).cast("int")


def count_kmers(rows: DataFrame, min_occ: int = 1) -> DataFrame:
    """Occurrence table (kmer, occ), counts capped at 65534."""
    t = rows.groupBy("kmer").agg(saturate(F.count(F.lit(1))).alias("occ"))
    return t.where(F.col("occ") >= min_occ) if min_occ > 1 else t


def _dense_counts(k: int, seq: str):
    """Counts of all canonical keys of a task: one array of 4 ** k numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(4 ** k, np.int64)
        for batch in batches:
            for _, _, bounds, codes in _slices(batch, seq):
                if len(codes) >= k:
                    fwd, rev, ok = _packed_windows(codes, k)
                    np.add.at(n, np.minimum(fwd, rev)[_within_rows(ok, bounds, k)], 1)
        seen = np.flatnonzero(n)
        for q in range(0, len(seen), 1 << 17):
            part = seen[q:q + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], names=["kmer", "n"])
    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _stretches(k: int, parts: int, seq: str):
    """Runs of windows that share their minimizer (the word of ``k - WORD_STEPS``
    bases, on either strand, with the smallest hash): part, number of windows and
    the run's bases in two numbers, 31 in ``lo`` and those before in ``hi``. Equal
    runs of a slice are one row with a count, so a word that makes up a third of
    the input costs a few rows a slice."""
    m = max(k - WORD_STEPS, 1)
    most = min(31, 63 - k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, bounds, codes in _slices(batch, seq):
                if len(codes) < k:
                    continue
                unknown = np.concatenate(([0], np.cumsum(codes == 4)))
                at = np.flatnonzero(_within_rows(unknown[k:] == unknown[:-k], bounds, k))
                if not len(at):
                    continue
                small = _mixed(np.minimum(_packed(codes, m), _packed(3 - (codes[::-1] & 3), m)[::-1]))
                reach, width = k - m + 1, 1
                while width < reach:          # smallest hash of ``width`` words in a row
                    step = min(width, reach - width)
                    small = np.minimum(small[:-step], small[step:])
                    width += step
                small = small[at]
                fresh = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (small[1:] != small[:-1])))
                place = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                heads = np.flatnonzero(place % most == 0)
                n = np.diff(np.append(heads, len(at)))
                start, size = at[heads], n + k - 1
                wide = _packed(np.concatenate((codes, np.zeros(31, np.uint8))), 31)
                lo = np.where(size >= 31, wide[np.maximum(start + size - 31, 0)], wide[start] >> 2 * np.maximum(31 - size, 0))
                hi = np.where(size > 31, wide[start] >> 2 * np.clip(62 - size, 0, 31), 0)
                part = (_mixed(small[heads]) >> np.uint64(20)) % np.uint64(parts)
                order = np.lexsort((lo, hi, n))
                n, hi, lo, part = n[order], hi[order], lo[order], part[order]
                one = np.flatnonzero(np.concatenate(([True], (n[1:] != n[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
                copies = np.diff(np.append(one, len(n)))
                yield pa.RecordBatch.from_arrays([pa.array(part[one].astype(np.int32)), pa.array(n[one].astype(np.int32)), pa.array(
                    copies.astype(np.int32)), pa.array(hi[one]), pa.array(lo[one])], names=["part", "n", "copies", "hi", "lo"])
    return run


def _turned(df: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Add the reverse complement of a packed key: all bits flipped, pairs of
    bits in turned order by swaps of growing width."""
    df = df.withColumn(name, F.bitwise_not(key))
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.col(name)
        df = df.withColumn(name, F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift)))
    return df.withColumn(name, F.shiftrightunsigned(name, 64 - 2 * k))


def count_sequences(df: DataFrame, k: int, min_occ: int = 1, seq: str = "seq") -> DataFrame:
    """Occurrence table of all windows of whole sequences, as ``count_kmers`` of
    their ``kmer_rows``, without a shuffled row for each window.

    Up to ``DENSE_MAX`` bases every task counts into one array. Longer keys travel
    as runs of windows with one minimizer, which name the part where all equal
    keys meet (a run of six windows is two numbers); they are opened there. A task
    gets many small parts, about ``PART`` windows, so counts fit in memory.
    """
    if k > PACKED_MAX:
        return count_kmers(kmer_rows(df, k, seq=seq), min_occ)
    src = cut_long(df.select(seq), k, seq).select(seq)
    if k <= DENSE_MAX:
        t = src.mapInArrow(_dense_counts(k, seq), "kmer bigint, n bigint").groupBy("kmer").agg(saturate(F.sum("n")).alias("occ"))
    else:
        bases = df.agg(F.sum(F.length(seq).cast("bigint"))).first()[0] or 0
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-bases // PART))
        runs = src.mapInArrow(_stretches(k, 64 * parts, seq), "part int, n int, copies int, hi bigint, lo bigint").repartition(parts, "part")
        at = runs.select("part", "copies", "hi", "lo", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        key = F.expr("shiftleft(hi, 62 - 2 * i) | shiftrightunsigned(lo, 2 * i)").bitwiseAND(F.lit((1 << 2 * k) - 1))
        rows = _turned(at.select("part", "copies", key.alias("f")), "f", k, "r")
        # equal keys have equal parts: no second exchange
        t = rows.groupBy("part", F.least("f", "r").alias("kmer")).agg(saturate(F.sum("copies")).alias("occ")).select("kmer", "occ")
    return t.where(F.col("occ") >= min_occ) if min_occ > 1 else t


def count_among(df: DataFrame, wanted: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Occurrence table of the ``wanted`` k-mers only. Up to ``TRAVEL`` of them go
    to all tasks, and other windows are dropped where they are made."""
    keys = materialize(wanted.select("kmer").distinct(), "wanted-kmers")
    if keys.count() <= TRAVEL:
        return count_kmers(kmer_rows(df, k, seq=seq).join(F.broadcast(keys), "kmer", "left_semi"))
    return count_sequences(df, k, seq=seq).join(keys, "kmer", "left_semi")


def _marks(x: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(x) >> np.uint64(64 - bits)).astype(np.int64)


def rows_among(df: DataFrame, wanted: DataFrame, k: int, keep: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Windows whose canonical key is among ``wanted`` (packed keys): ``keep``,
    ``pos``, ``kmer`` and ``s``, the strand that gave the key.

    Tasks know the keys by a bit array of fixed size, whatever their number, put
    together by Spark; other windows are dropped where they are made and the few
    that share a bit with a key go in an exact join."""
    size = FILTER_BITS

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _marks(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    keys = wanted.select("kmer").distinct()
    words = keys.mapInArrow(marked, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).select(F.col("word").cast("int"), "bits").toArrow()
    table = np.zeros(1 << size - 6, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table)
    src = cut_long(df.select(*keep, seq), k, seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for rows in _emit(k, "both", True, seq, list(keep), None)(batches):
            f, r = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("kmer", "rkmer"))
            key = np.minimum(f, r)
            at = _marks(key, size)
            hit = np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)
            if len(hit):
                some = rows.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*some.columns[:-2], pa.array(key[hit]), pa.array(np.where(f[hit] <= r[hit], 1, -1).astype(np.int32))],
                                                 names=[*keep, "pos", "kmer", "s"])

    fields = [*[src.schema[x] for x in keep], T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.LongType()), T.StructField("s", T.IntegerType())]
    return src.mapInArrow(run, T.StructType(fields)).join(keys, "kmer", "left_semi")


def dense_table(df: DataFrame, k: int, seq: str = "seq") -> np.ndarray:
    """Occurrences of all k-mers of up to ``DENSE_MAX`` bases as one array by
    canonical key: at most 32 MB, whatever the input."""
    if k > DENSE_MAX:
        raise ValueError(f"an array for {k} bases is too large")
    t = count_sequences(df, k, seq=seq).select(F.col("kmer").cast("int"), "occ").toArrow()
    out = np.zeros(4 ** k, np.uint16)
    out[t["kmer"].to_numpy()] = t["occ"].to_numpy()
    return out


def looked_up(codes: np.ndarray, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of every window in a ``dense_table``, and whether all its bases are known."""
    value, known = [np.zeros(0, table.dtype)], [np.zeros(0, bool)]
    for a in range(0, len(codes) - k + 1, SLICE):
        fwd, rev, ok = _packed_windows(codes[a:a + SLICE + k - 1], k)
        value.append(table[np.minimum(fwd, rev)])
        known.append(ok)
    return np.concatenate(value), np.concatenate(known)


def occurrence_histogram(table: DataFrame) -> DataFrame:
    return table.groupBy("occ").agg(F.count(F.lit(1)).alias("n"))


def max_coverage_kmers(contigs: DataFrame, k: int, min_occ: int = 1, cov: str = "cov") -> DataFrame:
    """Largest contig coverage per canonical k-mer, at least ``min_occ``."""
    rows = kmer_rows(contigs, k, keep=[cov])
    return rows.groupBy("kmer").agg(saturate(F.greatest(F.max(cov), F.lit(min_occ))).alias("occ"))


def add_new_counts(previous: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """Counts of an earlier graph stay as they are; only unseen k-mers of the
    sequences are counted.

    Counting goes first: the anti join then sees one row per distinct k-mer, so
    a k-mer repeated billions of times cannot overload a join task.
    """
    fresh = count_sequences(seqs, k).join(previous.select("kmer"), "kmer", "left_anti")
    return previous.select("kmer", "occ").unionByName(fresh)


def flag_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``known`` (boolean) to k-mer rows. The key set of the other side is
    unique; hot keys on the row side are split by salting (``skew``)."""
    from .skew import join_unique
    marks = known.select("kmer").distinct().withColumn("known", F.lit(True))
    return join_unique(rows, marks, ["kmer"], how="left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def matched_region(rows: DataFrame, known: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """First and last base of a read that a known k-mer covers."""
    from .skew import join_unique
    hits = join_unique(rows, known.select("kmer").distinct(), ["kmer"])
    return hits.groupBy(key).agg(F.min("pos").alias("start"), (F.max("pos") + k).cast("int").alias("end"))


def trim_to_region(reads: DataFrame, region: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads cut to their matched region; reads without one are dropped."""
    return (reads.join(region, key)
            .withColumn("seq", F.substring(F.col("seq"), F.col("start") + 1, F.col("end") - F.col("start")))
            .drop("start", "end"))


def reads_with(rows: DataFrame, keys: DataFrame, key: str = "read_id") -> DataFrame:
    """Ids of reads that contain at least one of the k-mers."""
    from .skew import join_unique
    # the keys are unique, so a row meets one of them at most: only hits are made distinct
    return join_unique(rows.select(key, "kmer"), keys.select("kmer").distinct(), ["kmer"]).select(key).distinct()


def new_kmers(seqs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers of the sequences that the known set lacks."""
    return count_sequences(seqs, k).select("kmer").join(known.select("kmer"), "kmer", "left_anti")


def sorted_keys(table: DataFrame, min_occ: int) -> DataFrame:
    return table.where(F.col("occ") >= min_occ).select("kmer").orderBy("kmer")


def position_coverage(contigs: DataFrame, table: DataFrame, k: int, key: str = "contig_id") -> DataFrame:
    """Occurrence of every contig window (contig, pos, occ); unseen is 1."""
    from .skew import join_unique
    rows = kmer_rows(contigs, k, keep=[key], positions=True)
    hit = join_unique(rows, table.select("kmer", "occ"), ["kmer"], how="left")
    return hit.select(key, "pos", F.greatest(F.coalesce("occ", F.lit(0)), F.lit(1)).alias("occ"))


def contig_coverage(contigs: DataFrame, table: DataFrame, k: int, key: str = "contig_id") -> DataFrame:
    """Mean occurrence over the windows of a contig, to the nearest integer."""
    per = position_coverage(contigs, table, k, key).groupBy(key).agg(
        F.sum(F.col("occ").cast("bigint")).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select(key, F.least(F.floor(F.col("s") / F.col("n") + 0.5), F.lit(MAX_OCCURRENCE)).cast("bigint").alias("cov"))


def half_coverage_ratio(cover: DataFrame, lengths: DataFrame, k: int, key: str = "contig_id") -> DataFrame:
    """Ratio (>= 1) of the mean coverages of the left and right half of a contig."""
    half = F.floor(F.col("len") / 2)
    side = F.when(F.col("pos") + k <= half, "l").when(F.col("pos") >= half, "r")
    s = cover.join(lengths, key).select(key, side.alias("side"), "occ").where("side is not null")
    per = s.groupBy(key).agg(F.avg(F.when(F.col("side") == "l", F.col("occ"))).alias("a"),
                             F.avg(F.when(F.col("side") == "r", F.col("occ"))).alias("b"))
    return per.where("a is not null and b is not null").select(
        key, (F.greatest("a", "b") / F.least("a", "b")).alias("ratio"))
