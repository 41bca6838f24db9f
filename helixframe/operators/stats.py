"""Distributions and summary statistics.

Everything is reduced to a (value, n) histogram by a map-side combined
aggregation before any ordering happens; lengths and counts are bounded
(reads by 500 000, occurrences by 65 534), so the ordered part is small
whatever the number of rows. One-row results enter plans as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bases import c
from ..functions.numeric import half_up

PEAK_WINDOW = 101           # fixed value: width of the moving sum
SHORT_INSERT = (0.25, 1.75)  # fixed values: window around the peak
LONG_INSERT = (0.25, 10.0)
DISTRIBUTION_BIN = 0.0001   # fixed value: bin of empirical distributions


def histogram(df: DataFrame, value, name: str = "len") -> DataFrame:
    return df.groupBy(c(value).cast("bigint").alias(name)).agg(F.count(F.lit(1)).alias("n"))


def weighted_mean(hist: DataFrame, value: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row (mean) of a histogram, optionally within [low, high]."""
    h = hist
    if low is not None:
        h = h.where(F.col(value) >= low)
    if high is not None:
        h = h.where(F.col(value) <= high)
    return h.agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"))


def left_local_minimum(hist: DataFrame, value: str, width: int = 1) -> DataFrame:
    """First value where the sum of ``width`` following bins stops falling.
    Empty bins count as 0; every bin reaches the windows that contain it."""
    reach = hist.select(F.explode(F.sequence(F.greatest(F.col(value) - width, F.lit(1)), F.col(value) + 1)).alias("at"))
    sums = (hist.select(F.explode(F.sequence(F.greatest(F.col(value) - width + 1, F.lit(1)), F.col(value))).alias("at"), "n")
            .groupBy("at").agg(F.sum("n").alias("s")))
    first = hist.sparkSession.range(1, 2).select(F.col("id").alias("at"))
    grid = (reach.unionByName(first).distinct().join(sums, "at", "left")
            .select("at", F.coalesce("s", F.lit(0)).alias("s")))
    nxt = grid.select((F.col("at") - 1).alias("at"), F.col("s").alias("next"))
    return (grid.join(nxt, "at", "left").where(F.coalesce("next", F.lit(0)) >= F.col("s"))
            .agg(F.min("at").alias("minimum")))


def length_weighted_coverage(contigs: DataFrame, min_len: int = 0, length: str = "len", cov: str = "cov") -> DataFrame:
    return contigs.where(F.col(length) >= min_len).agg(
        (F.sum(F.col(cov) * F.col(length)) / F.sum(length)).alias("mean"))


def coverage_without_outliers(contigs: DataFrame, min_len: int = 0, factor: float = 100.0) -> DataFrame:
    """Mean coverage again, over contigs within a factor of the first mean."""
    first = length_weighted_coverage(contigs, min_len).scalar()
    kept = contigs.where((F.col("len") >= min_len) & (F.col("cov") >= first / factor) & (F.col("cov") <= first * factor))
    return kept.agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("mean"))


def truncated_coverage(nodes: DataFrame, weight: Column | None = None, factor: float = 2.0) -> DataFrame:
    """Rounded weighted mean, then rounded again over values within ``factor``."""
    w = F.col("len") if weight is None else weight
    first = nodes.agg(half_up(F.sum(F.col("cov") * w) / F.sum(w)).alias("m")).scalar()
    kept = nodes.where((F.col("cov") <= first * factor) & (F.col("cov") * factor >= first))
    return kept.agg(half_up(F.sum(F.col("cov") * w) / F.sum(w)).alias("mean"))


def hetero_coverage(nodes: DataFrame, min_bubbles: int = 10000) -> DataFrame:
    """As ``truncated_coverage``; with few bubbles the other nodes count with
    half their coverage, otherwise only bubbles count (column ``bubble``)."""
    many = nodes.agg((F.count_if("bubble") >= min_bubbles).alias("many")).scalar()
    per = F.when(F.col("bubble"), F.col("cov").cast("double")).otherwise(F.col("cov") / 2.0)
    use = nodes.where(F.col("bubble") | ~many).withColumn("cov", per)
    return truncated_coverage(use)


def moving_sum_peak(hist: DataFrame, value: str = "len", width: int = PEAK_WINDOW, min_peak: int = 0) -> DataFrame:
    """Centre of the first window of ``width`` bins with the largest sum. Each
    bin adds itself to the centres that see it, so no ordered pass is needed."""
    half = width // 2
    top = hist.agg(F.max(value).alias("top")).scalar()
    centres = hist.select("n", F.explode(F.sequence(F.col(value) - half, F.col(value) + half)).alias("centre"))
    low = max(min_peak, half)
    sums = (centres.where((F.col("centre") >= low) & (F.col("centre") <= top - half))
            .groupBy("centre").agg(F.sum("n").alias("s")))
    return sums.agg(F.max_by("centre", F.struct("s", -F.col("centre"))).alias("peak"))


def insert_size(hist: DataFrame, value: str = "len", bounds=SHORT_INSERT, min_peak: int = 0) -> DataFrame:
    """One row: peak, lower, upper, mean and sd of the insert size. The mean is
    raised by one half twice before it is cut, the spread is around that mean."""
    peak = moving_sum_peak(hist, value, min_peak=min_peak)
    top = hist.agg(F.max(value).alias("top")).scalar()
    lim = peak.select("peak", F.least(half_up(F.col("peak") * bounds[1]), top).alias("upper"))
    lim = lim.select("peak", F.least(half_up(F.col("peak") * bounds[0]), F.col("upper")).alias("lower"), "upper")
    low, up = lim.select("lower").scalar(), lim.select("upper").scalar()
    inside = hist.where((F.col(value) >= low) & (F.col(value) <= up))
    v, n = F.col(value), F.col("n")
    mean = inside.agg(F.floor(F.sum(v * n) / F.sum(n) + 1.0).cast("bigint").alias("mean"))
    m = mean.scalar()
    spread = inside.agg(F.floor(F.coalesce(F.sqrt(
        F.sum((v - m) * (v - m) * n).cast("double") / F.nullif(F.sum(n) - 1, F.lit(0))), F.lit(0.0)) + 0.5).cast("bigint").alias("sd"))
    return lim.select("peak", "lower", "upper", m.alias("mean"), spread.scalar().alias("sd"))


def n_statistics(lengths: DataFrame, length: str = "len") -> DataFrame:
    """One row: number, total, smallest, largest, mean and N10..N90."""
    h = histogram(lengths, length, "len")
    total = h.agg(F.sum(F.col("len") * F.col("n")).alias("t")).scalar()
    run = h.withColumn("cum", F.sum(F.col("len") * F.col("n")).over(
        Window.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", total)
    cols = [F.sum("n").alias("n"), F.max("total").alias("total"), F.min("len").alias("shortest"),
            F.max("len").alias("longest"), (F.max("total") / F.sum("n")).alias("mean")]
    for q in range(10, 100, 10):
        cols.append(F.max(F.when(F.col("cum") * 100 >= F.col("total") * q, F.col("len"))).alias(f"n{q}"))
    return run.agg(*cols)


def truncate_tails(hist: DataFrame, share: float, value: str = "len") -> DataFrame:
    """Drop the bins in both tails that together stay below ``share`` of the mass."""
    w = Window.orderBy(value)
    total = hist.agg(F.sum("n").alias("t")).scalar()
    run = (hist.withColumn("_lo", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_hi", F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("_t", total))
    return run.where((F.col("_lo") > F.col("_t") * share) & (F.col("_hi") > F.col("_t") * share)).select(value, "n")


def placement_normalised(hist: DataFrame, lengths: DataFrame, value: str = "len") -> DataFrame:
    """Histogram divided by the number of places where such a length fits,
    sum over sequences of max(L + 1 - i, 0), then rescaled to the old total.

    For bin i that sum is (total - cumulative) arithmetic over the length
    histogram: longer-or-equal sequences give sum(L) + (1 - i) * count. Both
    tables are bounded, so one ordered pass over their union replaces the
    product of sequences and bins.
    """
    seqs = histogram(lengths, "len", "at").select("at", F.col("n").alias("m"), (F.col("at") * F.col("n")).alias("l"),
                                                  F.lit(None).cast("bigint").alias("n"), F.lit(0).alias("kind"))
    bins = hist.where(F.col(value) >= 1).select(F.col(value).alias("at"), F.lit(0).cast("bigint").alias("m"),
                                                F.lit(0).cast("bigint").alias("l"), "n", F.lit(1).alias("kind"))
    w = Window.orderBy(F.col("at").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = (seqs.unionByName(bins).withColumn("m_ge", F.sum("m").over(w)).withColumn("l_ge", F.sum("l").over(w))
           .where("kind = 1").select(F.col("at").alias(value), "n",
                                     (F.col("l_ge") + (1 - F.col("at")) * F.col("m_ge")).alias("places")))
    rated = run.where("places > 0").withColumn("rate", F.col("n") / F.col("places"))
    scale = rated.agg((F.sum("n") / F.sum("rate")).alias("s")).scalar()
    return rated.select(value, "n", "places", (F.col("rate") * scale).alias("normalised"))


def suffix_totals(lengths: DataFrame, length: str = "len") -> DataFrame:
    """For every length L: number and total length of the reads with length >= L."""
    h = histogram(lengths, length, "len")
    w = Window.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return h.select("len", F.sum("n").over(w).alias("num"), F.sum(F.col("len") * F.col("n")).over(w).alias("total"))


def empirical_distribution(values: DataFrame, value: str, bin_size: float = DISTRIBUTION_BIN) -> DataFrame:
    """Bins of a sample with cumulative share and tail probability. The share of
    the lowest bin (bin 0) is its plain count, as in the reference results."""
    h = values.groupBy(F.floor(F.col(value) / bin_size).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n").alias("t")).scalar()
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("bin") == 0, F.col("n").cast("double")).otherwise(F.col("n") / F.col("t"))
    return (h.withColumn("t", total).withColumn("cdf", F.sum(share).over(w))
            .select("bin", "n", "cdf", (F.lit(1.0) - F.col("cdf")).alias("tail")))


def tail_probability(values: DataFrame, value: str, dist: DataFrame, out: str,
                     bin_size: float = DISTRIBUTION_BIN) -> DataFrame:
    """Add the tail probability of ``value``: that of the last filled bin at or
    below it, 1 before the first bin and 0 beyond the last one.

    Only the distinct bins that are asked for are put in order with the filled
    ones; the rows themselves then join on their bin.
    """
    b = F.floor(F.col(value) / bin_size).cast("bigint")
    asked = values.select(b.alias("bin")).where("bin is not null").distinct().select(
        "bin", F.lit(None).cast("double").alias("tail"), F.lit(1).alias("kind"))
    filled = dist.select("bin", "tail", F.lit(0).alias("kind"))
    w = Window.orderBy("bin", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("tail", ignorenulls=True).over(w)
    top = dist.agg(F.max("bin").alias("top")).scalar()
    found = (asked.unionByName(filled).withColumn("_p", last).where("kind = 1").select(
        F.col("bin").alias("_bin"), "_p").withColumn("_top", top))
    p = F.when(F.col("_bin") > F.col("_top"), F.lit(0.0)).otherwise(F.coalesce("_p", F.lit(1.0)))
    return (values.withColumn("_bin", b).join(found.select("_bin", p.alias(out)), "_bin", "left").drop("_bin"))


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Upper median per key from a value histogram (hot keys collapse first)."""
    h = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*keys)
    run = h.withColumn("_cum", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(full))
    return (run.where(F.col("_cum") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias(name)))


def best_gap(samples: DataFrame, keys: Sequence[str], mean: float, sd: float, low: int, high: int) -> DataFrame:
    """Gap with the largest summed log density of insert = observed + gap.

    For a normal density the summed log likelihood is a parabola in the gap, so
    its sufficient statistics (count, sum) are enough and the candidates are
    never expanded: the best whole number is the nearest one to mean - avg, the
    smaller one on a tie, clipped to [low, high].
    """
    s = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("observed").alias("s"))
    exact = F.lit(float(mean)) - F.col("s") / F.col("n")
    best = F.ceil(exact - 0.5)
    return s.select(*keys, "n", F.greatest(F.lit(low), F.least(F.lit(high), best)).cast("bigint").alias("gap"))
