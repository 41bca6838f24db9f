"""Numeric expressions: rounding, medians, densities and expected link counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .bases import c


def half_up(x) -> Column:
    """Nearest whole number of a value that is not negative."""
    return F.floor(c(x) + F.lit(0.5)).cast("bigint")


def upper_median(values) -> Column:
    """Element at n/2 of the sorted array."""
    a = F.sort_array(c(values))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def gap_median(values) -> Column:
    """Middle gap; with an even count the halved sum of the two middle gaps,
    plus one half, cut towards zero at each step."""
    a = F.sort_array(c(values))
    n = F.size(a)
    mid = F.floor(n / 2).cast("int")
    hi = F.get(a, mid)
    lo = F.get(a, F.greatest(mid - 1, F.lit(0)))
    total = (lo + hi).cast("bigint")
    halved = F.when(total >= 0, F.floor(total / 2)).otherwise(F.ceil(total / 2))
    half = F.when(n % 2 == 1, hi.cast("bigint")).otherwise(halved)
    return F.when(half >= 0, half).otherwise(F.ceil(half + F.lit(0.5))).cast("bigint")


def normal_density(x, mean, sd) -> Column:
    z = (c(x) - mean) / sd
    return F.exp(F.lit(-0.5) * z * z) / (F.lit(math.sqrt(2 * math.pi)) * sd)


@F.pandas_udf(T.DoubleType())
def _erf(x: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(math.erf, x), np.float64, len(x)))


def error_function(x) -> Column:
    """erf in double precision, for whole Arrow batches: a series of the same
    precision needs up to 160 terms a value."""
    z = c(x).cast("double")
    return F.when(F.isnan(z), z).otherwise(_erf(z))


def expected_links(coverage, len1, len2, gap, insert_mean, insert_sd, read_len) -> Column:
    """Expected number of read pairs that join two stretches ``gap`` apart, for
    a normal insert size: a combination of F(u) = u erf(u/s) + s/sqrt(pi)
    exp(-(u/s)^2) with s = sqrt(2) sd over the four end combinations."""
    s = F.lit(math.sqrt(2.0)) * insert_sd
    r = read_len

    def f(u):
        return u * error_function(u / s) + s / F.lit(math.sqrt(math.pi)) * F.exp(-(u / s) * (u / s))

    base = c(gap) - insert_mean
    total = f(base + c(len1) + c(len2)) - f(base + c(len2) + r) - f(base + c(len1) + r) + f(base + r + r)
    return total * c(coverage) / (F.lit(4.0) * r)


def placements(len1, len2, gap, insert, read_len) -> Column:
    """Number of fragment starts that put one mate on each of two nodes.

    Each limit is a count of starts: the part of the fragment between the mates'
    middles has to bridge the gap, a mate has to touch the shorter node by half
    of its bases, and the fragment has to end on the two nodes."""
    reach = F.lit(insert)
    mate = F.lit(read_len // 2)
    bridging = reach - mate - mate - F.greatest(c(gap), F.lit(0))
    touching = F.least(c(len1), c(len2)) + mate
    ending = c(len1) + c(gap) + c(len2) - reach
    return F.greatest(F.least(bridging, touching, ending) + 1, F.lit(0)).cast("bigint")


def join_log_probability(coverage, read_len, cutoff: int, large_k: int, small_k: int) -> Column:
    """Expected log loss when a join needs ``cutoff`` reads: the Poisson tail
    below the cutoff at the k-mer coverage of ``large_k``, once per added base."""
    m = c(coverage).cast("double") * (c(read_len) - large_k + 1) / c(read_len)
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, cutoff):
        term = term * m / i
        total = total + term
    return -F.lit(large_k - small_k + 1.0) * F.exp(-m) * total


def decreased_cutoff(coverage, read_len, cutoff: int, min_log_p: float, large_k: int, small_k: int) -> Column:
    """Largest cutoff from ``cutoff`` down to 1 whose loss is above ``min_log_p``."""
    out = F.lit(1)
    for i in range(2, cutoff + 1):
        out = F.when(join_log_probability(coverage, read_len, i, large_k, small_k) > min_log_p, i).otherwise(out)
    return out
