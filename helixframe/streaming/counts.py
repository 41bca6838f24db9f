"""Occurrence counts over reads that arrive in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.kmers import kmer_rows, saturate


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """Running (kmer, occ) over a stream of sequences (column seq), for update
    or complete output. The state holds one row per distinct k-mer, spread over
    the state partitions by hash."""
    return kmer_rows(reads, k).groupBy("kmer").agg(saturate(F.count(F.lit(1))).alias("occ"))
