"""Packing documents into padded batches with optimal length buckets.

The histogram of lengths of all documents (``CLASSES`` exact lengths and ``TAIL``
classes for each doubling beyond) is the only thing that leaves the cluster. Dynamic programming over it chooses
the bucket borders with the least padding. A batch of a bucket holds as many
documents as its token budget allows at the bucket's border length. Batches are
numbered over shards of a bucket, so a bucket with most documents is spread over
many tasks and has at most one batch that is not full.

Defined cases: null and empty texts have length 0 and are packed, too; a
document longer than the budget is a batch of its own and is not cut; repeated
rows are packed as often as they stand; an empty table gives an empty result.
Lengths up to ``CLASSES`` are exact; longer ones share a class with lengths at
most 1 / ``TAIL`` apart, whose border is the longest that occurs. The class of a
length does not depend on other documents, and no document is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .mix import n_words

CLASSES = 4096
TAIL = 256            # a power of two
BUCKETS = 16
BUDGET = 16384
SHARD_ROWS = 5_000
SEED = 29


def borders(border: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Bucket borders with the least padding: ``border`` holds the ascending
    largest lengths of the classes, ``count`` their documents, ``total`` the
    sum of their lengths."""
    m = len(border)
    if not m:
        return []
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    best = border * c[1:] - s[1:]                # one bucket over the first j classes
    choice = [np.zeros(m, dtype=np.int64)]
    costs = [best]
    for _ in range(1, min(buckets, m)):
        now, back = best.copy(), np.zeros(m, dtype=np.int64)
        for a in range(0, m, 256):
            j = np.arange(a, min(a + 256, m))
            i = np.arange(1, j[-1] + 1)          # the last bucket starts at class i
            if not len(i):
                continue
            cost = best[i - 1][None, :] + border[j][:, None] * (c[j + 1][:, None] - c[i][None, :]) - (s[j + 1][:, None] - s[i][None, :])
            cost = np.where(i[None, :] <= j[:, None], cost, np.iinfo(np.int64).max)
            k = cost.argmin(axis=1)
            low = cost[np.arange(len(j)), k]
            better = low < now[j]
            now[j[better]], back[j[better]] = low[better], i[k[better]]
        best = now
        choice.append(back)
        costs.append(now)
    out, j = [], m - 1
    for back in reversed(choice):
        out.append(int(border[j]))
        if back[j] == 0:
            break
        j = back[j] - 1
    return out[::-1]


def histogram(lengths: DataFrame, length: str = "n_tokens") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest length, documents, sum of lengths) of every class that occurs."""
    t = lengths.groupBy(F.col(length).cast("long").alias("_len")).agg(F.count(F.lit(1)).alias("_docs")).withColumn("_n", F.col("_len") - 1)
    # the width of a class is its power of two over TAIL; bin() counts binary digits without rounding
    t = t.withColumn("_bits", F.greatest(F.length(F.bin("_n")) - TAIL.bit_length(), F.lit(0)))
    klass = F.when(F.col("_len") <= CLASSES, F.col("_len")).otherwise(F.expr("shiftleft(shiftright(_n, _bits) + 1, _bits)"))
    rows = (t.groupBy(klass.alias("k")).agg(F.max("_len").alias("top"), F.sum("_docs").alias("n"), F.sum(F.col("_len") * F.col("_docs")).alias("s"))
            .orderBy("top").collect())
    column = lambda name: np.array([r[name] for r in rows], dtype=np.int64)
    return column("top"), column("n"), column("s")


def pack(docs: DataFrame, keep: Sequence[str], doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None,
         buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` of every document in the struct ``doc``, with ``n_tokens``,
    ``bucket``, ``bucket_len`` (padded length), ``batch`` (number within the
    bucket) and ``slot`` (place in the batch)."""
    tokens = n_words(text) if tokens is None else tokens
    border, count, total = histogram(docs.select(tokens.alias("n_tokens")))
    edges = borders(border, count, total, buckets)
    # how many documents each bucket holds, from the histogram
    held = [int(count[(border <= e) & (border > (edges[i - 1] if i else -1))].sum()) for i, e in enumerate(edges)] or [0]
    number = lambda values: F.array(*[F.lit(v).cast("long") for v in values or [0]])
    of = lambda values: F.element_at(number(values), F.col("bucket") + 1)
    upper = number(edges[:-1]) if len(edges) > 1 else F.array().cast("array<bigint>")
    # inside the lambda the tokens are a value; outside they would be counted for every border
    found = F.get(F.transform(F.array(tokens), lambda n: F.struct(n.alias("n"), F.size(F.filter(upper, lambda e: e < n)).alias("b"))), F.lit(0))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("doc"), F.col(doc_id).alias("_id"), found.alias("_p"))
    rows = rows.select("doc", "_id", F.col("_p.n").alias("n_tokens"), F.col("_p.b").alias("bucket"))
    rows = rows.withColumn("bucket_len", of(edges)).withColumn("_order", F.xxhash64(F.lit(seed), "_id", "n_tokens"))
    rows = rows.withColumn("_shard", F.pmod(F.col("_order"), of([max(1, -(-n // shard_rows)) for n in held])).cast("int"))
    shards = rows.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = materialize(shards.select("bucket", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "shards")
    place = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_order", "_id", "n_tokens")) - 1
    laid = rows.withColumn("_row", place).join(shards, ["bucket", "_shard"]).withColumn("_row", F.col("_row") + F.col("_before"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    return laid.select("doc", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_row") / room).cast("long").alias("batch"),
                       (F.col("_row") % room).cast("long").alias("slot"))
