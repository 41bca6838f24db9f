"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share the corpus by weight; a source never gives more than ``repeats``
times its words, and what it cannot take goes to the others by weight. The
targets become integer numbers of equal blocks by the highest quotients
votes / (2 seats + 1); the blocks of a source are apportioned to its shards in
the same way. A shard lays its documents out in a seeded order and takes its
quota of blocks from a seeded block on, round and round. A source has as many
shards as its words ask for, so a source that holds a third of the corpus is
spread like the others.

Only one row a source or shard is ever ordered as a whole. Of all quotients just
those that can be decided either way (about two a party) are ranked.

Defined cases: null and empty texts have no words and are taken zero words of;
a null source is one source, last in order; repeated rows count as often as they
stand; an empty table or one without words gives targets of zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import words as W

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SEED = 17


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, votes: str, seats: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``quota``: the seats of each party of a group ``by`` when the group's
    number of ``seats`` goes to the highest quotients votes / (2 i + 1); equal
    quotients go in the order of ``tie``. Divisors that surely give at most and
    at least all seats bound what is contested."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    t = parties.withColumn("_v", F.sum(votes).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    # v / divisor rounds to the seats; the divisors are V / (seats -+ n / 2)
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0)
    sure = F.greatest(F.floor(share * (F.col(seats) - F.col("_n") / 2) + 0.5) - 1, F.lit(0))
    most = F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1
    t = t.withColumn("_sure", sure).withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    keys = [*by, *tie]
    open_ = (t.where(F.col(votes) > 0).withColumn("_i", F.explode(F.sequence(F.col("_sure"), F.greatest(most, F.col("_sure")))))
             .withColumn("_q", F.col(votes) / (2 * F.col("_i") + 1)))
    won = (open_.withColumn("_r", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_q"), *tie)))
           .where("_r <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won")))
    return (t.join(won, keys, "left").withColumn("quota", (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long"))
            .drop("_v", "_n", "_sure", "_left", "_won"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """From rows (_key, source, source_size) add ``target``: the share by weight,
    at most ``repeats`` times the size; the excess is shared by weight again
    until no source is above. Sources by code point, null last, take the
    weights in turn."""
    one = Window.partitionBy(F.lit(0))
    order = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    t = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.lit(repeats) * F.col("source_size")).withColumn("_all", F.sum("source_size").over(one))
    # sources that reach their cap at the lowest level come first
    level = one.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    t = t.withColumn("_full", F.coalesce(F.sum("_cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_weight", F.sum("_w").over(level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_weight"))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    # the level at the first source that stays below its cap; it only grows after it
    t = t.withColumn("_level", F.first(fits, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return (t.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.lit(0.0))))
            .drop("_w", "_cap", "_all", "_full", "_weight", "_level"))


def plan(docs: DataFrame, keep: Sequence[str], doc_id: str = "doc_id", source: str = "source", text: str = "text",
         weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
         shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` of every document in the struct ``doc``, with ``size``, ``source_size``,
    ``target``, ``passes`` (whole copies), ``parts`` (word ranges taken once
    more) and ``taken``."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("doc"), F.col(source).alias("source"), key.alias("_key"),
                       n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("_order"), F.col(doc_id).alias("_id"))
    sizes = docs.select(key.alias("_key"), F.col(source).alias("source"), n_words(text).alias("size")).groupBy("_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"))
    wanted = targets(sizes, weights, repeats)
    wanted = wanted.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    sources = materialize(sainte_lague(wanted, "target", "_seats", ["_key"]).withColumnRenamed("quota", "_blocks")
                          .withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("int"))
                          .drop("source", "_seats"), "sources")
    placed = rows.join(sources, "_key").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), F.col("_shards")).cast("int"))
    shards = placed.groupBy("_key", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    quotas = materialize(sainte_lague(shards, "_words", "_blocks", ["_shard"], ["_key"]).drop("_blocks"), "quotas")
    words = F.least(F.col("quota") * block_words, repeats * F.col("_words"))
    quotas = quotas.select("_key", "_shard", "_words", F.when(F.col("_words") > 0, F.floor(words / F.col("_words"))).otherwise(0).alias("passes"),
                           F.when(F.col("_words") > 0, words % F.col("_words")).otherwise(0).alias("_rest"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_shard"), F.greatest(F.floor(F.col("_words") / block_words), F.lit(1))) * block_words
    quotas = quotas.withColumn("_from", first)
    order = Window.partitionBy("_key", "_shard").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, ["_key", "_shard"])
    # the words [_from, _from + _rest) of the shard, wrapped at its end
    end = F.col("_from") + F.col("_rest")

    def part(a: Column, b: Column) -> Column:
        lo, hi = F.greatest(a - F.col("_at"), F.lit(0)), F.least(b - F.col("_at"), F.col("size"))
        return F.struct(lo.cast("long").alias("a"), hi.cast("long").alias("b"))

    parts = F.filter(F.array(part(F.lit(0), end - F.col("_words")), part(F.col("_from"), F.least(end, F.col("_words")))), lambda p: p["a"] < p["b"])
    return (laid.withColumn("parts", parts)
            .withColumn("taken", (F.col("passes") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["b"] - p["a"])).cast("long"))
            .select("doc", "size", "source_size", "target", F.col("passes").cast("int").alias("passes"), "parts", "taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix with their columns: a row for each whole copy
    and one for each part, whose text runs from its first to its last word."""
    columns = docs.columns
    chosen = plan(docs, columns, doc_id, source, text, **options)
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    copies = chosen.withColumn("_p", F.explode(F.concat(F.array_repeat(whole, F.col("passes")), F.col("parts")))).where("size > 0")
    rows = copies.select("doc.*", F.struct(F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), "size").alias("_part"))
    at = columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, text):
            parts = piece.column(len(columns))
            a, b, size = (parts.field(i).to_numpy() for i in range(3))
            texts = piece.column(at)
            if ((a > 0) | (b < size)).any():
                w = W.split(texts)
                lo, hi = w.start[w.first[:-1] + a], w.end[w.first[:-1] + b - 1]
                texts = pa.array([t if x == 0 and y == n else w.data[i:j].tobytes().decode() for t, x, y, n, i, j in
                                  zip(texts.to_pylist(), a, b, size, lo, hi)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at else piece.column(i) for i in range(len(columns))], columns)

    out = rows.mapInArrow(cut, docs.schema)
    if n_chars in columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out
