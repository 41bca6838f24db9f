"""Joins and ordered scans that stay balanced when one key holds a large share
of the rows. Nothing here drops or samples result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SALTS = 64
TOP = 256        # at most this many hot keys are looked for


def hot_keys(df: DataFrame, key: Column, share: float = 1 / 512) -> list:
    """Values of a single key column that hold at least ``share`` of the rows.

    One pass with a bounded frequent-items sketch (no shuffle of the data); by
    definition at most 1/share values qualify, so the list that reaches the
    driver is bounded whatever the input size. The list only steers salting.
    """
    sketch = F.expr("approx_top_k(_k, %d, %d)" % (TOP, TOP * 40))
    row = df.select(key.alias("_k")).where("_k is not null").agg(
        sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in row["top"] or [] if t["count"] >= max(row["n"] * share, 2)]


def join_unique(many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "inner",
                hot: Sequence | None = None) -> DataFrame:
    """Join a large side with one whose key is unique (``how``: inner or left).

    With ``hot`` keys given, rows of those keys on the large side are spread
    over ``SALTS`` tasks and the matching rows of the unique side are repeated
    that often: at most len(hot) * SALTS extra rows. Without it the adaptive
    skew join splits oversized partitions at run time, since each of them meets
    a single row of the unique side.
    """
    on = list(on)
    if not hot:
        return many.join(one, on, how)
    is_hot = F.col(on[0]).isin(list(hot))
    # the salt follows from the row, so a task that runs again gives the same one
    salt = F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")
    salted = many.withColumn("_salt", F.when(is_hot, salt).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(one.withColumn("_salt", F.explode(copies)), on + ["_salt"], how).drop("_salt")


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "blocks") -> DataFrame:
    """Range-partition by (keys, order) and number the partitions in ``_blk``.

    The blocks of a key are consecutive stretches of its ordered rows, so a
    window over (keys, _blk) is bounded by the partition size even when one key
    holds most of the table. The table is written out, which fixes the numbering.
    """
    ranged = df.repartitionByRange(*[F.col(x) for x in [*keys, *order]])
    return materialize(ranged.withColumn("_blk", F.spark_partition_id()), label)


def _block_window(keys, order):
    return Window.partitionBy(*keys, "_blk").orderBy(*order)


def lagged(blocks: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str],
           ahead: bool = False) -> DataFrame:
    """Value of the previous (or, with ``ahead``, next) row in (keys, order) for
    ``columns`` {source: name}. Rows at the edge of a block take the nearest row
    of the neighbouring block."""
    w = _block_window(keys, order)
    packed = F.struct(*[F.col(s).alias(n) for s, n in columns.items()])
    pick = F.min_by if ahead else F.max_by
    edge = blocks.groupBy(*keys, "_blk").agg(pick(packed, F.struct(*order)).alias("_edge"))
    shift = F.lead if ahead else F.lag
    carry = edge.select(*keys, "_blk", shift("_edge").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carry"))
    joined = blocks.withColumn("_near", shift(packed).over(w)).join(carry, [*keys, "_blk"], "left")
    near = F.coalesce("_near", "_carry")
    for n in columns.values():
        joined = joined.withColumn(n, near[n])
    return joined.drop("_near", "_carry")


def running_sum(blocks: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in (keys, order): sums inside blocks
    plus the totals of the blocks before. ``blocks`` must be a stored table."""
    totals = blocks.groupBy(*keys, "_blk").agg(F.sum(value).alias("_t"))
    before = totals.select(*keys, "_blk", F.coalesce(F.sum("_t").over(
        Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    w = _block_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (blocks.withColumn("_in", F.sum(value).over(w)).join(before, [*keys, "_blk"], "left")
            .withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before"))


def halo_blocks(df: DataFrame, position: str, size: int, reach: int) -> DataFrame:
    """Give each row to the coordinate block (column ``_blk``) of its position
    and to the earlier blocks whose rows look ``reach`` positions ahead. Frames
    of at most ``reach`` rows then never cross a block; rows with ``_own`` are
    the ones to keep. Positions must be unique within the partition keys."""
    p = F.col(position)
    first = F.floor(F.greatest(p - reach, F.lit(0)) / size)
    return (df.withColumn("_blk", F.explode(F.sequence(first, F.floor(p / size))))
            .withColumn("_own", F.col("_blk") == F.floor(p / size)))
