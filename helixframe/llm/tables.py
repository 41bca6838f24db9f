"""Table helpers shared by the operators: step tables, clash-free columns, and
connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard as drop_table, materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """A step table, without the shuffle files of its job: nothing reads them again,
    but Spark keeps them until the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


WORDS = 1 << 20        # most words of 64 bits of a filter


def may_hold(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of ``ids``: all that are, and about
    one of 16 others. Ids set bits of a table of bounded size, which is broadcast."""
    words = min(WORDS, 1 << max(ids.count() // 4 - 1, 0).bit_length())
    hashed = F.xxhash64(F.col(key).cast("long"))
    word, bit = F.pmod(hashed, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    bits = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = df.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return found.select(*df.columns)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (a, b: long).

    Alternates large-star and small-star steps until no edge changes. Each step
    takes the smallest neighbour by a hash aggregation with map-side combining
    and joins it back, so a node with very many neighbours is not gathered; the
    number of rows never exceeds that of the edges plus nodes. Null ends and
    loops are ignored. Returns ``node``, ``component`` for nodes with an edge;
    an empty table for no edges.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = stored(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    signature = None
    while True:
        large = _star(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), small=False)
        small = _star(large, small=True)
        after = stored(small, label)
        drop_table(now)
        now = after
        row = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.hash("u", "v"), F.lit(1 << 20))).alias("s")).first()
        if tuple(row) == signature:
            break
        signature = tuple(row)
    # all edges are (node, root) now
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step. Large: link every larger neighbour of u to the smallest of
    its neighbours and itself. Small: the same for smaller neighbours and u."""
    near = edges.where("v < u") if small else edges
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        out = moved.where("v > u").select(F.col("v").alias("x"), "m")
    out = out.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
    return out.distinct() if small else out


def with_components(nodes: DataFrame, node: str, edges: DataFrame, label: str = "cc") -> DataFrame:
    """Add ``component_id`` (smallest reachable id, itself included) to rows
    whose ``node`` column may stand alone."""
    c = components(edges, label).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return (nodes.join(c, F.col(node) == F.col("_node"), "left")
            .withColumn("component_id", F.coalesce("_component", node)).drop("_node", "_component"))


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches of texts small: at most ``rows`` records each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
