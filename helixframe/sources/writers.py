"""Writers: FASTA text, TSV tables, per-cluster folders, BED rows, Newick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bases import c, header_number, wrap


def fasta_text(name, seq) -> Column:
    return F.concat(F.lit(">"), c(name), F.lit("\n"), wrap(seq))


def contig_name(prefix: str, number, length, cov, read: int, maxk: int) -> Column:
    return F.concat(F.lit(prefix), c(number), F.lit("_len"), c(length), F.lit("_cov"), c(cov),
                    F.lit(f"_read{read}_maxK{maxk}"))


def write_fasta(records: DataFrame, path: str, name="name", seq="seq", min_len: int = 0) -> None:
    """One text row per record, written in parallel; short records are left out."""
    (records.where(F.length(c(seq)) >= max(min_len, 1)).select(fasta_text(name, seq).alias("value"))
     .write.mode("overwrite").text(path))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def dense_histogram(hist: DataFrame, value: str = "occ") -> DataFrame:
    """All values from 1 to the largest, empty ones with 0, in order."""
    spark = hist.sparkSession
    top = hist.agg(F.max(value).alias("t")).scalar()
    # values are bounded (occurrences by 65 534, lengths by 500 000)
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(1).cast("bigint"), top.cast("bigint"))).alias(value))
    return grid.join(hist.withColumn(value, F.col(value).cast("bigint")), value, "left").select(
        value, F.coalesce("n", F.lit(0)).alias("n")).orderBy(value)


def write_by_cluster(records: DataFrame, path: str, cluster: str = "cluster_id") -> None:
    """One folder per cluster; cluster 0 (or none) goes to 'unclassified'. The
    rows of a big cluster stay spread over the writing tasks."""
    label = F.when(F.coalesce(F.col(cluster), F.lit(0)) == 0, F.lit("unclassified")).otherwise(F.col(cluster).cast("string"))
    (records.select(label.alias("cluster"), fasta_text("name", "seq").alias("value"))
     .write.mode("overwrite").partitionBy("cluster").text(path))


def component_rows(parts: DataFrame) -> DataFrame:
    """Component table: one row per part, each with its scaffold name."""
    return parts.select("name", "start", "end", "contig", F.lit(0).alias("score"),
                        F.when(F.col("strand") < 0, "-").otherwise("+").alias("strand"))


def name_index(records: DataFrame) -> DataFrame:
    from .readers import dense_ids
    return dense_ids(records.select("name").distinct(), "name", "index", "names")


def cluster_rows(records: DataFrame) -> DataFrame:
    """(name, cluster) of the headers that carry a cluster other than 0."""
    return records.select("name", header_number("name", "_cluster", 0).alias("cluster")).where("cluster <> 0")


def attach_clusters(records: DataFrame, clusters: DataFrame) -> DataFrame:
    return records.join(clusters, "name", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))


def reformed(records: DataFrame) -> DataFrame:
    """Short headers (no read/maxK part, no polisher mark), length written anew,
    upper-case wrapped sequence."""
    n = F.regexp_replace("name", r"_read\d+_maxK\d+", "")
    n = F.regexp_replace(n, r"_np1212$", "")
    n = F.regexp_replace(n, r"_len\d+", F.concat(F.lit("_len"), F.length("seq").cast("string")))
    return records.select(n.alias("name"), wrap(F.upper("seq")).alias("seq"))


def renumbered(bins: DataFrame) -> DataFrame:
    """Cluster ids in numeric order become 1, 2, ...; 0 stays 0."""
    from .readers import dense_ids
    ids = dense_ids(bins.where("cluster <> 0").select("cluster").distinct(), "cluster", "bin", "bins")
    return bins.join(ids, "cluster", "left").select("name", F.coalesce("bin", F.lit(0)).alias("bin"))


def bubble_sets(records: DataFrame) -> dict[str, DataFrame]:
    """Results split by node state: primary and secondary bubble arms, sequences
    between bubbles and others, with the pairs of arms as a table."""
    r = records
    return {
        "primary": r.where("primary"),
        "secondary": r.where("secondary"),
        "non_bubble_hetero": r.where("not primary and not secondary and hetero"),
        "non_bubble_other": r.where("not primary and not secondary and not hetero"),
        "relation": r.where("primary").select(F.col("name").alias("primary_name"), "opposite").join(
            r.where("secondary").select(F.col("node").alias("opposite"), F.col("name").alias("secondary_name")), "opposite"),
    }
