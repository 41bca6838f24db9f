"""Readers for sequence files and tables.

Text goes through Spark's own text source (which also opens .gz and .bz2), so
large plain files are split among tasks and listing works on any file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.bases import barcode, header_length_like, header_number, known_pieces, known_length
from ..session import materialize

PAF_SCHEMA = ("q_name string, q_len bigint, q_start bigint, q_end bigint, strand string, t_name string, "
              "t_len bigint, t_start bigint, t_end bigint, match bigint, aln_len bigint, mapq int")


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(name, seq): a record starts at a line with '>', its sequence may span
    lines. The separator is a line break plus '>', so records are the rows."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    head = F.regexp_replace("value", r"^>", "")
    name = F.regexp_extract(head, r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(head, r"^[^\n]*(\n|$)", ""), r"\s", ""))
    return raw.where(F.length(F.trim("value")) > 0).select(name.alias("name"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """(name, seq, ord): four-line records. Lines are numbered inside a file by
    their byte-ordered partitions; only per-partition line counts reach the
    driver side of the plan, the records are put together by a grouped join of
    line numbers div 4."""
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("_m"), F.col("_metadata.file_path").alias("_f"))
    lines = materialize(lines.select("*", F.shiftright("_m", 33).alias("_p"),
                                     F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"),
                                     F.input_file_block_start().alias("_s")), "fastq")
    per = lines.groupBy("_f", "_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_f", "_s", "_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    first = lines.groupBy("_f", "_s", "_p").agg(F.min("_i").alias("_z"))
    at = (lines.join(starts.join(first, ["_f", "_s", "_p"]), ["_f", "_s", "_p"])
          .withColumn("_l", F.col("_i") - F.col("_z") + F.col("_o")))
    rec = at.groupBy("_f", F.floor(F.col("_l") / 4).alias("ord")).agg(
        F.max(F.when(F.col("_l") % 4 == 0, F.expr("substring(value, 2)"))).alias("name"),
        F.max(F.when(F.col("_l") % 4 == 1, F.upper("value"))).alias("seq"),
        F.max(F.when(F.col("_l") % 4 == 3, F.col("value"))).alias("qual"))
    return rec.where("seq is not null").select("name", "seq", "qual", "ord", F.col("_f").alias("file"))


def sniff_format(spark: SparkSession, path) -> str:
    """FASTA, FASTQ or UNKNOWN, from the first line that is not empty."""
    row = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).first()
    mark = row["value"][:1] if row else ""
    return {">": "FASTA", "@": "FASTQ"}.get(mark, "UNKNOWN")


def sniff_quality_offset(reads: DataFrame) -> int:
    """33 or 64: a quality letter below ';' proves the offset of 33."""
    low = reads.select(F.regexp_like("qual", F.lit("[!-:]")).alias("low")).agg(F.bool_or("low").alias("x")).first()["x"]
    return 33 if low else 64


def read_sequences(spark: SparkSession, path) -> DataFrame:
    kind = sniff_format(spark, path)
    if kind == "FASTA":
        return read_fasta(spark, path)
    if kind == "FASTQ":
        return read_fastq(spark, path).select("name", "seq")
    raise ValueError(f"neither FASTA nor FASTQ: {path}")


def interleaved_pairs(reads: DataFrame, order: str = "ord", outward: bool = False) -> DataFrame:
    """Alternate records are mates; mates of outward libraries are turned round."""
    from ..functions.bases import revcomp
    o = F.col(order)
    return reads.select(F.floor(o / 2).cast("bigint").alias("pair_id"), (o % 2).cast("int").alias("mate"),
                        (revcomp("seq") if outward else F.col("seq")).alias("seq"))


def paired_files(forward: DataFrame, reverse: DataFrame, order: str = "ord") -> DataFrame:
    """Mates by record number of two files. When either side reads several files,
    they are paired in order of their names and ids go on from file to file."""
    def side(t: DataFrame, mate: int) -> DataFrame:
        if "file" not in t.columns:
            return t.select(F.col(order).alias("pair_id"), F.lit(mate).alias("mate"), "seq")
        # one row a file
        per = t.groupBy("file").agg((F.max(order) + 1).alias("_n"))
        before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
        return t.join(per, "file").select((F.col(order) + F.col("_o")).alias("pair_id"), F.lit(mate).alias("mate"), "seq")

    return side(forward, 0).unionByName(side(reverse, 1))


def with_barcode(reads: DataFrame, name: str = "name") -> DataFrame:
    return reads.withColumn("barcode", barcode(name))


def barcode_ids(reads: DataFrame) -> DataFrame:
    """Dense ids from 1 in text order. Values are ranged first, so the numbering
    is per-partition ranks plus partition totals, not one global sort task."""
    distinct = reads.where("barcode is not null").select("barcode").distinct()
    return dense_ids(distinct, "barcode", "barcode_id")


def dense_ids(distinct: DataFrame, column: str, name: str, label: str = "ids") -> DataFrame:
    from ..operators.skew import ordered_blocks
    blocks = ordered_blocks(distinct, [], [column], label)
    size = blocks.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count
    before = size.select("_blk", F.coalesce(F.sum("_n").over(
        Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_blk").orderBy(column))
    return blocks.withColumn("_r", rank).join(before, "_blk").select(column, (F.col("_r") + F.col("_before")).cast("bigint").alias(name))


def contig_table(records: DataFrame) -> DataFrame:
    """Attributes from headers: coverage (1 when missing), length, cluster (0)."""
    return records.select("name", "seq", F.length("seq").alias("len"), header_number("name", "cov", 1).alias("cov"),
                          header_number("name", "cluster", 0).alias("cluster"))


def header_attributes(records: DataFrame) -> DataFrame:
    return records.select("name", header_length_like("name", "_read").alias("read"),
                          header_length_like("name", "maxK").alias("maxk"))


def cut_unknown(contigs: DataFrame, min_len: int, keep=("contig_id",)) -> DataFrame:
    """Maximal pieces without N of the contigs that are at least ``min_len`` long."""
    return (contigs.where(F.length("seq") >= min_len)
            .select(*keep, F.posexplode(known_pieces("seq")).alias("piece", "seq")))


def read_paf(spark: SparkSession, path) -> DataFrame:
    """Alignment rows with their score (AS:i: tag, wherever it stands)."""
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    names = [x.split() for x in PAF_SCHEMA.split(", ")]
    cell = F.split("value", "\t")
    t = line.select("value", *[F.get(cell, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])
    score = F.regexp_extract("value", r"\tAS:i:(-?[0-9]+)", 1)
    return t.select("q_name", "q_len", "q_start", "q_end", "strand", "t_name", "t_len", "t_start", "t_end", "match",
                    F.when(score != "", score.cast("bigint")).otherwise(F.col("match")).alias("score"))


def read_clusters(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("name string, cluster_id bigint").option("sep", "\t").csv(path)


def read_pairs_to_unlink(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("name1 string, name2 string").option("sep", "\t").csv(path)


def read_genes(spark: SparkSession, path) -> DataFrame:
    """Gene rows (contig, start, end, strand, frame, flags): records start at a
    '# name' line that two more comment lines follow."""
    raw = spark.read.option("lineSep", "\n# ").text(path)
    # a record head is "name\\n# .. \\n# .." so its comment lines come as rows without genes
    block = F.split(F.regexp_replace("value", "^# ", ""), "\n")
    rows = raw.select(F.monotonically_increasing_id().alias("_o"), F.col("_metadata.file_path").alias("_f"),
                      F.input_file_block_start().alias("_s"), F.get(block, F.lit(0)).alias("_head"),
                      F.filter(block, lambda x: x.rlike(r"^\S+\t[0-9]+\t[0-9]+\t[+-]\t")).alias("genes"))
    is_comment = F.col("_head").rlike("^(gc|self)")
    rows = rows.withColumn("_h", F.when(~is_comment, F.col("_head")))
    name = F.last("_h", ignorenulls=True).over(Window.partitionBy("_f", "_s").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
    # a split that begins inside a record takes the last name of the splits before it
    last = rows.where("_h is not null").groupBy("_f", "_s").agg(F.max_by("_h", "_o").alias("_l"))
    splits = rows.select("_f", "_s").distinct().join(last, ["_f", "_s"], "left")
    before = F.last("_l", ignorenulls=True).over(Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    named = rows.withColumn("_n", name).join(splits.select("_f", "_s", before.alias("_b")), ["_f", "_s"])
    part = named.withColumn("contig", F.trim(F.coalesce("_n", "_b"))).select("contig", F.explode("genes").alias("g"))
    f = F.split("g", "\t")
    return part.select("contig", f[0].alias("gene"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"),
                       f[3].alias("strand"), f[4].cast("int").alias("frame"), f[5].alias("flags"))


def coding_sequence(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """Coding text per contig, genes in order of start, parted by NNN."""
    from ..functions.bases import revcomp
    body = F.substring(F.col("seq"), F.col("start"), F.col("end") - F.col("start") + 1)
    part = F.when(F.col("strand") == "-", revcomp(body)).otherwise(body)
    part = F.substring(part, F.col("frame") + 1, F.length(part))
    g = genes.join(contigs.select(F.col("name").alias("contig"), "seq"), "contig").select(
        "contig", F.struct("start", part.alias("cds")).alias("g"))
    cat = F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda x: x["cds"]), "NNN")
    return g.groupBy("contig").agg(cat.alias("cds"))


def filter_read_pairs(pairs: DataFrame, min_len: int, max_len: int) -> DataFrame:
    """Pairs whose two mates have no N and suit the length limits."""
    ok = (known_length("seq") == F.length("seq")) & (F.length("seq") >= min_len) & (F.length("seq") <= max_len)
    good = pairs.groupBy("pair_id").agg(F.bool_and(ok).alias("ok")).where("ok").select("pair_id")
    return pairs.join(good, "pair_id", "left_semi")


def cap_depth(reads: DataFrame, order: str, max_bases: int) -> DataFrame:
    """Reads in ``order`` until the total number of bases passes ``max_bases``."""
    from ..operators.skew import ordered_blocks, running_sum
    sized = reads.withColumn("_len", F.length("seq").cast("bigint")).withColumn("_all", F.lit(0))
    run = running_sum(ordered_blocks(sized, ["_all"], [order], "depth"), ["_all"], [order], "_len", "_cum")
    return run.where(F.col("_cum") - F.col("_len") < max_bases).drop("_len", "_cum", "_all", "_blk")


def parse_size(text: str) -> int:
    """'1k', '2.5M' or '3G' as a number."""
    units = {"k": 10 ** 3, "m": 10 ** 6, "g": 10 ** 9}
    t = text.strip()
    if t and t[-1].lower() in units:
        return int(float(t[:-1]) * units[t[-1].lower()])
    return int(float(t))
