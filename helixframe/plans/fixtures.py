"""The driver tables seen as sequence data: each projection exists as a
DataFrame and as a SQL common table expression with the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread

# fixed values: the letter-to-base code of the fixture projections
LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _to_bases(text):
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, AS_BASES)


def reads(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("read_id"), _to_bases("text").alias("seq"))


def reads_n(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.regexp_replace(F.regexp_replace(F.lower("text"), r"\s", ""), "[^a-z]", "0")
    return docs.select(F.col("doc_id").alias("read_id"), F.translate(kept, LETTERS + "0", AS_BASES + "N").alias("seq"))


def contigs(spark, sf_dir) -> DataFrame:
    t = spread(table(spark, sf_dir, "benchmark"))
    return t.select(F.col("item_id").alias("contig_id"), _to_bases("text").alias("seq"),
                    (F.col("item_id") % 50 + 1).cast("int").alias("cov"))


def headers(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(
        F.lit("seq"), d, F.lit("_len"), F.col("n_chars"), F.lit("_cov"), d % 90,
        F.lit("_read100_maxK89_cluster"), d % 7).alias("name"))


def nodes(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("node"), (F.col("p_size") * 100).cast("bigint").alias("len"),
        F.floor("p_retailprice").cast("int").alias("cov"), (p % 7).alias("cluster"))


def tag_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tag"), F.col("l_partkey").alias("node"))


def folded(key: str):
    """The node of a part key among the linked nodes."""
    k = F.col(key)
    return F.floor(F.sqrt(k)).cast("bigint") * 4 + k % 4


def folded_sql(key: str) -> str:
    return f"(cast(floor(sqrt({key})) as bigint) * 4 + {key} % 4)"


def links(spark, sf_dir) -> DataFrame:
    """Every two lines of an order whose parts fall to different nodes link
    them; offsets are line numbers, the gap is the difference of quantities.
    Part keys fold to about four nodes for each unit of their square root: nodes of
    larger keys take more lines, so two nodes share from one to dozens of links at
    any scale factor; no line is left out."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair"), folded("l_partkey").alias("id"), F.col("l_linenumber").alias("off"),
        F.floor("l_quantity").cast("bigint").alias("q"))
    one, two = (li.select("pair", *[F.col(c).alias(f"{c}{i}") for c in ("id", "off", "q")]) for i in (1, 2))
    return one.join(two, "pair").where("id1 < id2").select(
        "pair", "id1", "id2", "off1", "off2", (F.col("q2") - F.col("q1")).alias("gap"), (F.col("q2") + F.col("q1")).alias("score"))


def positions(spark, sf_dir) -> DataFrame:
    at = F.expr("cast(date_diff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) as bigint)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tag"), F.col("event_type").alias("node"), at.alias("pos"), "value", "event_id")


def intervals(spark, sf_dir) -> DataFrame:
    return positions(spark, sf_dir).select(
        "node", "tag", F.col("pos").alias("s"), (F.col("pos") + F.floor("value").cast("bigint")).alias("e"))


def spectra(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label"))


def hits(spark, sf_dir) -> DataFrame:
    """Long-read hits: an order is a read, its lines lie on parts."""
    s = (F.col("l_linenumber") * 100 + F.floor("l_quantity") * 7).cast("bigint")
    span = (F.floor("l_quantity") * 9).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("node"), s.alias("q_start"),
        (s + span).alias("q_end"), (F.floor("l_extendedprice") % 1000).cast("bigint").alias("score"),
        F.floor(span * F.when(F.col("l_returnflag") == "R", 0.75).otherwise(0.9)).cast("bigint").alias("match"),
        (F.col("l_suppkey") * 10).cast("bigint").alias("t_start"))


SQL = {
    "reads": f"""reads AS (SELECT doc_id AS read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
        '{LETTERS}', '{AS_BASES}') AS seq FROM documents)""",
    "reads_n": rf"""reads_n AS (SELECT doc_id AS read_id, translate(regexp_replace(regexp_replace(lower(text), '\s', '', 'g'),
        '[^a-z]', '0', 'g'), '{LETTERS}0', '{AS_BASES}N') AS seq FROM documents)""",
    "contigs": f"""contigs AS (SELECT item_id AS contig_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
        '{LETTERS}', '{AS_BASES}') AS seq, cast(item_id % 50 + 1 as int) AS cov FROM benchmark)""",
    "headers": """headers AS (SELECT concat('seq', doc_id, '_len', n_chars, '_cov', doc_id % 90,
        '_read100_maxK89_cluster', doc_id % 7) AS name FROM documents)""",
    "nodes": """nodes AS (SELECT p_partkey AS node, cast(p_size * 100 as bigint) AS len,
        cast(floor(p_retailprice) as int) AS cov, p_partkey % 7 AS cluster FROM part)""",
    "tag_rows": "tag_rows AS (SELECT l_orderkey AS tag, l_partkey AS node FROM lineitem)",
    "links": f"""li AS (SELECT l_orderkey AS pair, {folded_sql('l_partkey')} AS id, l_linenumber AS off, cast(floor(l_quantity) as bigint) AS q FROM lineitem),
      links AS (SELECT a.pair, a.id AS id1, b.id AS id2, a.off AS off1, b.off AS off2, b.q - a.q AS gap, b.q + a.q AS score
        FROM li a JOIN li b ON a.pair = b.pair AND a.id < b.id)""",
    "positions": """positions AS (SELECT user_id AS tag, event_type AS node, cast(floor(epoch(ts)) as bigint) AS pos,
        value, event_id FROM events)""",
    "intervals": """intervals AS (SELECT event_type AS node, user_id AS tag, cast(floor(epoch(ts)) as bigint) AS s,
        cast(floor(epoch(ts)) as bigint) + cast(floor(value) as bigint) AS e FROM events)""",
    "spectra": "spectra AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings)",
    "hits": """hits AS (SELECT l_orderkey AS read_id, l_partkey AS node,
        cast(l_linenumber * 100 + floor(l_quantity) * 7 as bigint) AS q_start,
        cast(l_linenumber * 100 + floor(l_quantity) * 16 as bigint) AS q_end,
        cast(floor(l_extendedprice) as bigint) % 1000 AS score,
        cast(floor(floor(l_quantity) * 9 * CASE WHEN l_returnflag = 'R' THEN 0.75 ELSE 0.9 END) as bigint) AS match,
        cast(l_suppkey * 10 as bigint) AS t_start FROM lineitem)""",
}

def sql(body: str, *names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + body


KMERS_SQL = """{out} AS (SELECT * FROM (SELECT {keep}, i AS pos, substring(seq, cast(i as int) + 1, {k}) AS f
    FROM (SELECT *, unnest(range(0, greatest(length(seq) - {k} + 1, 0))) AS i FROM {src})) WHERE NOT contains(f, 'N'))"""


def kmers_sql(src: str, out: str, keep: str, k: int) -> str:
    """CTE with all windows of k bases: ``keep``, pos, f (the text as it stands)."""
    return KMERS_SQL.format(src=src, out=out, keep=keep, k=k)


def canon_sql(x: str) -> str:
    return f"least({x}, reverse(translate({x}, 'ACGT', 'TGCA')))"
