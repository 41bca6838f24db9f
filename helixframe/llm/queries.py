"""The registered queries of the operators, with SQL where SQL can express them.

Each query applies its operator with production parameters to its whole table
and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, embed_dedup, license, mix, neardup, packing, phrases, pii, rules, simhash, substring, toxic, vector_codes
from .tables import arrow_rows, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


WORD = r"[^\x20\x09-\x0D]+"


@query("op5_quality_rules", rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM r, (SELECT unnest([0, 1, 2]) AS s) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(failed & 3 AS BIGINT) <> 0 AS base_failed,
       failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    led = rules.ledger(read(spark, sf_dir, "documents"), ["doc_id"])
    value = lambda m: F.col(f"ledger.{m}").alias(m)
    return led.select("doc_id", *map(value, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]),
                      rules.fails("base").alias("base_failed"), (~rules.fails("v1")).alias("kept"), value("failed"))


@query("op7_minhash_near_dedup", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
    FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(10) || ws[i + 1]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=2)


@query("op1_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e, list_dot_product(e, e) AS q FROM v WHERE len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id""")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op2_sainte_lague_mix")
def sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix.plan(read(spark, sf_dir, "documents"), ["doc_id"])
    return plan.select("doc.doc_id", "size", "source_size", "target", "taken")


@query("op3_quotation_links")
def quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.quotation_links(read(spark, sf_dir, "conversations"))


@query("op4_length_buckets")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), ["doc_id"])
    return packed.select("doc.doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot")


@query("op6_substring_dedup", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], chr(10)) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, i + s AS i FROM f, (SELECT unnest(range(20)) AS s) WHERE k > 1),
k AS (SELECT t.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY t.i) AS kept
      FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return substring.remove_repeats(read(spark, sf_dir, "documents"), length=20).drop("kept_text")


@query("op8_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return license.summary(read(spark, sf_dir, "documents"))


@query("op9_pii_contexts")
def pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pii.spans(read(spark, sf_dir, "documents"))
    n_base = len(pii.KINDS) - 1
    base = F.filter("spans", lambda x: x["kind"] < n_base)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *map(count, pii.KINDS[:n_base]), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op10_toxicity_cnn")
def toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxic.fit(docs, labels.where(~held_out))
    out = toxic.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
                      (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
                      F.col("toxicity.threshold").alias("threshold"), F.col("toxicity.flagged").alias("flagged"))


def _codes_sql() -> str:
    """Four rounds of exact assignment and rounded-down means, written out."""
    near = lambda c: f"""SELECT id, p, min(({{0}} + list_dot_product(e, e) - 2 * list_dot_product(x, e))::BIGINT * 256 + c) AS m
        FROM x JOIN {c} USING (p) GROUP BY id, p""".format("list_dot_product(x, x)")  # noqa: E731
    steps = [r"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT id, p, q[p * (len(q) // 4) + 1:(p + 1) * (len(q) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS c, x AS e FROM x QUALIFY c < 256)"""]
    for k in range(4):
        steps.append(f"a{k} AS MATERIALIZED ({near(f'c{k}')})")
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, c, coalesce(n.e, o.e) AS e FROM c{k} o LEFT JOIN (
    SELECT p, c, list(floor(s / n) ORDER BY i) AS e FROM (SELECT p, m % 256 AS c, i, sum(x[i]) AS s, count(*) AS n
        FROM a{k} JOIN x USING (id, p), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM x))) AS i) GROUP BY p, m % 256, i) GROUP BY p, c) n USING (p, c))""")
    steps.append(f"a4 AS ({near('c4')})")
    return ",\n".join(steps) + """,
r AS (SELECT id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY id)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(CAST(e[i] AS BIGINT)::VARCHAR, ',' ORDER BY p, c, i)) FROM c4, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM x))) AS i)) AS codebooks_sha256
FROM r JOIN v USING (id)"""


@query("op11_vector_codes", _codes_sql())
def vector_codes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read(spark, sf_dir, "embeddings"))


@query("op12_phrase_collocations", r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' '))))) AS phrase FROM w),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, phrase HAVING count(*) >= 10),
c AS (SELECT * FROM f WHERE len(ws) > 1),
k AS (SELECT lang, phrase, f, k, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < len(ws)),
s AS (SELECT k.lang, k.phrase, k.f AS a, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * k.f * k.f // (CAST(x.f AS HUGEINT) * y.f) AS score, k
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE len(ws) = 3) GROUP BY lang, phrase),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
    FROM m LEFT JOIN h ON h.lang = m.lang AND h.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


@query("op13_simhash", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nx FROM documents),
v AS (SELECT doc_id, 0 AS kind, t FROM d UNION ALL SELECT doc_id, 1, substr(t, 1, n - n // 4) || substr(nx, 1, n // 4) FROM d),
w AS (SELECT doc_id, kind, t, regexp_extract_all(t, '{WORD}') AS ws FROM v),
g AS (SELECT doc_id, kind, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS term FROM w),
h AS (SELECT doc_id, kind, ('0x' || substr(md5(term), 1, 15))::BIGINT AS h, least(15, length(term)) AS n FROM g),
f AS (SELECT doc_id, kind, {" + ".join(f"CASE WHEN 2 * sum(((h >> {b}) & 1) * n) > sum(n) THEN {1 << b} ELSE 0 END" for b in range(60))} AS fp FROM h GROUP BY doc_id, kind),
p AS (SELECT w.doc_id, coalesce(max(fp) FILTER (w.kind = 0), 0)::BIGINT AS a, coalesce(max(fp) FILTER (w.kind = 1), 0)::BIGINT AS b, sha256(max(w.t) FILTER (w.kind = 1)) AS edited_sha256
    FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.kind = w.kind GROUP BY w.doc_id),
q AS (SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id), first_value(a) OVER (ORDER BY doc_id)) AS c FROM p),
u AS (SELECT a, count(*) AS k FROM p GROUP BY a),
m AS (SELECT x.a, sum(y.k)::BIGINT - 1 AS n_near FROM u x JOIN u y ON bit_count(xor(x.a, y.a)) <= 3 GROUP BY x.a)
SELECT q.doc_id, d.n, edited_sha256, lower(lpad(to_hex(q.a), 15, '0')) AS fingerprint, lower(lpad(to_hex(b), 15, '0')) AS edited_fingerprint,
    greatest(30 - bit_count(xor(q.a, b)), 0) / 30.0::DOUBLE AS near_edited, greatest(30 - bit_count(xor(q.a, c)), 0) / 30.0::DOUBLE AS near_next, n_near
FROM q JOIN d ON d.doc_id = q.doc_id JOIN m ON m.a = q.a""".replace("d.n, edited", "d.n AS n_chars, edited"))
def simhash_(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_near_counts(simhash.edited(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_chars", "edited_sha256", simhash.written(F.col("fingerprint")).alias("fingerprint"),
                        simhash.written(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
