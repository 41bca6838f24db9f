"""SimHash fingerprints and the search for near ones, DataFrame functions only.

The terms of a text are its pairs of consecutive words (its single word, if it
has one); a term weighs its length in code points, at most 15, once for each
occurrence. 60 bits of a term's hash vote with that weight for or against each
bit of the fingerprint; ties and texts without words give 0.

Votes are added in packed sums: four 15-bit counters share a number, so a term
costs 15 additions in generated code, and a chunk of 2048 terms cannot overflow.

Near fingerprints are looked up in permuted block tables: the 60 bits are cut
into blocks; fingerprints that differ in at most ``radius`` bits agree in all
but ``radius`` blocks, so each choice of the other blocks is one table and equal
blocks are its key. Copies collapse to one fingerprint before, and a pair counts
only in the first table that shows it.

Defined cases: null texts are empty; repeated ids are ordered by text; rows
without an id have a fingerprint but no place in the order, so their edited text
and likenesses are null; extra columns are ignored; an empty table gives an
empty result. With one document the next one is itself.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BITS, FIELD, HEAVIEST, CHUNK = 60, 15, 15, 2048
ONES = sum(1 << FIELD * j for j in range(BITS // FIELD))
SPACE = " \t\n\u000b\f\r"
ROWS, STRETCHES = 50, 1 << 16       # documents of a stretch of the order, and most stretches
RADIUS, BLOCKS = 3, 6               # of the search: 20 tables with keys of 30 bits


def _votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fingerprint`` (long) of the rows of ``texts`` (keys, _text);
    the keys tell rows apart. Needs no exchange where one key is dealt already."""
    words = texts.select(*keys, F.split(F.btrim("_text", F.lit(SPACE)), r"[ \t\n\x0B\f\r]+", -1).alias("_w"))
    last = F.greatest(F.size("_w") - 2, F.lit(0))
    terms = words.select(*keys, "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    term = F.concat_ws(" ", F.get("_w", F.col("_i")), F.get("_w", F.col("_i") + 1))
    terms = terms.select(*keys, F.floor(F.col("_i") / CHUNK).alias("_chunk"), term.alias("_term"))
    weight = F.least(F.length("_term"), F.lit(HEAVIEST)).cast("long")
    hashed = terms.select(*keys, "_chunk", weight.alias("_n"), F.conv(F.substring(F.md5("_term"), 1, BITS // 4), 16, 10).cast("long").alias("_h"))
    packed = hashed.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_n"), *[
        F.sum(F.shiftright("_h", i).bitwiseAND(F.lit(ONES)) * F.col("_n")).alias(f"_s{i}") for i in range(FIELD)])
    count = lambda i, j: F.shiftright(f"_s{i}", FIELD * j).bitwiseAND(F.lit((1 << FIELD) - 1))
    places = [(i, j) for j in range(BITS // FIELD) for i in range(FIELD)]
    added = packed.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(count(i, j)).alias(f"_c{i + FIELD * j}") for i, j in places])
    bit = lambda b: F.when(2 * F.col(f"_c{b}") > F.col("_n"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
    value = bit(0)
    for b in range(1, BITS):
        value = value.bitwiseOR(bit(b))
    return added.select(*keys, value.alias("fingerprint"))


def written(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 where they agree no better than by chance."""
    return F.greatest(BITS // 2 - F.bit_count(a.bitwiseXOR(b)), F.lit(0)) / F.lit(BITS / 2)


def _place(value: Column, borders: list[int]) -> Column:
    """How many of the ascending ``borders`` are at most ``value``, by bisection."""
    array = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    step = lambda at, s: F.when((at + s <= len(borders)) & (F.get(array, at + s - 1) <= value), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def stretches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text, ``_blk``, ``_own``: documents in consecutive stretches of their
    order. The first document of the next stretch (of the first one, for the
    last) follows its rows once more, not ``_own``. Only ids are read for the
    borders: quantiles, then the smallest id of each stretch."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some = rows.where("id is not null")
    n = some.count()
    blocks = max(1, min(STRETCHES, n // ROWS))
    borders = some.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    first = some.groupBy(_place(F.col("id"), sorted(set(borders))).alias("b") if borders else F.lit(0).alias("b")).agg(F.min("id").alias("id")).collect()
    first = sorted(r["id"] for r in first)
    loose = F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(1024))).cast("int").alias("blk"), F.lit(True).alias("own"))
    if not first:
        return rows.select("id", "text", loose["blk"].alias("_blk"), F.lit(True).alias("_own"))
    at = rows.withColumn("_at", _place(F.col("id"), first))
    before = F.when(F.col("_at") == 1, len(first)).otherwise(F.col("_at") - 1)
    starts = F.get(F.split(F.lit(",".join(map(str, first))), ",").cast("array<bigint>"), F.col("_at") - 1) == F.col("id")
    own = F.struct(F.col("_at").alias("blk"), F.lit(True).alias("own"))
    places = F.when(F.col("id").isNull(), F.array(loose)).when(starts, F.array(own, F.struct(before.alias("blk"), F.lit(False).alias("own")))).otherwise(F.array(own))
    return at.select("id", "text", F.explode(places).alias("_p")).select("id", "text", F.col("_p.blk").alias("_blk"), F.col("_p.own").alias("_own"))


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents, of their edited texts (the last quarter of
    the code points replaced by the start of the next document), and likenesses.

    One exchange of the texts: everything else follows inside the stretches."""
    order = Window.partitionBy("_blk").orderBy(F.desc("_own"), "id", "text")
    placed = stretches(docs, doc_id, text).select(
        "id", "text", "_blk", "_own", F.row_number().over(order).alias("_no"), F.lead("text").over(order).alias("_next"))
    n, follows = F.length("text"), F.col("_own") & F.col("id").isNotNull()
    quarter = F.floor(n / 4).cast("int")
    new = F.when(follows, F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter)))
    placed = placed.select("_blk", "_no", "id", "_own", n.cast("long").alias("n_chars"), "text", new.alias("_new"))
    placed = placed.select("_blk", "_no", "id", "_own", "n_chars", F.sha2("_new", 256).alias("edited_sha256"), F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("_new").alias("t"))), lambda x: x["t"].isNotNull())).alias("_v"))
    keys = ["_blk", "_no", "id", "_own", "n_chars", "edited_sha256"]
    votes = _votes(placed.select(*keys, F.col("_v.kind").alias("_kind"), F.col("_v.t").alias("_text")), [*keys, "_kind"])
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("fingerprint")))
    both = votes.groupBy(*keys).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(Window.partitionBy("_blk").orderBy("_no"))
    out = both.withColumn("_following", F.when(F.col("id").isNotNull(), following)).where("_own")
    return out.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) of every row."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return _votes(rows, ["_row", "_id"]).select(F.col("_id").alias(doc_id), "fingerprint")


def near_pairs(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs a < b of the distinct ``fingerprint`` values that differ in at most
    ``radius`` bits: columns a, b, distance. ``blocks`` (more than the radius, a
    divisor of 60) sets the number of tables, blocks over radius, and the length of
    their keys."""
    if not radius < blocks or BITS % blocks:
        raise ValueError("blocks must divide 60 and exceed the radius")
    wide = BITS // blocks
    block = lambda i: ((1 << wide) - 1) << i * wide
    masks = [sum(map(block, held)) for held in itertools.combinations(range(blocks), blocks - radius)]
    fp = F.col("fingerprint")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
    tables = classes.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.t", "key.k")
    a, b = tables.withColumnRenamed("fingerprint", "a"), tables.withColumnRenamed("fingerprint", "b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    shown = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    met = a.alias("x").join(b.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("a") < F.col("b"))
                            & (F.bit_count(apart) <= radius) & (shown == F.col("x.t")))
    return met.select("a", "b", F.bit_count(apart).alias("distance"))


def with_near_counts(rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Add ``n_near``: other rows whose fingerprint lies within the radius."""
    rows = materialize(rows, "fingerprints")
    classes = materialize(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    pairs = near_pairs(classes, radius, blocks)
    ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("fingerprint"), F.col("e.b").alias("_to"))
    met = ends.join(classes.select(F.col("fingerprint").alias("_to"), F.col("n").alias("_n")), "_to").groupBy("fingerprint").agg(F.sum("_n").alias("_more"))
    # stored, so that the join with the rows can split a fingerprint of very many copies
    near = materialize(classes.join(met, "fingerprint", "left").select("fingerprint", (F.col("n") - 1 + F.coalesce("_more", F.lit(0))).alias("n_near")), "near-counts")
    return rows.join(near, "fingerprint")
