"""Personal data by patterns and bootstrapped contexts, DataFrame functions only.

Base entities (email, ip, card, phone) are found by regular expressions over the
whole text and checked (parts of an address, Luhn sum, digits). They are the
seeds, and so are long runs of hexadecimal digits, letters and figures mixed
(keys and tokens; a seed by itself is no span). What stands to their left is a
lexical pattern, in two widths: the last two words, and the last three tokens
where a token is a word, a number or one sign, if a sign is among them.
Identifier-like tokens that are no base entity are candidates, under the same
patterns. On the graph of patterns and distinct instances rounds score patterns
by the share of their instances that are known and candidates by the patterns
that hold them, until the accepted patterns are the same as after an earlier
round; patterns with enough support and confidence discover candidates as ``id``
spans.

Positions are read off the text cut at its matches, so the regular expressions
run once per kind and the work stays in the row. All expressions are linear in
the text: quantifiers are possessive and a match starts only where its run of
characters starts or where the last match ended.

Defined cases: null and empty texts have no spans; rows that repeat an id and
text give equal rows; rows without an id are searched like others; overlapping
entities of different kinds are all reported, redaction merges them; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .tables import drop_table

KINDS = ["email", "ip", "card", "phone", "id"]
#: fixed values: the expressions of the kinds, in linear form
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # identifier-like: one run of letters, digits and joiners with four digits or more
    "id": r"(?<![A-Za-z0-9_.@+-])[A-Za-z_.@+-]*+(?:[0-9][A-Za-z_.@+-]*+){4}[A-Za-z0-9_.@+-]*+",
}
OPEN, SHUT, OTHER = "\u0001", "\u0002", "\u0003"
BLOCK, PAGE = 64, 1024
CONTEXT = 64          # characters before an entity that are looked at
SEED = r"^(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+$"
SUPPORT = 3           # known instances that an accepted pattern has, at least
CONFIDENCE = 0.7


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        digits = F.translate(m, " -", "")
        n = F.length(digits)

        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, n - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0
        return F.when(n.between(14, 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, r"[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each number of a non-empty array the merged numbers before it (0 for
    the first), by blocks, so that long arrays are not merged from their start."""
    zero, block = F.lit(0), lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
    whole = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(block(v, b), zero, merge))
    first = lambda t: F.transform(t, lambda _, b: F.aggregate(F.slice(t, F.lit(1), b), zero, merge))

    def each(v: Column, base: Column) -> Column:
        start = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(v, lambda _, i: merge(F.get(base, start(i)), F.aggregate(F.slice(v, start(i) * BLOCK + 1, i % BLOCK), zero, merge)))

    return _let(values, lambda v: _let(_let(whole(v), first), lambda base: each(v, base)))


def _cut(kind: str, text: Column) -> Column:
    """The text cut at its matches: pieces at odd places are matches."""
    return F.split(F.regexp_replace(text, PATTERNS[kind], f"{OPEN}$0{SHUT}"), f"[{OPEN}{SHUT}]", -1)


def _matches(kind: str, text: Column) -> Column:
    """Array of (start, end, value, before) of the valid matches; ``before`` is
    the end of the text between this match and the one before it."""
    def told(cut: Column) -> Column:
        at = _before(F.transform(cut, F.length), lambda x, y: x + y)
        item = lambda piece, i, at_: F.when((i % 2 == 1) & _valid(kind, piece), F.struct(
            F.get(at_, i).alias("start"), (F.get(at_, i) + F.length(piece)).alias("end"), piece.alias("value"),
            F.right(F.get(cut, i - 1), F.lit(CONTEXT)).alias("before")))
        return F.filter(_let(at, lambda at_: F.transform(cut, lambda piece, i: item(piece, i, at_))), F.isnotnull)

    return _let(_cut(kind, text), told)


def _masked(kind: str, text: Column) -> Column:
    """The text with its valid matches blotted out, length unchanged."""
    blot = lambda piece, i: F.when((i % 2 == 1) & _valid(kind, piece), F.repeat(F.lit(OTHER), F.length(piece))).otherwise(piece)
    return F.array_join(F.transform(_cut(kind, text), blot), "")


def _context(before: Column) -> Column:
    """The two words to the left, lower case, digits as 0; empty if fewer."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.lower(before), r"(\S++\s++\S++\s*+)$", 1), r"[0-9]", "0"), r"\s+", " ")


def _signs(before: Column) -> Column:
    """The last three tokens with a sign among them, marked apart from word
    contexts; empty if there is no sign or fewer tokens."""
    last = F.regexp_extract(F.lower(before), r"(?:(?:\p{L}++|[0-9]++|[^\s\p{L}0-9])\s*+){3}$", 0)
    plain = F.regexp_replace(F.regexp_replace(last, r"[0-9]++", "0"), r"\s++", "")
    return F.when(last.rlike(r"[^\s\p{L}0-9]"), F.concat(F.lit("~"), plain)).otherwise("")


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, key (hash of the text), ``base`` and ``candidates``: arrays of
    (kind, start, end, value, context, signs)."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + SHUT, OTHER * 2)
    t = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), clean.alias("t"))
    digits = F.col("t").rlike("[0-9]")
    if_any = {"email": F.contains("t", F.lit("@")), "ip": digits, "card": digits, "phone": F.contains("t", F.lit("+")), "id": digits}
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    # identifiers are looked for in what the base entities leave
    rest = F.col("t")
    for k in KINDS[:-1]:
        rest = F.when(if_any[k], _masked(k, rest)).otherwise(rest)
    t = t.select("id", "key", *[F.when(if_any[k], _matches(k, rest if k == "id" else F.col("t"))).otherwise(none).alias(f"_{k}") for k in KINDS])

    def told(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"], x["end"], x["value"], _context(x["before"]).alias("context"), _signs(x["before"]).alias("signs")))

    return t.select("id", "key", F.concat(*[told(k) for k in KINDS[:-1]]).alias("base"), told("id").alias("candidates"))


def bootstrap(found: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Contexts accepted by the pattern-instance graph: ``context``, ``score``.
    Without ``rounds`` until the accepted ones repeat."""
    def edges(column: str, known: Column) -> DataFrame:
        held = found.select(F.explode(column).alias("e")).select("e.value", known.alias("known"), F.explode(F.array_distinct(F.array("e.context", "e.signs"))).alias("context"))
        return held.select("context", F.lower("value").alias("value"), "known")

    pairs = edges("base", F.lit(True)).unionByName(edges("candidates", F.col("e.value").rlike(SEED))).groupBy("context", "value").agg(F.max("known").alias("known"))
    pairs = materialize(pairs, "pairs")
    # a context of fewer instances can never gain support; any other may, by what the rounds discover
    wide = pairs.where("context <> ''").groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("context")
    # an instance is known wherever it stands once it is a base entity anywhere
    known = pairs.where("known").select("value").distinct().withColumn("known", F.lit(True))
    graph = pairs.select("context", "value").join(wide, "context", "left_semi").join(known, "value", "left")
    graph = materialize(graph.select("context", "value", F.coalesce("known", F.lit(False)).alias("known")), "graph")
    drop_table(pairs)
    belief = graph.select("value", F.when(F.col("known"), 1.0).otherwise(0.0).alias("belief")).groupBy("value").agg(F.max("belief").alias("belief"))
    accepted, seen = None, set()
    while rounds is None or len(seen) < rounds:
        held = graph.select("context", "value").join(belief, "value")
        scored = held.groupBy("context").agg((F.sum("belief") / (F.count(F.lit(1)) + 0.5)).alias("score"), F.count_if(F.col("belief") >= 0.5).alias("n"))
        accepted = materialize(scored.where((F.col("n") >= support) & (F.col("score") >= confidence)).select("context", "score"), "patterns")
        mark = tuple(accepted.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("context"))).first())
        if rounds is None and mark in seen:
            break
        seen.add(mark if rounds is None else len(seen))
        # an instance is doubted by every pattern that holds it
        miss = graph.join(accepted, "context", "left").groupBy("value").agg(
            F.max("known").alias("known"), F.sum(F.log(1 - F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))).alias("miss"))
        belief = miss.select("value", F.when(F.col("known"), 1.0).otherwise(1 - F.exp("miss")).alias("belief"))
    drop_table(graph)
    return accepted


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``key`` (hash of the text), ``spans``: array of
    (start, kind, end) in order, ``kind`` as a place in ``KINDS``."""
    found = materialize(entities(docs, doc_id, text), "entities")
    patterns = bootstrap(found)
    new = (found.where(F.size("candidates") > 0).select("id", "key", F.explode("candidates").alias("c"))
           .select("id", "key", "c.start", "c.kind", "c.end", F.explode(F.array("c.context", "c.signs")).alias("context")).join(patterns, "context", "left_semi"))
    seen = new.groupBy("id", "key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("new")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "new")
    base = F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"]))
    all_ = F.array_sort(F.concat(base, F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return found.join(seen, found["id"].eqNullSafe(seen["_id"]) & (found["key"] == seen["_key"]), "left").select(F.col("id").alias(doc_id), "key", all_.alias("spans"))


def written(spans_: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by the name of its first kind in
    brackets; spans that overlap are replaced as one."""
    columns = docs.columns
    found = spans(docs, doc_id, text).where(F.size("spans") > 0).dropDuplicates([doc_id, "key"])
    ends = F.transform("spans", lambda s: s["end"])
    # a span that starts before an earlier one ends is part of what that one began
    found = found.select(F.col(doc_id).alias("_id"), F.col("key").alias("_key"), F.array_max(ends).alias("_end"), F.filter(
        F.arrays_zip(F.col("spans").alias("s"), _before(ends, lambda x, y: F.greatest(x, y)).alias("after")), lambda z: z["s"]["start"] >= z["after"]).alias("_heads"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # all columns travel in one, so that names of theirs cannot clash with those used here
    t = docs.select(F.struct(*[docs[c] for c in columns]).alias("_doc"), docs[doc_id].alias("_doc_id"), docs[text].alias("_text"), F.xxhash64(docs[text]).alias("_text_key"))
    t = t.join(found, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")

    def between(pages: Column, a: Column, b: Column) -> Column:
        page = F.floor(a / PAGE).cast("int")
        near = F.array_join(F.slice(pages, page + 1, F.floor(b / PAGE).cast("int") - page + 1), "")
        return F.substring(near, a - page * PAGE + 1, b - a)

    # pages keep the cost of a cut independent of its place in the text
    pages = F.regexp_extract_all("_text", F.lit("(?s).{1,%d}" % PAGE), F.lit(0))
    new = _let(pages, lambda p: F.concat(
        F.array_join(F.transform("_heads", lambda z: F.concat(between(p, z["after"], z["s"]["start"]), F.get(names, z["s"]["kind"]))), ""),
        between(p, F.col("_end"), F.length("_text"))))
    new = F.when(F.col("_heads").isNull(), F.col("_text")).otherwise(new)
    out = t.select(*[new.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in columns])
    if n_chars in columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out
