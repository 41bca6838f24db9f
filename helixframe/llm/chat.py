"""Quotation linking of chat messages with DataFrame functions only.

A line's quote level is the number of `>` before its text. Consecutive quoted
lines of one level are a passage. Texts are normalised across line breaks (lower
case, single spaces). A quoted line is looked up among the unquoted text of
earlier messages of its conversation by hashes, the latest message wins: whole,
as a line or sentence; or else its passage, as a line or sentence; or else in
runs of ``RUN`` words that cover the line (a shorter line together with its
neighbours in the passage), all of which must be found. So quotations that were
wrapped anew or hold a part of a line are found; of fewer than ``RUN`` words
only whole lines and sentences are. A message replies to the message that most characters of its outermost matched
level come from, or else to the message before it. The first reply to a message
continues its branch, later ones open branches of their own, so a conversation
read by (branch, turn) holds every message after the one it answers, and no
quoted line.

Defined cases: rows that repeat conversation and turn are one message (smallest
role, distinct texts joined in text order); rows without conversation or turn are
messages without links; null and empty texts give an empty body; quotes that
match nothing are removed all the same; an empty table gives an empty result.
A conversation that holds most rows is ordered in blocks, not in one task; the
lookup groups by hash, and only hashes that somebody quotes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import skew
from ..session import is_empty, materialize

MARK = r"^(?:\s*>)+"
RUN = 5               # words


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), r"[^>]", ""))


def normal(line: Column) -> Column:
    """Text of a line without its marks, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARK, "")), r"\s+", " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run(words: Column, start: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, start + 1, F.lit(RUN)), " "))


def said_hashes(body: Column) -> Column:
    """Hashes of the lines, sentences and runs of words of an unquoted text."""
    flat = normal(body)
    parts = F.concat(F.transform(F.split(body, "\n"), normal), F.split(flat, r"(?<=[.!?]) "))
    runs = _let(F.split(flat, " "), lambda w: F.when(F.size(w) >= RUN, F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: _run(w, i)))
                .otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.concat(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x)), runs))


def asked_hashes(told: DataFrame) -> DataFrame:
    """One row per hash that a quoted line asks for: conv, turn, level, ``place``
    of the line, ``way`` (the first whose hashes are all found counts), ``h`` and
    ``n`` (characters of the line that it stands for)."""
    q = told.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*")
    upto = Window.partitionBy("conv", "turn").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("passage", F.count_if("head").over(upto)).where("line <> ''").withColumn("m", F.size(F.split("line", " ")))
    before = Window.partitionBy("conv", "turn", "passage").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("a", F.coalesce(F.sum("m").over(before), F.lit(0)).cast("int"))
    q = q.groupBy("conv", "turn", "level", "passage").agg(F.array_sort(F.collect_list(F.struct("place", "line", "a", "m"))).alias("lines"))
    whole = F.array_join(F.transform("lines", lambda x: x["line"]), " ")

    def one(place: Column, way: int, h: Column, n: Column) -> Column:
        return F.struct(place.alias("place"), F.lit(way).alias("way"), h.alias("h"), n.cast("int").alias("n"))

    def asked(x: Column, w: Column, whole_: Column) -> Column:
        place, a, b, n = x["place"], x["a"], x["a"] + x["m"], F.length(x["line"])
        same = F.array(one(place, 0, F.xxhash64(x["line"]), n), one(place, 1, whole_, n))
        cover = F.transform(F.sequence(F.lit(0), F.floor((x["m"] - 1) / RUN).cast("int")), lambda k: one(
            place, 2, _run(w, F.least(a + k * RUN, b - RUN)), F.length(F.array_join(F.slice(w, a + k * RUN + 1, F.least(F.lit(RUN), x["m"] - k * RUN)), " "))))
        around = F.array(one(place, 2, _run(w, F.greatest(b - RUN, F.lit(0))), n), one(place, 3, _run(w, F.least(a, F.size(w) - RUN)), n))
        return F.when(x["m"] >= RUN, F.concat(same, cover)).when(F.size(w) >= RUN, F.concat(same, around)).otherwise(same)

    units = _let(whole, lambda t: _let(F.xxhash64(t), lambda h: _let(F.split(t, " "), lambda w: F.flatten(F.transform("lines", lambda x: asked(x, w, h))))))
    return q.select("conv", "turn", "level", F.explode(units).alias("u")).select("conv", "turn", "level", "u.*")


def quotation_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, ``body`` (text without
    quoted lines), ``n_quoted`` (quoted lines), ``n_linked`` (those found in an
    earlier message), ``max_level``, ``reply_to`` and ``branch`` (turns)."""
    m = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    whole = m.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(
        F.min("role").alias("role"), F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    loose = m.where("conv is null or turn is null")

    def parsed(t: DataFrame) -> DataFrame:
        lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("place"), level(x).alias("level"), x.alias("raw"), normal(x).alias("line")))
        t = t.withColumn("lines", lines)
        own = F.filter("lines", lambda x: x["level"] == 0)
        body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), r"^\s+|\s+$", "")
        # a passage begins where the level changes
        head = lambda x: F.coalesce(F.get("lines", x["place"] - 1)["level"] != x["level"], F.lit(True))
        quoted = F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct(x["place"], x["level"], x["line"], head(x).alias("head")))
        return t.select("conv", "turn", "role", body.alias("body"), quoted.alias("quoted"))

    shown = F.filter("quoted", lambda x: x["line"] != "")
    n_quoted, max_level = F.size(shown).alias("n_quoted"), F.coalesce(F.array_max(F.transform(shown, lambda x: x["level"])), F.lit(0)).alias("max_level")
    told = skew.ordered_blocks(parsed(whole), ["conv"], ["turn"], "messages")
    quotes = materialize(asked_hashes(told), "quotes")
    known = told.select("conv", "turn", F.explode(said_hashes(F.col("body"))).alias("h")).join(quotes.select("conv", "h").distinct(), ["conv", "h"], "left_semi")
    # the latest earlier message with that hash: one ordered pass, no pairs
    both = quotes.unionByName(known, allowMissingColumns=True)
    earlier = Window.partitionBy("conv", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("origin", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier)).where("level is not null")
    ways = found.groupBy("conv", "turn", "level", "place", "way").agg(
        F.count(F.lit(1)).alias("asked"), F.count("origin").alias("got"), F.collect_list(F.struct("origin", "n")).alias("from")).where("asked = got")
    lines = ways.groupBy("conv", "turn", "level", "place").agg(F.min_by("from", "way").alias("from"))
    votes = lines.select("conv", "turn", "level", F.posexplode("from").alias("i", "v")).groupBy("conv", "turn", "level", F.col("v.origin").alias("origin")).agg(
        F.sum("v.n").alias("n"), F.count_if(F.col("i") == 0).alias("lines"))
    chosen = votes.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin"))).alias("quoted_turn"),
                                               F.sum("lines").alias("n_linked"))
    said = skew.lagged(told, ["conv"], ["turn"], {"turn": "before"}).drop("_blk")
    said = materialize(said.join(chosen, ["conv", "turn"], "left").select(
        "conv", "turn", "role", "body", n_quoted, F.coalesce("n_linked", F.lit(0)).alias("n_linked"), max_level,
        F.coalesce("quoted_turn", "before").alias("reply_to")), "replies")
    first = said.where("reply_to is not null").groupBy("conv", "reply_to").agg(F.min("turn").alias("first"))
    up = said.select("conv", "turn", "reply_to").join(first, ["conv", "reply_to"], "left").select(
        "conv", "turn", F.when(F.col("turn") == F.col("first"), F.col("reply_to")).alias("up"))
    heads = _heads(up)
    linked = said.join(heads, ["conv", "turn"])
    rest = parsed(loose).select("conv", "turn", "role", "body", n_quoted, F.lit(0).cast("long").alias("n_linked"), max_level,
                                F.lit(None).cast("long").alias("reply_to"), F.lit(None).cast("long").alias("branch"))
    out = linked.unionByName(rest)
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "body",
                      F.col("n_quoted").cast("long").alias("n_quoted"), F.col("n_linked").cast("long").alias("n_linked"),
                      F.col("max_level").cast("long").alias("max_level"), "reply_to", "branch")


def _heads(up: DataFrame) -> DataFrame:
    """(conv, turn, branch): the end of the ``up`` links of each message, by
    pointer doubling. Messages that reached their end leave; a round joins only
    those that still move."""
    now = materialize(up.select("conv", "turn", F.coalesce("up", "turn").alias("branch"), F.col("up").isNull().alias("done")), "branches")
    ended, moving = now.where("done"), now.where(~F.col("done"))
    while not is_empty(moving):
        step = ended.unionByName(moving).select("conv", F.col("turn").alias("branch"), F.col("branch").alias("next"), "done")
        now = materialize(moving.drop("done").join(step, ["conv", "branch"]).select("conv", "turn", F.col("next").alias("branch"), "done"), "branches")
        ended, moving = ended.unionByName(now.where("done")), now.where(~F.col("done"))
    return ended.select("conv", "turn", "branch")
