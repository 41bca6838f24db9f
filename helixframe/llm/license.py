"""License notices by diagonal voting.

All rolling word pairs of every text are hashed and joined with the positions of
the same pairs in the templates, a fixed table of a few hundred rows. A match of
text position p and template position t votes for the diagonal p - t, where the
template would start. A phrase stands wherever all its pairs vote for one
diagonal. For longer notices neighbouring diagonals are merged in two staggered
grids of bands, so inserted or missing words do not break a span while they shift
it by at most half a band; spans with enough different pairs, which is never more
than verification asks for, are verified on the words by their longest common
subsequence.

Defined cases: null and empty texts have no words and no labels; rows that
repeat an id give one row with what stands in any of them (places at the same
word count once, n_words is the largest); rows without an id are one such group;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import words as W

#: fixed values: phrases and their labels; every place of one counts
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: fixed values: usual notices and their labels
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
BAND = 8              # words by which merged diagonals may differ, at most
VERIFIED = 0.75       # of a notice's words that must stand in order


def _templates() -> list[tuple[int, str, list[bytes], bool]]:
    both = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    return [(i, label, text.encode().split(), phrase) for i, (label, text, phrase) in enumerate(both)]


def _pairs(text: str) -> np.ndarray:
    w = W.split(pa.array([text]), W.PUNCTUATION, lower=True)
    return W.windows(W.hashes(w), w, 2)[W.whole(w, 2)].view(np.int64)


def common_share(words: list[bytes], template: list[bytes]) -> float:
    """Longest common subsequence over the template's length."""
    row = np.zeros(len(template) + 1, dtype=np.int64)
    for x in words:
        new = row.copy()
        for j, y in enumerate(template, 1):
            new[j] = row[j - 1] + 1 if x == y else max(row[j], new[j - 1])
        row = new
    return float(row[-1] / len(template))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents with id and ``n_words``; spans with id,
    ``label``, ``base`` (a phrase), ``start``, ``end`` (words) and ``score``."""
    spark = docs.sparkSession
    templates = _templates()
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.split(piece.column(1), W.PUNCTUATION, lower=True)
            at = np.flatnonzero(W.whole(w, 2))
            n = len(piece)
            doc = np.concatenate([np.arange(n), w.doc[at]])
            # the first n rows stand for the documents and carry their words
            where = np.concatenate([w.count(), w.position()[at]]).astype(np.int64)
            h = pa.array(np.concatenate([np.zeros(n, np.int64), W.windows(W.hashes(w), w, 2)[at].view(np.int64)]), mask=np.arange(n + len(at)) < n)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), pa.array(where), h], ["id", "at", "h"])

    rolled = slim.mapInArrow(grams, f"id {id_type}, at long, h long")
    rows = [(int(h), i, t) for i, _, words, _ in templates for t, h in enumerate(_pairs(b" ".join(words).decode()))]
    places = spark.createDataFrame(rows, "h long, template int, t int")
    met = materialize(rolled.join(F.broadcast(places), "h", "left").where("template is not null or h is null")
                      .select("id", "at", "template", "t"), "votes")
    documents = met.where("template is null").groupBy("id").agg(F.max("at").alias("n_words"))
    lengths = F.element_at(F.array(*[F.lit(len(t[2])) for t in templates]), F.col("template") + 1)
    votes = met.where("template is not null").withColumn("diagonal", F.col("at") - F.col("t"))
    n_phrases = len(PHRASES)
    bit = F.bit_or(F.expr("shiftleft(1L, t)"))
    base = (votes.where(F.col("template") < n_phrases).groupBy("id", "template", "diagonal").agg(F.bit_count(bit).alias("n"))
            .where(F.col("n") == lengths - 1)
            .select("id", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + lengths).alias("end"), F.lit(1.0).alias("score")))
    grids = F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("diagonal") + g * BAND // 2) / BAND).alias("band")) for g in (0, 1)])
    banded = votes.where(F.col("template") >= n_phrases).withColumn("g", F.explode(grids)).groupBy("id", "template", "g.grid", "g.band").agg(
        F.bit_count(bit).alias("n"), F.min("at").alias("start"), (F.max("at") + 2).alias("end"),
        F.greatest(F.min("diagonal"), F.lit(0)).alias("low"), (F.max("diagonal") + F.max(lengths)).alias("high"))
    # a changed word breaks two pairs, so a span that is verified keeps at least this many
    needed = F.greatest(lengths - 1 - 2 * F.floor((1 - VERIFIED) * lengths), F.lit(1))
    likely = banded.where(F.col("n") >= needed).select("id", "template", "start", "end", "low", "high").distinct()
    per_doc = likely.groupBy("id").agg(F.collect_list(F.struct("template", "start", "end", "low", "high")).alias("spans"))
    texts = slim.join(per_doc, slim["id"].eqNullSafe(per_doc["id"])).select(slim["id"], "text", "spans")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.split(piece.column(1), W.PUNCTUATION, lower=True)
            rows, found = [], []
            for i, spans in enumerate(piece.column(2).to_pylist()):
                for s in spans:
                    template = templates[s["template"]][2]
                    # words at the ends of the notice may stand beyond the pairs that were met
                    a, b = w.first[i] + s["low"], min(w.first[i] + s["high"], w.first[i + 1])
                    share = common_share([w.word(j) for j in range(a, b)], template)
                    if share >= VERIFIED:
                        rows.append(i)
                        found.append((s["template"], s["start"], s["end"], share))
            columns = list(zip(*found)) or [()] * 4
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             ["id", "template", "start", "end", "score"])

    noticed = texts.mapInArrow(verify, f"id {id_type}, template int, start long, end long, score double")
    label = F.element_at(F.array(*[F.lit(t[1]) for t in templates]), F.col("template") + 1)
    spans = base.unionByName(noticed).select("id", label.alias("label"), (F.col("template") < n_phrases).alias("base"), "start", "end", "score").distinct()
    return documents.withColumnRenamed("id", doc_id), materialize(spans, "spans").withColumnRenamed("id", doc_id)


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of phrases, labels, score."""
    documents, spans = scan(docs, doc_id, text)
    base = F.when(F.col("base"), F.col("start"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col(doc_id).alias("_id")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("score").alias("score"))
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return documents.join(found, documents[doc_id].eqNullSafe(found["_id"]), "left").select(
        doc_id, "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
