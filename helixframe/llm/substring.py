"""Repeated passages by anchors at difference-cover positions.

A difference cover D of the residues modulo m has, for any two offsets i and j,
a shift s < m with (i + s) mod m and (j + s) mod m both in D. So two equal
windows of ``length`` words share an anchor: ``length - m + 1`` words that start
at a cover position of both documents. Only anchors are hashed for all texts
(4 of 13 positions for 20 words). Those that occur once end there. Around the
others the whole windows are hashed and grouped: a window is a repeat if its
words also start in a document of smaller id, or earlier in its own. The words
of such windows are removed.

Documents with the same words as an earlier one are settled without anchors: all
their windows start earlier, too. Within a document only the first of equal
windows is grouped; groups need the smallest document id only, so frequent
passages combine before the shuffle.

Defined cases: null and empty texts have no words; texts shorter than a window
stay; ids should be unique (rows that repeat an id with equal words give equal
rows, the first of them is not told apart), rows without an id are left whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import words as W
from .tables import drop_table

#: difference covers with few residues, by period (fixed values)
COVERS = {3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}


def period_for(length: int) -> int:
    """Largest period whose anchors still have a third of the window's words."""
    fit = [m for m in COVERS if length - m + 1 >= max(length // 3, 1)]
    if not fit:
        raise ValueError("windows need at least 3 words")
    return max(fit)


def _in_cover(position: np.ndarray, period: int) -> np.ndarray:
    cover = np.zeros(period, dtype=bool)
    cover[COVERS[period]] = True
    return cover[position % period]


def _first_of_equal(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of equal values of a document, for all and as a mask."""
    order = np.lexsort((np.arange(len(doc)), value, doc))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])
    first = np.zeros(len(doc), dtype=bool)
    first[order[new]] = True
    return order, first


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20) -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space) and ``kept_sha256`` of it."""
    period = period_for(length)
    anchor = length - period + 1
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.split(piece.column(1))
            data, at = w.joined()
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(w.count().astype(np.int64)),
                 pa.array([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "n", "digest"])

    sums = materialize(slim.mapInArrow(digests, "id long, n long, digest binary"), "digests")
    firsts = sums.where(F.col("n") >= length).groupBy("digest").agg(F.min("id").alias("head"))
    copies = materialize(sums.where(F.col("n") >= length).join(firsts, "digest").where("id > head").select("id").distinct(), "copies")
    alone = slim.where("id is not null").join(copies, "id", "left_anti")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.split(piece.column(1))
            at = np.flatnonzero(W.whole(w, anchor) & _in_cover(w.position(), period))
            value, doc = W.windows(W.hashes(w), w, anchor)[at].view(np.int64), w.doc[at]
            _, first = _first_of_equal(doc, value)
            # an anchor that its own document repeats is known to be repeated
            again = np.isin(value, value[~first])
            ids = pa.array(np.asarray(piece.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)[doc[first]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(value[first]), pa.array(again[first])], ["id", "h", "again"])

    marks = materialize(alone.mapInArrow(anchors, "id long, h long, again boolean"), "anchors")
    repeated = marks.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.max("again").alias("again")).where("f > 1 or again").select("h")
    around = materialize(marks.join(repeated, "h", "left_semi").groupBy("id").agg(F.collect_list("h").alias("hs")), "around")
    drop_table(marks)

    def candidate(w: W.Words, h: np.ndarray, known: pa.Array) -> np.ndarray:
        """Windows that hold a repeated anchor at a cover position."""
        at = np.flatnonzero(W.whole(w, anchor) & _in_cover(w.position(), period))
        value = W.windows(h, w, anchor)[at].view(np.int64)
        offsets, flat = known.offsets.to_numpy(), known.values.to_numpy()
        owner = np.repeat(np.arange(len(known)), np.diff(offsets)).astype(np.uint64)
        key = W.mix(value.view(np.uint64) + w.doc[at].astype(np.uint64) * np.uint64(W.BASE))
        good = at[np.isin(key, W.mix(flat[offsets[0]:offsets[-1]].view(np.uint64) + owner * np.uint64(W.BASE)))]
        hit = np.zeros(len(w.start) + 1, dtype=np.int64)
        np.add.at(hit, good + 1, 1)
        hit = np.cumsum(hit)
        i = np.flatnonzero(W.whole(w, length))
        return i[hit[i + period] > hit[i]]

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.split(piece.column(1))
            h = W.hashes(w)
            at = candidate(w, h, piece.column(2))
            value, doc = W.windows(h, w, length)[at].view(np.int64), w.doc[at]
            _, first = _first_of_equal(doc, value)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc[first])), pa.array(value[first])], ["id", "h"])

    windows = materialize(alone.join(around, "id").mapInArrow(full, "id long, h long"), "windows")
    owners = windows.groupBy("h").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("f")).where("f > 1")
    later = windows.join(owners, "h").where("id > owner").groupBy("id").agg(F.collect_list("h").alias("hs"))
    inside = around.select("id", F.lit(True).alias("inside"))
    marked = (slim.join(copies.withColumn("copy", F.lit(True)), "id", "left").join(later, "id", "left").join(inside, "id", "left")
              .select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"),
                      F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("hs", F.array().cast("array<long>")).alias("hs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.split(piece.column(1))
            i = np.flatnonzero(W.whole(w, length))
            value, doc = W.windows(W.hashes(w), w, length)[i], w.doc[i]
            known = piece.column(4)
            offsets, flat = known.offsets.to_numpy(), known.values.to_numpy()
            owner = np.repeat(np.arange(len(known)), np.diff(offsets)).astype(np.uint64)
            _, first = _first_of_equal(doc, value)
            inside = piece.column(3).to_numpy(zero_copy_only=False)[doc]
            key = W.mix(value + doc.astype(np.uint64) * np.uint64(W.BASE))
            earlier = np.isin(key, W.mix(flat[offsets[0]:offsets[-1]].view(np.uint64) + owner * np.uint64(W.BASE)))
            gone = piece.column(2).to_numpy(zero_copy_only=False)[doc] | earlier | (inside & ~first)
            edge = np.zeros(len(w.start) + 1, dtype=np.int64)
            np.add.at(edge, i[gone], 1)
            np.add.at(edge, i[gone] + length, -1)
            keep = np.cumsum(edge[:-1]) == 0
            data, at = w.joined(keep)
            n = w.count()
            texts = W.arrow_binary(data, at)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n.astype(np.int64)), pa.array((n - np.bincount(w.doc[keep], minlength=len(piece))).astype(np.int64)),
                 texts.cast(pa.string()), pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])])],
                ["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    out = marked.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", doc_id)
