"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document retains its k smallest. For
two documents of Jaccard similarity s the k smallest hashes of their union each
lie in both with probability s, so at least ``least`` of them are retained by
both except with the probability ``loss(k, s, least)`` (about 1e-7 a pair with
the values below; documents with at most k shingles keep their whole set, for
which the bound is certain). Hence they also share one of the
``size - least + 1`` retained values that stand in the shortest inverted lists:
frequent values are never looked at where rarer ones suffice. Lists give pairs,
the sketch of the union estimates their similarity, and pairs that are not
clearly below the threshold are decided on their full sets.

Documents with equal sets are one class. A list first compares its members with
one of them that a hash picks, another one for each class of lists. Pairs that
the sketches leave possible join documents to crowds, links join them to
components. Inside a crowd only documents outside its largest component are
compared further, in tiles of packed sets: shared shingles of a pair of tiles are
counted by one matrix product, and a tile returns a spanning forest of its
links. A document that shares a list with a document of a larger crowd is compared
with that crowd as a guest, in the same tiles; pairs of a list between small crowds
are compared one by one. For both, 256 bits that the retained values set travel with
the lists: a bit that only one document has stands for a value of its own, which
bounds what two have in common. Pairs that cannot reach ``least`` are dropped in the
join of the lists, before they are rows. No group of copies is ever written out as
pairs. Texts that are not asked for are dropped where they are read.

Defined cases: null and empty texts have an empty set and link with nothing;
rows without an id stand alone (component null, kept); rows that repeat an id
are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import is_empty
from . import words as W
from .embed_dedup import forest
from .tables import components, drop_table, may_hold, stored, with_components

K = 48
LEAST = 21
HEADS = 4              # classes of lists with a head of their own
TILE = 500_000         # shingles of a tile of a crowd, about
TILE_ROWS = 1000       # documents of a tile, about
COLUMNS = 4096         # shingles that are counted at once
LARGE = 16             # documents from which a crowd takes guests
MARKS = ["m0", "m1", "m2", "m3"]      # 256 bits that the retained values set


def loss(k: int, similarity: float, least: int) -> float:
    """Chance that fewer than ``least`` of the union's k smallest hashes are
    common to two sets of the given similarity."""
    return sum(math.comb(k, i) * similarity ** i * (1 - similarity) ** (k - i) for i in range(least))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a piece of texts, sorted by (text, hash), and
    the n + 1 borders of each text. A text with fewer words is one shingle."""
    n = len(texts)
    w = W.split(texts, lower=True)
    h = W.hashes(w)
    many = W.whole(w, size)
    doc, value = w.doc[many], W.windows(h, w, size)[many]
    short = np.flatnonzero((w.count() > 0) & (w.count() < size))
    if len(short):
        own = []
        for i in short:
            acc = np.array([w.first[i + 1] - w.first[i]], dtype=np.uint64)
            for x in h[w.first[i]:w.first[i + 1]]:
                acc = W.mix(acc * np.uint64(W.BASE) + x)
            own.append(acc[0])
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(own, dtype=np.uint64)])
    value = value.view(np.int64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(n + 1))


def sketches(docs: DataFrame, doc_id: str, text: str, size: int, k: int) -> DataFrame:
    """id, n (set size), digest (of the whole set), sketch (k smallest hashes), marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, "text"):
            value, at = shingles(piece.column(1), size)
            count = np.diff(at)
            taken = np.minimum(count, k)
            first = np.concatenate([[0], np.cumsum(taken)])
            idx = np.repeat(at[:-1], taken) + np.arange(first[-1]) - np.repeat(first[:-1], taken)
            bit, word = np.left_shift(np.uint64(1), value[idx].view(np.uint64) & np.uint64(63)), value[idx] >> 6 & 3
            marks = [np.where(taken > 0, np.bitwise_or.reduceat(np.append(np.where(word == w, bit, np.uint64(0)), np.uint64(0)), first[:-1]), np.uint64(0)) for w in range(len(MARKS))]
            digest = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(count.astype(np.int64)), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value[idx])), *[pa.array(m.view(np.int64)) for m in marks]],
                ["id", "n", "digest", "sketch", *MARKS])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, digest binary, sketch array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def _rare(reps: DataFrame, least: int, percent: int) -> DataFrame:
    """(v, id, n) for the retained values in the shortest lists of a document,
    lists of one document left out."""
    postings = reps.select("id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    lists = postings.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = postings.join(lists, "v")
    need = F.least(F.lit(least), F.ceil(F.col("s") * percent / 100))
    # the s - size(common) values that nobody shares are the rarest of all
    room = F.col("s") - need + 1 - (F.col("s") - F.size("common"))
    return (shared.groupBy("id", "n", "s").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("common"))
            .where(room > 0).select("id", "n", F.explode(F.slice("common", F.lit(1), room.cast("int"))).alias("c"))
            .select(F.col("c.v").alias("v"), "id", "n"))


def _likely(pairs: DataFrame, reps: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """Pairs that belong to one crowd (a, b, possible): the union sketches have
    two thirds of ``least`` in common, or complete sets share two fifths of their
    union; ``possible`` tells whether they may be linked."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    inter, all_ = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    whole = (F.size("sa") < k) & (F.size("sb") < k)        # complete sets: exact
    near = F.when(whole, inter * 5 >= all_ * 2).otherwise(common * 3 >= 2 * least)
    return both.where(near).select("a", "b", F.when(whole, inter * 100 >= all_ * percent).otherwise(common >= least).alias("possible"))


def _may_link(k: int, least: int, percent: int) -> Column:
    """Whether the marks of documents x and y leave it possible that ``_likely``
    finds them possible. Each bit that only one has stands for a value of its own."""
    alone = lambda one, other: sum(F.bit_count(F.col(f"{one}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{other}.{m}")))) for m in MARKS)
    common = F.least(F.least("x.n", F.lit(k)) - alone("x", "y"), F.least("y.n", F.lit(k)) - alone("y", "x"))
    whole = (F.col("x.n") < k) & (F.col("y.n") < k)
    return F.when(whole, common * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))).otherwise(common >= least)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * |A and B| >= percent * |A or B| on their full sets."""
    # the ids grow with the documents, so they are never broadcast, only bits of them
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = stored(may_hold(docs, ids, "id").join(ids.hint("merge"), "id"), "texts")     # a semi join would move below the filter
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(iter([batch]), "ta"):
                va, at = shingles(piece.column(2), size)
                vb, bt = shingles(piece.column(3), size)
                ok = []
                for i in range(len(piece)):
                    x, y = va[at[i]:at[i + 1]], vb[bt[i]:bt[i + 1]]
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    edges = stored(both.mapInArrow(run, "a long, b long"), "links")
    drop_table(texts)
    drop_table(ids)
    return edges


def _stars(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's head with its other members."""
    turn = F.xxhash64("id", F.pmod("v", F.lit(HEADS)))
    heads = rare.groupBy("v").agg(F.min_by("id", turn).alias("head"), F.min_by("n", turn).alias("hn"))
    met = rare.join(heads, "v").where((F.col("id") != F.col("head")) & _near(F.col("n"), F.col("hn"), percent))
    return met.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def tile_links(x: tuple, y: tuple, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked documents of two tiles; a tile is (component of
    each document, borders of their sets, all shingles)."""
    (cx, ax, vx), (cy, ay, vy) = x, y
    nx, ny = np.diff(ax), np.diff(ay)
    shared = np.intersect1d(vx, vy)
    common = np.zeros((len(cx), len(cy)), dtype=np.float32)
    dx, dy = np.repeat(np.arange(len(cx)), nx), np.repeat(np.arange(len(cy)), ny)
    px, py = np.searchsorted(shared, vx), np.searchsorted(shared, vy)
    kx = np.append(shared, 0)[px] == vx
    ky = np.append(shared, 0)[py] == vy
    dx, px, dy, py = dx[kx], px[kx], dy[ky], py[ky]
    ox, oy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    dx, px, dy, py = dx[ox], px[ox], dy[oy], py[oy]
    for low in range(0, len(shared), COLUMNS):
        i, j = np.searchsorted(px, [low, low + COLUMNS])
        k, m = np.searchsorted(py, [low, low + COLUMNS])
        left = np.zeros((len(cx), COLUMNS), dtype=np.float32)
        right = np.zeros((len(cy), COLUMNS), dtype=np.float32)
        left[dx[i:j], px[i:j] - low] = 1
        right[dy[k:m], py[k:m] - low] = 1
        common += left @ right.T               # exact below 2^24
    both = nx[:, None] + ny[None, :] - common
    i, j = np.nonzero((common > 0) & (100 * common.astype(np.float64) >= percent * both.astype(np.float64)) & (cx[:, None] != cy[None, :]))
    return (i[i < j], j[i < j]) if same else (i, j)


def _crowd_links(nodes: DataFrame, guests: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of a crowd, and of guests (id, crowd) with the
    documents of a crowd: rows of ``nodes`` are id, n, crowd, component_id."""
    parts = nodes.groupBy("crowd", "component_id").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("crowd").agg(F.max_by("component_id", F.struct("c", "component_id")).alias("main"), F.count(F.lit(1)).alias("parts"))
    visited = guests.select("crowd").distinct().withColumn("visited", F.lit(True))
    main = main.join(visited, "crowd", "left").where("parts > 1 or visited").select("crowd", "main")
    # documents outside the largest component and guests, and those in it
    own = nodes.join(main, "crowd").withColumn("out", F.col("component_id") != F.col("main"))
    told = nodes.select("id", "n", "component_id").join(guests, "id").withColumn("out", F.lit(True))
    sides = stored(own.drop("main").unionByName(told), "sides")
    tiles = sides.groupBy("crowd", "out").agg(F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.count(F.lit(1)) / TILE_ROWS)).cast("int").alias("tiles"))
    sides = sides.join(tiles, ["crowd", "out"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    sides = sides.select("id", "crowd", "out", "tile", "component_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            v, at = shingles(piece.column(1), size)
            raw = W.arrow_binary(v.view(np.uint8), at * 8)
            yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in (0, 2, 3, 4, 5)], raw], ["id", "crowd", "out", "tile", "component_id", "set"])

    rows = may_hold(docs, sides, "id").join(sides.hint("merge"), "id").select("id", "text", "crowd", "out", "tile", "component_id").mapInArrow(
        packed, "id long, crowd long, out boolean, tile int, component_id long, set binary")

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("id")
        size_ = np.array([len(x) // 8 for x in t["set"]], dtype=np.int64)
        return pd.DataFrame({"crowd": t["crowd"].iloc[:1], "out": t["out"].iloc[:1], "tile": t["tile"].iloc[:1], "ids": [t["id"].to_numpy(np.int64).tobytes()],
                             "parts": [t["component_id"].to_numpy(np.int64).tobytes()], "sizes": [size_.tobytes()], "sets": [b"".join(t["set"])]})

    packs = stored(rows.groupBy("crowd", "out", "tile").applyInPandas(pack, "crowd long, out boolean, tile int, ids binary, parts binary, sizes binary, sets binary"), "tiles")
    first = tiles.where("out").select("crowd", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    other = tiles.select("crowd", F.col("out").alias("out2"), F.col("tiles").alias("tiles2"))
    todo = first.join(other, "crowd").withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1))).where("not out2 or tile2 >= tile")
    side = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("ids", "parts", "sizes", "sets")]
    work = (todo.join(packs.where("out").select("crowd", "tile", *side(1)), ["crowd", "tile"])
            .join(packs.select("crowd", F.col("out").alias("out2"), F.col("tile").alias("tile2"), *side(2)), ["crowd", "out2", "tile2"])
            .select((F.col("out2") & (F.col("tile") == F.col("tile2"))).alias("same"), "ids1", "parts1", "sizes1", "sets1", "ids2", "parts2", "sizes2", "sets2"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = lambda b: np.frombuffer(b, dtype=np.int64)
        borders = lambda b: np.concatenate([[0], np.cumsum(numbers(b))])
        for batch in batches:
            for r in batch.itertuples(index=False):
                i, j = tile_links((numbers(r.parts1), borders(r.sizes1), numbers(r.sets1)), (numbers(r.parts2), borders(r.sizes2), numbers(r.sets2)), percent, r.same)
                ids1, ids2 = numbers(r.ids1), numbers(r.ids2)
                shift = 0 if r.same else len(ids1)
                all_ids = ids1 if r.same else np.concatenate([ids1, ids2])
                root = forest(len(all_ids), i, j + shift)
                hung = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"a": all_ids[hung], "b": all_ids[root[hung]]})

    return stored(work.repartition(F.xxhash64("ids1", "ids2")).mapInPandas(multiply, "a long, b long"), "links")


def _near(x: Column, y: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    k: int = K, least: int = LEAST) -> DataFrame:
    """One row per document: the id, ``n_shingles``, ``component_id`` (smallest
    id of its group of linked documents), ``kept`` (whether it is that one)."""
    sets = stored(sketches(docs, doc_id, text, size, k), "sketches")
    classes = stored(sets.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = stored(sets.where("n > 0").join(classes, (F.col("id") == F.col("rep")) & (sets["digest"] == classes["digest"]), "left_semi")
                  .select("id", "n", "sketch", *MARKS), "reps")
    thin = stored(sets.select("id", "n", "digest"), "rows")
    drop_table(sets)
    rare = stored(_rare(reps, least, percent), "lists")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    stars = stored(_stars(rare, percent), "pairs")
    likely = stored(_likely(stars, reps, k, least, percent), "likely")
    edges = _verified(likely.where("possible").select("a", "b"), texts, size, percent)
    crowd = components(likely.select("a", "b"), "crowd").select(F.col("node").alias("id"), F.col("component").alias("crowd"))
    nodes = reps.select("id", "n", *MARKS).join(crowd, "id", "left").withColumn("crowd", F.coalesce("crowd", "id"))
    nodes = stored(with_components(nodes, "id", edges), "nodes")
    large = nodes.groupBy("crowd").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LARGE).select("crowd", F.lit(True).alias("large"))
    where = nodes.select("id", "crowd", *MARKS).join(large, "crowd", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    placed = stored(rare.join(where, "id"), "placed")
    drop_table(rare)
    may = _may_link(k, least, percent) & _near(F.col("x.n"), F.col("y.n"), percent)
    # a guest of a crowd shares a list with a document of it that it may be linked to
    hosts = placed.where("large").select("v", F.col("crowd").alias("host")).distinct()
    asked = placed.join(hosts, "v").where("crowd <> host and (not large or crowd < host)").select("v", "host", "id", "n", *MARKS)
    guests = (asked.alias("x").join(placed.where("large").alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.host") == F.col("y.crowd")) & may)
              .select("x.id", F.col("x.host").alias("crowd")).distinct())
    edges = edges.unionByName(_crowd_links(nodes.drop(*MARKS), stored(guests, "guests"), texts, size, percent))

    small = placed.where("not large")
    x, y = small.alias("x"), small.alias("y")
    # pairs of a list are looked at in the join; only those that may be linked are rows
    rest = (x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.crowd") != F.col("y.crowd")) & may)
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
            .join(stars, ["a", "b"], "left_anti"))
    rest = stored(rest, "pairs")
    drop_table(placed)
    possible = _likely(rest, reps, k, least, percent).where("possible").select("a", "b")
    more = _verified(stored(possible, "possible"), texts, size, percent)
    drop_table(reps)
    # members of a class hang on its smallest id
    members = thin.join(classes, "digest", "left").select("id", "n", "rep")
    found = with_components(classes.select("rep").distinct(), "rep", edges.unionByName(more)).select("rep", "component_id")
    return (members.join(found, "rep", "left")
            .select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents, with all its columns: the one
    with the smallest id. Texts decide, not ids: where an id repeats or lacks, rows
    are numbered in the order of id (none last) and text first, so exactly one row
    of a group stays, whatever ids it has."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    odd = docs.groupBy(F.col(doc_id).alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null")
    if is_empty(odd):
        numbered = docs.withColumn(row, F.col(doc_id))
    else:
        order = [F.col(doc_id).asc_nulls_last(), F.xxhash64(text).asc()]
        ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = stored(ranged.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(numbered, row, text, size, percent).where(~F.col("kept")).select(F.col(row).alias("_gone"))
    return numbered.join(gone.withColumnRenamed("_gone", row), row, "left_anti").select(*docs.columns)
