"""Vector code compression with adaptive distance bounds.

Vectors are cut into equal parts; each part position has a codebook of at most
256 entries, and a vector's code holds the nearest entry of each part. Entries
move for a few rounds and parts are assigned anew after each. Most parts keep
their entry, and bounds prove that without comparing them with all entries:
every part carries, from round to round in a step table, the ``b`` entries that
were closest to it, in order, each with a lower bound of its distance, and one
outer bound for all other entries. When entries move, a bound shrinks by the way
its entry has gone, the outer one by the longest way. The distance to the own
entry is worked out exactly; entries whose bound does not exceed it are compared
in integers, and only if the outer bound fails are all 256. After each round
``b`` shrinks to the number of entries that any part has needed.

Components are integers, so distances, ties (lower index) and sums are exact;
bounds are rounded down. Tasks add up their parts by entry, Spark adds up those
sums; the driver sees the codebooks only, 256 entries whatever the input.

Defined cases: vectors that are null or hold null or non-finite components are
left out; integers saturate at +-2^24. Vectors whose length is not the most
frequent one (the longer of two) have null code and error. Lengths that are not
a multiple of the number of parts are filled up with zeros at the end. Rows
without id are coded but start no entry; of repeated ids each row counts, in the
order of components. Fewer rows than entries make a smaller codebook. Further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LIMIT = 1 << 24
LISTED, LEAST = 32, 4      # entries that a part remembers: at first, and at least
ROWS = 4096                # parts that are compared with all entries at a time
STATE = "id long, label string, q array<int>, code binary, near binary, bound binary, error long, used array<int>"


def quantised(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label (as text), q: integer components of the vectors that are kept."""
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return (table.where(F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False)))
            .select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), whole.alias("q")))


@dataclass
class Codebooks:
    """``entries`` has shape (parts, entries, width); ``length`` of the vectors."""

    entries: np.ndarray
    length: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def split(self, q: np.ndarray) -> np.ndarray:
        """Vectors (n, length) as parts (parts, n, width)."""
        full = np.zeros((len(q), PARTS * self.width), dtype=np.int64)
        full[:, :self.length] = q
        return full.reshape(len(q), PARTS, self.width).transpose(1, 0, 2)

    def digest(self) -> str:
        flat = [str(x) for p in range(PARTS) for entry in self.entries[p] for x in entry[:max(0, min(self.width, self.length - p * self.width))]]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def moved(self, sums: list) -> Codebooks:
        """Entries at the rounded-down means of their parts; unused ones stay."""
        new = self.entries.copy()
        for r in sums:
            new[r["part"], r["entry"]] = np.array(r["total"], dtype=np.int64) // r["n"]
        return Codebooks(new, self.length)

    def way(self, old: Codebooks) -> np.ndarray:
        """How far each entry has gone, rounded up."""
        return _up(np.sqrt(_square(self.entries - old.entries)))


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12) + 1e-9


def _down(x: np.ndarray) -> np.ndarray:
    """Lower bounds as 32-bit numbers, never above x."""
    return np.nextafter((x * (1 - 1e-12) - 1e-9).astype(np.float32), np.float32(-np.inf))


class Part:
    """Assignment of the parts at one position: own entry, the closest others in
    order and their bounds (the last bound is the outer one)."""

    def __init__(self, x: np.ndarray, entries: np.ndarray):
        self.x, self.entries = x, entries
        n = len(x)
        self.own, self.error = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.needed = np.zeros(ENTRIES + 1, np.int64)      # how many parts compared how many entries

    def from_scratch(self, listed: int) -> None:
        b = min(listed, len(self.entries) - 1)
        self.near = np.zeros((len(self.x), b), np.uint8)
        self.bound = np.full((len(self.x), b + 1), np.inf, np.float32)
        self._compare_all(np.arange(len(self.x)))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances to all entries."""
        c = self.entries
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 52 else np.int64
        a, b = x.astype(kind), c.astype(kind)
        return (_square(a)[:, None] + _square(b)[None, :] - 2 * (a @ b.T)).astype(np.int64)

    def _compare_all(self, rows: np.ndarray) -> None:
        b = self.near.shape[1]
        for i in range(0, len(rows), ROWS):
            r = rows[i:i + ROWS]
            d = self._distances(self.x[r])
            at = np.arange(len(r))
            own = d.argmin(axis=1)                 # the first of equal ones
            self.own[r], self.error[r] = own, d[at, own]
            d[at, own] = np.iinfo(np.int64).max
            outer = np.full(len(r), np.inf)
            if b + 1 < d.shape[1]:
                first = np.argpartition(d, b, axis=1)
                outer = np.sqrt(d[at, first[:, b]].astype(np.float64))
                first = first[:, :b]
            else:
                first = np.argsort(d, axis=1)[:, :b]
            held = np.take_along_axis(d, first, 1)
            order = np.argsort(held, axis=1)
            self.near[r] = np.take_along_axis(first, order, 1)
            self.bound[r, :b] = _down(np.sqrt(np.take_along_axis(held, order, 1).astype(np.float64)))
            self.bound[r, b] = _down(outer)
        self.needed[ENTRIES] += len(rows)

    def again(self, own: np.ndarray, near: np.ndarray, bound: np.ndarray, way: np.ndarray, listed: int) -> None:
        """Assign after the entries have moved by ``way``."""
        self.own = own.astype(np.int64)
        shrunk = np.concatenate([bound[:, :-1] - way[near], bound[:, -1:] - way.max(initial=0.0)], axis=1)
        # in order: each bound also holds for all entries after it
        shrunk = np.minimum.accumulate(shrunk[:, ::-1], axis=1)[:, ::-1]
        b = min(listed, near.shape[1])
        self.near = near[:, :b].copy()
        self.bound = _down(shrunk[:, :b + 1])
        self.error = _square(self.x - self.entries[self.own])
        mine = _up(np.sqrt(self.error.astype(np.float64)))
        open_ = (self.bound <= mine[:, None]).sum(axis=1)       # a prefix, as bounds ascend
        self.needed[0] += int((open_ == 0).sum())
        lower = 1
        while lower <= b:
            upper = min(2 * lower, b + 1)
            self._compare_listed(np.flatnonzero((open_ >= lower) & (open_ < upper)), upper - 1, open_)
            lower = upper
        self._compare_all(np.flatnonzero(open_ > b))

    def _compare_listed(self, rows: np.ndarray, m: int, open_: np.ndarray) -> None:
        """Compare the own and the first m listed entries in integers."""
        for i in range(0, len(rows), ROWS):
            r = rows[i:i + ROWS]
            who = np.concatenate([self.own[r, None], self.near[r, :m].astype(np.int64)], axis=1)
            d = _square(self.x[r, None, :] - self.entries[who])
            order = np.lexsort((who, d), axis=1)
            who, d = np.take_along_axis(who, order, 1), np.take_along_axis(d, order, 1)
            self.own[r], self.error[r] = who[:, 0], d[:, 0]
            self.near[r, :m] = who[:, 1:]
            self.bound[r, :m] = _down(np.sqrt(d[:, 1:].astype(np.float64)))
            np.add.at(self.needed, open_[r], 1)


def _binary(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape[0], rows.shape[1] * rows.dtype.itemsize
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(-1) if rows.size else np.zeros(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _owners(code: pa.Array) -> np.ndarray:
    """A column of codes as (parts, rows)."""
    return np.frombuffer(b"".join(code.to_pylist()), dtype=np.uint8).reshape(-1, PARTS).T


def _assign(rows: DataFrame, books: Codebooks, listed: list[int], before: Codebooks | None) -> DataFrame:
    """One assignment of all vectors; ``used`` of the first row of a batch counts,
    per part position, how many parts compared how many entries."""
    way = books.way(before) if before is not None else None
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32())]

    def assign(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = batch.column(2)
            x = books.split(np.asarray(q.flatten(), dtype=np.int64).reshape(n, books.length))
            parts = [Part(x[p], books.entries[p]) for p in range(PARTS)]
            if way is None:
                for p, part in enumerate(parts):
                    part.from_scratch(listed[p])
            else:
                own, near, bound = _owners(batch.column(3)), _unframed(batch.column(4), np.uint8), _unframed(batch.column(5), np.float32)
                for p, part in enumerate(parts):
                    part.again(own[p], near[p], bound[p], way[p], listed[p])
            used = [None] * n
            used[0] = np.concatenate([part.needed for part in parts]).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), q, _binary(np.stack([p.own for p in parts], 1).astype(np.uint8)),
                _framed([p.near for p in parts]), _framed([p.bound for p in parts]),
                pa.array(sum(p.error for p in parts)), pa.array(used, pa.list_(pa.int32()))], schema=pa.schema(list(zip(names, kinds))))

    return rows.mapInArrow(assign, STATE)


def _framed(parts: list[np.ndarray]) -> pa.Array:
    """Rows of all part positions behind each other; a leading byte for each
    position tells how many items it has."""
    head = np.tile(np.array([p.shape[1] for p in parts], np.uint8), (len(parts[0]), 1))
    body = [np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1) for p in parts]
    return _binary(np.concatenate([head, *body], axis=1))


def _unframed(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The inverse of ``_framed``; all rows of a step table have equal counts."""
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    sizes = rows[0, :PARTS].astype(int) * np.dtype(kind).itemsize
    cuts = PARTS + np.concatenate([[0], np.cumsum(sizes)])
    return [np.ascontiguousarray(rows[:, a:b]).view(kind) for a, b in zip(cuts[:-1], cuts[1:])]


def _sums(state: DataFrame, books: Codebooks) -> list:
    """Sum and count of the parts of every entry: one row for each used entry."""
    width = books.width

    def add(batches):
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = books.split(np.asarray(batch.column(0).flatten(), dtype=np.int64).reshape(batch.num_rows, books.length))
                for p, own in enumerate(_owners(batch.column(1))):
                    np.add.at(total[p], own, x[p])
                    n[p] += np.bincount(own, minlength=ENTRIES)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry],
                                          "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    partial = state.select("q", "code").mapInArrow(add, "part int, entry int, n long, total array<long>")
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    return summed.collect()


def _needed(state: DataFrame, listed: list[int]) -> list[int]:
    """The number of listed entries that the parts of each position have needed,
    beyond those that were compared with all."""
    size = state.where("used is not null").select(F.posexplode("used")).groupBy("pos").agg(F.sum(F.col("col").cast("long")).alias("n")).where("n > 0").collect()
    one = ENTRIES + 1
    most = [0] * PARTS
    for r in size:
        p, m = divmod(r["pos"], one)
        if m <= listed[p]:
            most[p] = max(most[p], m)
    return [max(LEAST, min(b, m)) for b, m in zip(listed, most)]


@dataclass
class Compressed:
    """``rows``: id, label, code (bytes), error; ``needed``: entries listed a round."""

    rows: DataFrame
    books: Codebooks | None
    listed: list[list[int]]


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, listed: int = LISTED) -> Compressed:
    """Fit codebooks to all vectors and code each of them."""
    rows = materialize(quantised(table, vec_id, vector, label), "vectors")
    lengths = rows.groupBy(F.size("q").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    none = rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not lengths:
        return Compressed(none, None, [])
    length = lengths[0]["length"]
    same = rows.where(F.size("q") == length)
    first = same.where("id is not null").orderBy("id", "q").limit(ENTRIES).select("q").collect()
    if not first:
        return Compressed(none, None, [])
    width = -(-length // PARTS)
    books = Codebooks(np.zeros((PARTS, len(first), width), np.int64), length)
    books = Codebooks(np.ascontiguousarray(books.split(np.array([r["q"] for r in first], dtype=np.int64).reshape(len(first), length))), length)
    lists = [[listed] * PARTS]
    state = materialize(_assign(same, books, lists[0], None), "codes")
    for _ in range(rounds):
        new = books.moved(_sums(state, books))
        after = materialize(_assign(state, new, lists[-1], books), "codes")
        discard(state)
        state, books = after, new
        lists.append(_needed(state, lists[-1]))
    coded = state.select("id", "label", "code", "error")
    return Compressed(coded.unionByName(none.where(F.size(rows["q"]) != length)), books, lists)


def codes(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every vector that is kept."""
    done = compress(table, vec_id, vector, label)
    digest = done.books.digest() if done.books else hashlib.sha256(b"").hexdigest()
    totals = materialize(done.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return done.rows.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        F.col("id").alias(vec_id), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
