"""Near-duplicate vectors by int8 tile products with per-vector error bounds.

Every vector is scaled to length one and quantised to int8 codes with its own
step; the length of what is lost is measured for each vector. For two vectors
    |u.v - q_u.q_v| <= |q_u| e_v + |q_v| e_u + e_u e_v,
so the product of the codes tells which pairs may reach the threshold, and only
those are recomputed from the given numbers in double precision. Code products
are exact: they run as float32 matrix products while 127^2 * dim < 2^24, in
float64 beyond.

Vectors are put to the nearest of a few pivots (a bounded sample); by the
triangle inequality of angles, two cells whose pivots are further apart than
both radii plus the threshold's angle hold no link. Cells are cut into tiles of
about ``TILE`` vectors, whatever their size. The tiles are one step table, with 4
bytes a number where single precision loses nothing; its partitions meet in pairs,
read where they are needed, so the pairs of tiles of cells that remain are
multiplied without a shuffle. Equal vectors are one class. A pair of tiles returns
a spanning forest of its links and a task link counts per class, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different dimensions link with
nothing; repeated ids are counted as rows, each with the links of its own vector;
rows without an id link like others but give no component id, so a component of
such rows alone has none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import drop_table, stored, with_components

TILE = 2048
PIVOTS = 32       # bound of the sample that places the cells
BLOCK = 128       # rows of a tile that are multiplied at once
HELD = 64 << 20   # bytes of prepared tiles that a task keeps
SLACK = 1e-9      # above every rounding error of the bounds


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)     # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, step, length of the coded vector, length of what is lost."""
    step = np.abs(u).max(axis=1) / 127
    code = np.rint(u / step[:, None]).astype(np.int8)
    coded = code * step[:, None]
    lost = u - coded
    return code, step, np.sqrt(np.einsum("ij,ij->i", coded, coded)), np.sqrt(np.einsum("ij,ij->i", lost, lost))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision."""
    return np.einsum("ij,ij->i", unit(x), unit(y))


def prepared(x: np.ndarray) -> tuple:
    """What a tile brings to its products: the numbers, codes, step, length, loss."""
    code, step, length, lost = quantise(unit(x))
    return x, code.astype(np.float32 if exact_in_float(x.shape[1]) else np.float64), step, length, lost


def exact_in_float(dim: int) -> bool:
    return 127 * 127 * dim < 1 << 24


def tile_links(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of linked rows of two prepared tiles, in blocks of rows of ``left``."""
    (x, cx, sx, lx, ex), (y, cy, sy, ly, ey) = left, right
    # no pair of row i has a larger bound than this, nor a step beyond these
    rest = threshold - SLACK - (lx * ey.max() + ex * ly.max() + ex * ey.max())
    least = rest / (sx * np.where(rest > 0, sy.max(), sy.min()))
    least = np.nextafter(least.astype(cx.dtype), cx.dtype.type(-np.inf))
    for a in range(0, len(x), BLOCK):
        product = cx[a:a + BLOCK] @ cy.T
        at = np.flatnonzero(product >= least[a:a + BLOCK, None])
        if not len(at):
            continue
        i, j = np.divmod(at, len(y))
        value = product.ravel()[at].astype(np.float64)
        i += a
        if same:
            value, i, j = value[i < j], i[i < j], j[i < j]
        bound = lx[i] * ey[j] + ex[i] * ly[j] + ex[i] * ey[j]
        may = value * (sx[i] * sy[j]) + bound >= threshold - SLACK
        i, j = i[may], j[may]
        for b in range(0, len(i), 1 << 16):
            p, q = i[b:b + (1 << 16)], j[b:b + (1 << 16)]
            ok = cosines(x[p], y[q]) >= threshold
            yield p[ok], q[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of n nodes under the given edges."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: the id, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable by links), ``kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    parsed = stored(given.mapInArrow(_digests, "id long, digest binary"), "vectors")
    tiles = _tiles(given, parsed, threshold)
    # a class has a key of its own: its smallest id may stand for other vectors too
    classes = stored(tiles.select("tile", "digests", "ids", "sizes").mapInArrow(_members, "key long, digest binary, rep long, size long"), "classes")
    found = _links(tiles, threshold)
    drop_table(tiles)
    counts = found.where("partner is null").groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.where("partner is not null").select(F.col("id").alias("a"), F.col("partner").alias("b"))
    per_class = with_components(classes.join(counts, F.col("key") == F.col("id"), "left").drop("id"), "key", edges)
    per_class = stored(per_class.withColumnRenamed("component_id", "root"), "per-class")
    lowest = stored(per_class.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    per_class = per_class.join(lowest, "root").select("digest", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    return (parsed.select("id", "digest").join(per_class, "digest", "left")
            .select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(True))))


def _read(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch that can link, borders of all rows, the numbers, and which
    rows hold nothing that single precision would lose."""
    at = column.offsets.to_numpy()
    value = column.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0     # nulls become nan, -0.0 becomes 0.0
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[at])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    good = there & (count(~np.isfinite(value)) == 0) & (count(value != 0) > 0)
    with np.errstate(over="ignore", invalid="ignore"):
        wide = count(value.astype(np.float32).astype(np.float64) != value) > 0
    return good, at, value, ~wide


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest of the numbers; null where a row links with nothing."""
    for batch in batches:
        good, at, value, _ = _read(batch.column(1))
        digest = [_digest(value[at[i]:at[i + 1]]) if good[i] else None for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary())], ["id", "digest"])


def _vectors(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Different vectors of each batch (digest, smallest id, number of rows, dim,
    data, cell, angle to its pivot); data has 4 bytes a number where they suffice.
    The cell follows from whole numbers, so equal vectors never differ in it."""
    codes = {d: np.rint(p / np.abs(p).max(axis=1, keepdims=True) * 127) for d, p in pivots.items()}
    for batch in batches:
        good, at, value, narrow = _read(batch.column(1))
        ids = batch.column(0).to_pylist()
        rows: dict[bytes, list] = {}
        for i in np.flatnonzero(good):
            x = value[at[i]:at[i + 1]]
            row = rows.setdefault(digest := _digest(x), [digest, ids[i], 0, len(x), i])
            row[2] += 1
            if ids[i] is not None and (row[1] is None or ids[i] < row[1]):
                row[1] = ids[i]
        digest, rep, size, dim, first = map(list, zip(*rows.values())) if rows else ([], [], [], [], [])
        dims, cell, angle = np.array(dim, dtype=np.int64), np.zeros(len(rows), dtype=np.int32), np.full(len(rows), np.pi)
        for d in np.unique(dims):
            if d in pivots:
                k = np.flatnonzero(dims == d)
                x = np.vstack([value[at[first[i]]:at[first[i] + 1]] for i in k])
                code = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127)
                c = (code @ codes[d].T / np.sqrt((codes[d] * codes[d]).sum(axis=1))).argmax(axis=1)
                cell[k], angle[k] = c, np.arccos(np.clip(np.einsum("ij,ij->i", unit(x), pivots[d][c]), -1, 1))
        data = [(x.astype(np.float32) if narrow[i] else x).tobytes() for i in first for x in (value[at[i]:at[i + 1]],)]
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(rep, pa.int64()), pa.array(size, pa.int64()), pa.array(dim, pa.int32()),
                                          pa.array(data, pa.binary()), pa.array(cell), pa.array(angle)],
                                         ["digest", "rep", "size", "dim", "data", "cell", "angle"])


def _numbers(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim * rows else np.float64).reshape(rows, dim).astype(np.float64)


def _pack(t: pa.Table) -> pa.Table:
    """One tile: its classes in the order of their digests, equal rows put together."""
    rows: dict[bytes, list] = {}
    for digest, rep, size, data in zip(*(t[c].to_pylist() for c in ("digest", "rep", "size", "data"))):
        row = rows.setdefault(digest, [rep, 0, data])
        row[1] += size
        if rep is not None and (row[0] is None or rep < row[0]):
            row[0] = rep
    order, dim = sorted(rows), t["dim"][0].as_py()
    data = [rows[k][2] for k in order]
    if len({len(x) for x in data}) > 1:
        data = [_numbers(x, dim, 1).tobytes() for x in data]
    return pa.table({"tile": t["tile"][:1], "number": t["number"][:1], "near": t["near"][:1], "dim": t["dim"][:1],
                     "digests": pa.array([b"".join(order)], pa.binary()), "ids": pa.array([[rows[k][0] for k in order]], pa.list_(pa.int64())),
                     "sizes": pa.array([np.array([rows[k][1] for k in order], np.int64).tobytes()], pa.binary()), "data": pa.array([b"".join(data)], pa.binary())})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of the tiles: key (tile and place in it), digest, smallest id, size."""
    for batch in batches:
        for tile, digests, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array((tile << 32) + np.arange(len(ids))), pa.array([digests[i:i + 16] for i in range(0, len(digests), 16)], pa.binary()),
                                              pa.array(ids, pa.int64()), pa.array(np.frombuffer(sizes, np.int64))], ["key", "digest", "rep", "size"])


def _tiles(given: DataFrame, parsed: DataFrame, threshold: float) -> DataFrame:
    """Tiles of about ``TILE`` different vectors of one cell: tile, number of the
    cell, numbers of the cells that may hold links with it, dim, and packed classes.
    Vectors are read from the table whenever they are needed and travel once."""
    spark, kind = given.sparkSession, "digest binary, rep long, size long, dim int, data binary, cell int, angle double"
    chosen = parsed.where("digest is not null").select("digest").distinct().orderBy(F.xxhash64("digest"), "digest").limit(PIVOTS).collect()
    known = given.mapInArrow(lambda batches: _vectors(batches, {}), kind).where(F.col("digest").isin([bytes(r["digest"]) for r in chosen]))
    pivots: dict[int, np.ndarray] = {}
    for r in known.groupBy("digest").agg(F.min(F.struct("dim", "data")).alias("v")).orderBy(F.xxhash64("digest"), "digest").collect():
        u = unit(_numbers(bytes(r["v"]["data"]), r["v"]["dim"], 1))
        pivots[r["v"]["dim"]] = np.vstack([pivots[r["v"]["dim"]], u]) if r["v"]["dim"] in pivots else u

    placed = given.mapInArrow(lambda batches: _vectors(batches, pivots), kind)
    # at most PIVOTS cells, and one for each dimension without a pivot
    cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("dim", "cell").collect()
    limit = float(np.arccos(min(threshold, 1.0))) + 1e-6
    of_dim: dict[int, list[int]] = {}
    for k, c in enumerate(cells):
        of_dim.setdefault(c["dim"], []).append(k)

    def meet(a, b) -> bool:
        p = pivots.get(a["dim"])
        between = 0.0 if p is None else float(np.arccos(np.clip(p[a["cell"]] @ p[b["cell"]], -1, 1)))
        return between <= a["radius"] + b["radius"] + limit

    rows, base = [], 0
    for k, c in enumerate(cells):
        n = -(-c["n"] // TILE)
        rows.append((c["dim"], c["cell"], k, base, n, [m for m in of_dim[c["dim"]] if m == k or meet(c, cells[m])]))
        base += n
    cells = F.broadcast(spark.createDataFrame(rows, "dim int, cell int, number int, base long, tiles long, near array<int>"))
    dealt = placed.join(cells, ["dim", "cell"]).withColumn("tile", F.col("base") + F.pmod(F.xxhash64("digest"), F.col("tiles")))
    return stored(dealt.select("tile", "number", "near", "dim", "digest", "rep", "size", "data").groupBy("tile").applyInArrow(
        _pack, "tile long, number int, near array<int>, dim int, digests binary, ids array<long>, sizes binary, data binary"), "tiles")


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, n, null): linked vectors of a class met in pairs of tiles;
    rows (id, null, partner): forest edges. Tiles meet as partitions of their
    table, each read where it is needed: pairs of tiles are never shuffled."""
    first = tiles.select("tile", "number", "near", "dim", "sizes", "data")
    second = tiles.select(F.col("tile").alias("tile2"), F.col("number").alias("number2"), F.col("sizes").alias("sizes2"), F.col("data").alias("data2"))
    # each pair once; by turns the lower or the higher tile comes first, so partitions get equal shares
    once = (F.col("tile") == F.col("tile2")) | ((F.col("tile") < F.col("tile2")) == ((F.col("tile") + F.col("tile2")) % 2 == 0))
    pairs = first.join(second.hint("shuffle_replicate_nl"), F.array_contains("near", F.col("number2")) & once)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}      # the second sides come again for every first one
        count: dict[int, np.ndarray] = {}

        def tile(key: int, dim: int, sizes: pa.Scalar, data: pa.Scalar) -> tuple:
            if key not in held:
                size = np.frombuffer(sizes.as_py(), np.int64)
                if held and 16 * dim * len(size) * (len(held) + 1) > HELD:
                    held.pop(next(iter(held)))
                held[key] = prepared(_numbers(data.as_py(), dim, len(size))), size
            count.setdefault(key, np.zeros(len(held[key][1]), dtype=np.int64))
            return held[key]

        for batch in batches:
            for r, (t, t2, dim) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "tile2", "dim")))):
                x, size = tile(t, dim, batch.column("sizes")[r], batch.column("data")[r])
                y, size2 = tile(t2, dim, batch.column("sizes2")[r], batch.column("data2")[r])
                n, shift = len(size), 0 if t == t2 else len(size)
                nodes = n + (0 if t == t2 else len(size2))
                root = np.arange(nodes)
                for i, j in tile_links(x, y, threshold, t == t2):
                    np.add.at(count[t], i, size2[j])
                    np.add.at(count[t2], j, size[i])
                    new = root[i] != root[j + shift]
                    if new.any():
                        joined = forest(nodes, root[i[new]], root[j[new] + shift])
                        root = joined[root]
                hung = np.flatnonzero(root != np.arange(nodes))
                if len(hung):
                    key = np.concatenate([(t << 32) + np.arange(n), (t2 << 32) + np.arange(nodes - n)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[hung]), pa.nulls(len(hung), pa.int64()), pa.array(key[root[hung]])], ["id", "n", "partner"])
        for t, n in count.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array((t << 32) + met), pa.array(n[met]), pa.nulls(len(met), pa.int64())], ["id", "n", "partner"])

    return stored(pairs.select("tile", "tile2", "dim", "sizes", "data", "sizes2", "data2").mapInArrow(multiply, "id long, n long, partner long"), "links")
