"""Gapped alignment inside a band, for whole Arrow batches of sequence pairs.

All pairs of a group advance together: one numpy step works out a row of the
band for every pair. Moves inside a row are a running maximum, so the table is
exact for the linear gap cost. The moves are read back for all pairs at once.

Scores (fixed values): match 1, mismatch -1, gap -2 a base. An unknown base (N)
matches nothing. Equal scores prefer a diagonal step, then a base of ``a`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MATCH, MISMATCH, GAP = 1, -1, -2
CELLS = 24 << 20            # cells of the tables held at a time
NONE = np.int32(-1 << 28)
N = ord("N")


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as a matrix (0 beyond the end), and the lengths."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    size = np.diff(at)
    out = np.zeros((len(column), max(1, int(size.max(initial=0)))), np.uint8)
    if size.sum():
        data = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
        row = np.repeat(np.arange(len(column)), size)
        out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)] = data
    return out, size


def band_alignment(a: pa.Array, b: pa.Array, diagonal: np.ndarray, band: int, inside: bool) -> tuple[np.ndarray, ...]:
    """Align each b to its a where b starts within ``band`` of a[diagonal].

    The start of a is free. With ``inside`` all of b is aligned and the end of a
    is free; else a is aligned up to its end and the rest of b hangs over.
    Returns score, a_start, a_end, b_end and ``moves``: a matrix of the letters
    = X D I (D: a base of a alone), 0 after the last. Pairs without an alignment
    in the band have the score ``NONE``."""
    x, nx = _padded(a)
    y, ny = _padded(b)
    m, rows, wide = len(x), x.shape[1], 2 * band + 1
    offset = np.arange(wide)
    each = np.arange(m)
    table = np.full((rows + 1, m, wide + 1), NONE, np.int32)
    edge = GAP * offset
    for i in range(rows + 1):
        j = i - diagonal[:, None] + offset[None, :] - band
        fits = (j >= 0) & (j <= ny[:, None]) & (i <= nx)[:, None]
        now = np.full((m, wide), NONE, np.int32)
        if i:
            before = table[i - 1]
            letter = y[each[:, None], np.clip(j - 1, 0, y.shape[1] - 1)]
            same = (letter == x[:, i - 1, None]) & (letter != N)
            now = np.where(j > 0, before[:, :wide] + np.where(same, MATCH, MISMATCH), NONE)
            now = np.maximum(now, before[:, 1:] + GAP)
        now = np.where(j == 0, 0, now)
        now = np.where(fits, now, NONE)
        now = np.maximum.accumulate(now - edge, axis=1) + edge
        table[i, :, :wide] = np.where(fits & (now > NONE // 2), np.where(j == 0, 0, now), NONE)
    # where the alignment ends
    if inside:
        i = np.arange(rows + 1)[None, :]
        o = ny[:, None] - i + diagonal[:, None] + band
        ok = (o >= 0) & (o < wide)
        ends = np.where(ok, table[np.clip(i, 0, rows), each[:, None], np.clip(o, 0, wide - 1)], NONE)
        ai = ends.argmax(axis=1)
        score, ao = ends[each, ai], o[each, ai]
    else:
        ai = nx.copy()
        ends = table[ai, each, :wide]
        ao = ends.argmax(axis=1)
        score = ends[each, ao]
    a_end, b_end = ai.copy(), ai - diagonal + ao - band
    live = score > NONE // 2
    moves = np.zeros((m, rows + y.shape[1] + 1), np.uint8)
    i, o, step = ai.copy(), np.clip(ao, 0, wide - 1), 0
    while True:
        j = i - diagonal + o - band
        live &= j > 0
        k = np.flatnonzero(live)
        if not len(k):
            break
        here = table[i[k], k, o[k]]
        letter, base = y[k, j[k] - 1], x[k, np.maximum(i[k] - 1, 0)]
        same = (letter == base) & (letter != N)
        up = np.maximum(i[k] - 1, 0)
        across = (i[k] > 0) & (here == table[up, k, o[k]] + np.where(same, MATCH, MISMATCH))
        alone = ~across & (i[k] > 0) & (here == table[up, k, o[k] + 1] + GAP)
        moves[k, step] = np.where(across, np.where(same, ord("="), ord("X")), np.where(alone, ord("D"), ord("I")))
        i[k] -= across | alone
        o[k] += np.where(across, 0, np.where(alone, 1, -1))
        step += 1
    moves = moves[:, :step]
    # read back to front
    size = (moves != 0).sum(axis=1)
    turned = np.where(np.arange(step)[None, :] < size[:, None], moves[each[:, None], np.clip(size[:, None] - 1 - np.arange(step)[None, :], 0, max(step - 1, 0))], 0)
    return score, i, a_end, b_end, turned.astype(np.uint8)


def groups(batch: pa.RecordBatch, a: str, band: int) -> Iterator[pa.RecordBatch]:
    """Rows of like length, few enough for the tables of a group."""
    size = pc.binary_length(batch.column(a)).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * (int(size[order[at + n]]) + 1) * (2 * band + 2) <= CELLS:
            n += 1
        yield batch.take(pa.array(order[at:at + n]))
        at += n


def _aligned(pairs: DataFrame, band: int, inside: bool) -> DataFrame:
    """``pairs`` (key columns, a, b, diagonal) with score, a_start, a_end, b_end, moves in place of the texts."""
    keys = [c for c in pairs.columns if c not in ("a", "b", "diagonal")]
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)

    def align(batches):
        for batch in batches:
            for g in groups(batch, "a", band) if batch.num_rows else ():
                score, start, end, b_end, moves = band_alignment(g.column("a"), g.column("b"), g.column("diagonal").to_numpy(), band, inside)
                ok = np.flatnonzero(score > NONE // 2)
                text = [bytes(r[r != 0]).decode() for r in moves[ok]]
                g = g.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*[g.column(c) for c in keys], *[pa.array(v[ok].astype(np.int32)) for v in (score, start, end, b_end)], pa.array(text, pa.string())],
                                                 names=[*keys, "score", "a_start", "a_end", "b_end", "moves"])

    rows = pairs.where("a is not null and b is not null and diagonal is not null").select(*keys, "a", "b", F.col("diagonal").cast("int").alias("diagonal"))
    return rows.mapInArrow(align, f"{schema}, score int, a_start int, a_end int, b_end int, moves string")


def end_alignments(pairs: DataFrame, band: int = 8, min_overlap: int = 1, max_miss: float = 1.0) -> DataFrame:
    """Suffix of ``a`` against prefix of ``b`` with insertions and deletions, b
    starting within ``band`` of a[diagonal]. Adds score, a_start, b_end, the number
    of edits and the moves; overlaps of fewer than ``min_overlap`` bases of b or with
    more than ``max_miss`` edits a base are left out. Only the last bases of a that
    the band can reach travel."""
    reach = F.length("b") + band
    cut = F.greatest(F.length("a") - F.greatest(F.length("a") - F.col("diagonal") + band, F.lit(0)), F.lit(0)).cast("int")
    short = pairs.withColumn("_cut", cut).withColumn("a", F.expr("substring(a, _cut + 1)")).withColumn("diagonal", (F.col("diagonal") - F.col("_cut")).cast("int")).where(F.length("a") <= reach + band)
    out = _aligned(short, band, inside=False)
    edits = F.length(F.regexp_replace("moves", "=", ""))
    return (out.withColumn("a_start", F.col("a_start") + F.col("_cut")).withColumn("edits", edits).drop("_cut", "a_end")
            .where((F.col("b_end") >= min_overlap) & (F.col("edits") <= F.col("b_end") * max_miss)))


def inner_alignments(pairs: DataFrame, band: int = 8) -> DataFrame:
    """All of ``b`` somewhere in ``a``, starting within ``band`` of a[diagonal]."""
    return _aligned(pairs, band, inside=True)
