"""Gaps filled by a partial-order consensus of the long-read pieces that span them.

The pieces of a gap are aligned with one of them. A node of the order is a base in
a column (a base of that piece) or in a slot between two columns; an edge leads
from each base of a piece to its next one and weighs as many pieces as take it. An
edge table is summed by Spark, so deep gaps are no larger than their different
errors; columns and slots are the topological levels. The path follows the heaviest
edge back from the end. Another round aligns the pieces with that path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .align import NONE, _padded, band_alignment, groups

END = np.int64(1) << 62       # above every level; the start is below, at -1


def backbones(pieces: DataFrame, min_depth: int) -> DataFrame:
    """The piece of median length of each gap with ``min_depth`` pieces: (gap, seq)."""
    middle = materialize(pieces.groupBy("gap").agg(F.percentile_approx(F.length("piece"), 0.5, 10000).alias("m"), F.count(F.lit(1)).alias("n"))
                         .where(F.col("n") >= min_depth).select("gap", "m"), "gap-lengths")
    near = F.struct(F.abs(F.length("piece") - F.col("m")), "piece")
    return pieces.join(middle, "gap").groupBy("gap").agg(F.min(near).alias("b")).select("gap", F.col("b.piece").alias("seq"))


def order_edges(pieces: DataFrame, against: DataFrame, band: int) -> DataFrame:
    """Edges of the partial order of each gap: (gap, u, v, n). A node is its column,
    slot and base in one number, which rises along every piece."""
    once = pieces.groupBy("gap", "piece").agg(F.count(F.lit(1)).alias("n"))
    pairs = once.join(against, "gap").select("gap", "n", F.col("seq").alias("a"), F.col("piece").alias("b"), F.lit(0).alias("diagonal"))

    def edges(batches):
        for batch in batches:
            for g in groups(batch, "a", band) if batch.num_rows else ():
                score, start, _, _, moves = band_alignment(g.column("a"), g.column("b"), g.column("diagonal").to_numpy(), band, True)
                letters, _ = _padded(g.column("b"))
                on_a = (moves == ord("=")) | (moves == ord("X")) | (moves == ord("D"))
                on_b = (moves != 0) & (moves != ord("D"))
                pos = start[:, None] + np.cumsum(on_a, axis=1)          # 1-based; 0 is before the first column
                extra = moves == ord("I")
                run = np.cumsum(extra, axis=1)
                slot = np.where(extra, run - np.maximum.accumulate(np.where(extra, 0, run), axis=1), 0)
                base = letters[np.arange(len(letters))[:, None], np.clip(np.cumsum(on_b, axis=1) - 1, 0, letters.shape[1] - 1)]
                node = (pos.astype(np.int64) << 24) | (slot.astype(np.int64) << 8) | base
                row, at = np.nonzero(on_b & (score > NONE // 2)[:, None])
                node = node[row, at]
                first = np.concatenate([[True], row[1:] != row[:-1]])[:len(row)]
                last = np.concatenate([row[1:] != row[:-1], [True]])[-len(row):] if len(row) else first
                u = np.where(first, -1, np.concatenate([[-1], node[:-1]])[:len(row)])
                owner = np.concatenate([row, row[last]])
                u, v = np.concatenate([u, node[last]]), np.concatenate([node, np.full(last.sum(), END)])
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([g.column("gap").take(take), pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), g.column("n").take(take)], ["gap", "u", "v", "n"])

    kind = pairs.schema["gap"].dataType.simpleString()
    return pairs.mapInArrow(edges, f"gap {kind}, u long, v long, n long").groupBy("gap", "u", "v").agg(F.sum("n").alias("n"))


def heaviest_path(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[str, int]:
    """Text of the path that takes the heaviest edge into each node, back from the
    end, and its lightest edge. Edges are sorted by v; equal weights take the node
    with the heavier way behind it, then the smaller one."""
    way, back = {-1: 0}, {}
    for a, b, w in zip(u.tolist(), v.tolist(), n.tolist()):
        best = back.get(b)
        if best is None or (w, way[a], -a) > (best[1], way[best[0]], -best[0]):
            back[b] = (a, w)
            way[b] = way[a] + w
    out, least, at = [], None, int(END)
    while at != -1:
        at, w = back[at]
        least = w if least is None else min(least, w)
        if at != -1:
            out.append(at & 255)
    return bytes(out[::-1]).decode(), least


def paths(edges: DataFrame) -> DataFrame:
    """Best path of each gap: (gap, seq, depth), depth its lightest edge."""
    by = edges.groupBy("gap").agg(F.array_sort(F.collect_list(F.struct("v", "u", "n"))).alias("e")).select(
        "gap", *[F.col(f"e.{c}").alias(c) for c in ("u", "v", "n")])

    def walk(batches):
        for b in batches:
            at = b.column(1).offsets.to_numpy()
            u, v, n = (b.column(i).values.to_numpy() for i in (1, 2, 3))
            found = [heaviest_path(u[x:y], v[x:y], n[x:y]) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], ["gap", "seq", "depth"])

    return by.mapInArrow(walk, f"gap {by.schema['gap'].dataType.simpleString()}, seq string, depth long")


def gap_consensus(pieces: DataFrame, band: int = 16, min_depth: int = 3, rounds: int = 2) -> DataFrame:
    """``pieces`` (gap, piece): the text of reads from one flank of a gap to the
    other. Result: (gap, seq, depth) for gaps with ``min_depth`` pieces. Null and empty
    pieces do not count; a piece that leaves the band adds nothing."""
    p = pieces.where(F.length("piece") > 0)
    against = materialize(backbones(p, min_depth), "backbones")
    for _ in range(rounds):
        found = materialize(paths(order_edges(p, against, band)), "paths")
        against = found.select("gap", "seq")
    return found
