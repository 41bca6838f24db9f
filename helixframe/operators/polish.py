"""Polishing by gapped alignments of placed reads.

Every read votes on the columns of its contig: a column is a base of the contig
or a slot between two bases (position, slot 1, 2, ...), where reads hold bases
that the contig lacks. Votes are added up inside a task and then by Spark, so a
position under very many reads is a few rows; columns that win are edits, and a
running sum of what was inserted and deleted before gives their new places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.bases import revcomp
from .align import NONE, band_alignment, groups
from .skew import ordered_blocks, running_sum

TILE = 4096                 # contig text that a read is joined with
BLOCK = 1024                # columns that are put together at a time
HELD = 1 << 20              # counted columns that a task holds before it writes them


def placed_windows(contigs: DataFrame, reads: DataFrame, band: int, longest: int = TILE) -> DataFrame:
    """Reads with the stretch of their contig that the band can reach.

    contigs: (contig, seq); reads: (contig, pos, strand, read), ``pos`` is where the
    read is placed, give or take the band. Contigs are cut into tiles that overlap
    by the longest read and the band, so a read meets one tile, not a whole contig.
    Result: contig, a, b, diagonal, first (place of a in the contig)."""
    reach = longest + 2 * band
    n = F.length("seq")
    tiles = contigs.where(n > 0).select("contig", "seq", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / TILE))).alias("tile")).select(
        "contig", "tile", F.expr(f"substring(seq, cast(tile * {TILE} + 1 as int), {TILE + reach})").alias("text"))
    b = F.when(F.col("strand") < 0, revcomp("read")).otherwise(F.col("read"))
    first = F.greatest(F.col("pos") - band, F.lit(0))
    r = reads.where((F.length("read") > 0) & (F.length("read") <= longest)).select(
        "contig", first.cast("int").alias("first"), (F.col("pos") - first).cast("int").alias("diagonal"), b.alias("b"), F.floor(first / TILE).alias("tile"))
    return r.join(tiles, ["contig", "tile"]).select(
        "contig", "first", "diagonal", "b", F.expr(f"substring(text, cast(first - tile * {TILE} + 1 as int), length(b) + {3 * band})").alias("a"))


def column_votes(placed: DataFrame, band: int = 8, margin: int = 4, max_miss: float = 0.2) -> DataFrame:
    """contig, pos, slot, base, n: what reads hold in each column; ``-`` is a base
    of the contig that they lack. The first and last ``margin`` moves of a read do
    not vote (gaps near an end are not settled), nor do reads with more than
    ``max_miss`` edits a base. ``slot`` 0 is a base of the contig."""
    def votes(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def written():
            for contig, parts in held.items():
                code, n = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                count = np.bincount(n, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"contig": pa.array(np.full(len(code), contig)), "pos": code >> 16, "slot": ((code >> 8) & 255).astype(np.int32),
                                                  "base": pa.array([chr(c) for c in code & 255]), "n": count})
            held.clear()

        rows = 0
        for batch in batches:
            for g in groups(batch, "a", band) if batch.num_rows else ():
                score, start, _, _, moves = band_alignment(g.column("a"), g.column("b"), g.column("diagonal").to_numpy(), band, True)
                if not moves.shape[1]:
                    continue
                size = (moves != 0).sum(axis=1)
                edits = ((moves != 0) & (moves != ord("="))).sum(axis=1)
                ok = (score > NONE // 2) & (edits <= size * max_miss)
                on_a = (moves == ord("=")) | (moves == ord("X")) | (moves == ord("D"))
                on_b = (moves != 0) & (moves != ord("D"))
                pos = start[:, None] + np.cumsum(on_a, axis=1) - 1 + g.column("first").to_numpy()[:, None]
                at_b = np.cumsum(on_b, axis=1) - 1
                extra = moves == ord("I")
                run = np.cumsum(extra, axis=1)
                slot = np.where(extra, run - np.maximum.accumulate(np.where(extra, 0, run), axis=1), 0)
                step = np.arange(moves.shape[1])[None, :]
                use = ok[:, None] & (step >= margin) & (step < size[:, None] - margin) & (slot < 256) & (pos >= 0)
                text = g.column("b").to_pylist()
                letters = np.zeros((len(text), max(map(len, text))), np.uint8)
                for r, t in enumerate(text):
                    letters[r, :len(t)] = np.frombuffer(t.encode(), np.uint8)
                base = np.where(on_b, letters[np.arange(len(text))[:, None], np.clip(at_b, 0, letters.shape[1] - 1)], ord("-"))
                code = (pos.astype(np.int64) << 16) | (slot.astype(np.int64) << 8) | base
                owner = np.broadcast_to(g.column("contig").to_numpy()[:, None], code.shape)[use]
                code = code[use]
                for contig in np.unique(owner):
                    key, n = np.unique(code[owner == contig], return_counts=True)
                    held.setdefault(int(contig), []).append((key, n))
                    rows += len(key)
                if rows > HELD:
                    yield from written()
                    rows = 0
        yield from written()

    cut = placed.select(F.col("contig").cast("long").alias("contig"), "first", "diagonal", "a", "b")
    return cut.mapInArrow(votes, "contig long, pos long, slot int, base string, n long").groupBy("contig", "pos", "slot", "base").agg(F.sum("n").alias("n"))


def edits(votes: DataFrame, contigs: DataFrame, min_depth: int = 3) -> DataFrame:
    """Columns that change: contig, pos, slot, base (``-`` deletes).

    A base of the contig changes when more than half of the reads over it agree on
    another one or lack it; a slot is filled when more than half of the reads over
    the base before it hold the same base there."""
    best = votes.groupBy("contig", "pos", "slot").agg(F.max(F.struct("n", "base")).alias("best"), F.sum("n").alias("depth"))
    over = best.where("slot = 0").select("contig", "pos", F.col("depth").alias("over"))
    won = best.join(over, ["contig", "pos"]).where((F.col("over") >= min_depth) & (2 * F.col("best.n") > F.col("over")))
    won = won.select("contig", "pos", "slot", F.col("best.base").alias("base"))
    # what stands there now, looked up in tiles
    tiles = contigs.where(F.length("seq") > 0).select("contig", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / TILE))).alias("tile")).select(
        "contig", "tile", F.expr(f"substring(seq, cast(tile * {TILE} + 1 as int), {TILE})").alias("text"))
    t = won.withColumn("tile", F.floor(F.col("pos") / TILE)).join(tiles, ["contig", "tile"])
    now = F.expr(f"substring(text, cast(pos - tile * {TILE} + 1 as int), 1)")
    return t.where((F.col("slot") > 0) | (now != F.col("base"))).select("contig", "pos", "slot", "base")


def rebased(changes: DataFrame) -> DataFrame:
    """Edits with ``new_pos``: where the column lies (or, for a deletion, would lie)
    in the polished contig, by a running sum of the slots before it."""
    shift = F.when(F.col("slot") > 0, 1).when(F.col("base") == "-", -1).otherwise(0)
    blocks = ordered_blocks(changes.withColumn("shift", shift), ["contig"], ["pos", "slot"], "edits")
    run = running_sum(blocks, ["contig"], ["pos", "slot"], "shift", "moved")
    own = F.when(F.col("slot") > 0, 0).otherwise(F.col("shift"))
    return run.select("contig", "pos", "slot", "base", (F.col("pos") + F.col("moved") - own).alias("new_pos"))


def apply_edits(contigs: DataFrame, changes: DataFrame) -> DataFrame:
    """Contigs with the edits made: (contig, seq). Blocks of ``BLOCK`` bases are
    changed by themselves and then put together."""
    n = F.length("seq")
    blocks = contigs.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / BLOCK))).alias("blk")).select(
        "contig", "blk", F.expr(f"substring(seq, cast(blk * {BLOCK} + 1 as int), {BLOCK})").alias("text"))
    place = (F.col("pos") % BLOCK).cast("int")
    by = changes.groupBy("contig", F.floor(F.col("pos") / BLOCK).alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("p"), "slot", "base"))).alias("e"))
    t = blocks.join(by, ["contig", "blk"], "left")
    # each edit brings the text since the edit before it; a changed or deleted base is left out of that text
    ends = F.transform("e", lambda x: x["p"] + F.when(x["slot"] > 0, 1).otherwise(0))
    starts = F.transform("e", lambda x: x["p"] + 1)
    piece = F.transform(F.arrays_zip(F.col("e"), ends.alias("end"), F.concat(F.array(F.lit(0)), starts).alias("start")),
                        lambda z: F.when(z["e"].isNull(), F.substring("text", z["start"] + 1, F.lit(BLOCK))).otherwise(
                            F.concat(F.substring("text", z["start"] + 1, F.greatest(z["end"] - z["start"], F.lit(0))), F.when(z["e"]["base"] == "-", "").otherwise(z["e"]["base"]))))
    new = F.when(F.col("e").isNull(), F.col("text")).otherwise(F.array_join(piece, ""))
    return t.select("contig", "blk", new.alias("text")).groupBy("contig").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "text"))), lambda x: x["text"]), "").alias("seq"))


def polish(contigs: DataFrame, reads: DataFrame, band: int = 8, min_depth: int = 3, margin: int = 4) -> DataFrame:
    """Contigs corrected by the reads placed on them: (contig, seq)."""
    votes = column_votes(placed_windows(contigs, reads, band), band, margin)
    return apply_edits(contigs, edits(votes, contigs, min_depth))
