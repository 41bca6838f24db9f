"""Gapped alignment, polishing and bubble merging against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from helixframe.operators import align, bubble_merge, polish

FLIP = str.maketrans("ACGT", "TGCA")


def full_table(a, b, diagonal, band, inside):
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if abs(j - (i - diagonal)) > band:
                continue
            ways = [0] if j == 0 else []
            if j and (i - 1, j - 1) in best:
                ways.append(best[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] != "N" else -1))
            if j and (i - 1, j) in best:
                ways.append(best[i - 1, j] - 2)
            if j and (i, j - 1) in best:
                ways.append(best[i, j - 1] - 2)
            if ways:
                best[i, j] = max(ways)
    return max((v for (i, j), v in best.items() if (j == len(b) if inside else i == len(a))), default=None)


def changed(rng, text, n):
    b = list(text)
    for _ in range(n):
        k = rng.randrange(len(b) + 1)
        op = rng.random()
        if op < 0.3 and b:
            b.pop(min(k, len(b) - 1))
        elif op < 0.6:
            b.insert(k, rng.choice("ACGT"))
        elif b:
            b[min(k, len(b) - 1)] = rng.choice("ACGT")
    return "".join(b)


@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize("band", [0, 3, 70])
def test_band_equals_full_table(inside, band):
    rng = random.Random(band)
    rows = []
    for _ in range(150):
        t = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 50)))
        s = rng.randrange(len(t))
        rows.append((t, changed(rng, t[s:] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(9))), rng.randrange(5)), max(0, s + rng.randrange(-2, 3))))
    a, b, d = zip(*rows)
    score, start, a_end, b_end, moves = align.band_alignment(pa.array(a), pa.array(b), np.array(d), band, inside)
    for k, (x, y, diagonal) in enumerate(rows):
        want = full_table(x, y, diagonal, band, inside)
        if want is None:
            assert score[k] < -10**6
            continue
        assert score[k] == want
        i, j, told = start[k], 0, 0
        for c in bytes(moves[k][moves[k] != 0]).decode():
            if c in "=X":
                assert (x[i] == y[j] != "N") == (c == "=")
            told += {"=": 1, "X": -1, "D": -2, "I": -2}[c]
            i, j = i + (c != "I"), j + (c != "D")
        assert (i, j, told) == (a_end[k], b_end[k], want)


def test_end_alignments(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(1, text[:300], text[250:], 250), (2, text[:300], text[250:270] + text[271:], 252), (3, text[:300], text[250:270] + "A" + text[270:], 249),
            (4, text[:100], text[200:], 60), (5, None, "ACGT", 0), (6, "ACGT", "", 2), (7, "", "ACGT", 0)]
    got = {r.k: r for r in align.end_alignments(spark.createDataFrame(rows, "k int, a string, b string, diagonal int"), 5, 20, 0.1).collect()}
    assert set(got) == {1, 2, 3}
    assert [(got[k].a_start, got[k].b_end, got[k].edits) for k in (1, 2, 3)] == [(250, 50, 0), (250, 49, 1), (250, 51, 1)]
    assert got[1].moves == "=" * 50 and got[2].moves.count("D") == 1 and got[3].moves.count("I") == 1


def test_polish_restores_the_text(spark):
    """Noisy reads, both strands, a contig that holds most reads, one without any."""
    rng = random.Random(3)
    truth = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in ((1, 9000), (2, 700), (3, 300))}
    draft, reads = {}, []
    for c, t in truth.items():
        b, k = list(t), 60
        while k < len(t) - 60:
            b[k] = rng.choice(["", "ACGT"[("ACGT".index(t[k]) + 1) % 4], t[k] + rng.choice("ACGT"), t[k] + "GAT"])
            k += rng.randrange(25, 90)
        draft[c] = "".join(b) if c < 3 else t
        if c == 3:
            continue
        back = np.cumsum([0, *map(len, b)])
        for _ in range(len(t) // 5 * (1 if c == 1 else 2)):
            s = rng.randrange(-60, len(t) - 40)
            e = min(len(t), s + rng.randrange(90, 140))
            s = max(s, 0)
            r = changed(rng, t[s:e], rng.randrange(3))
            turn = rng.random() < 0.5
            reads.append((c, int(back[s]) + rng.randrange(-3, 4), -1 if turn else 1, r[::-1].translate(FLIP) if turn else r))
    reads += [(1, 5, 1, ""), (1, 10**6, 1, "ACGT" * 20), (99, 0, 1, "ACGT"), (1, 4000, 1, "T" * 100)]
    contigs = spark.createDataFrame(list(draft.items()), "contig long, seq string")
    placed = spark.createDataFrame(reads, "contig long, pos int, strand int, read string").repartition(4)
    got = {r.contig: r.seq for r in polish.polish(contigs, placed, band=10, margin=5).collect()}
    assert set(got) == set(truth)
    for c in truth:
        assert got[c][40:-40] == truth[c][40:-40] or got[c] == truth[c], c


def test_edits_and_new_places(spark):
    contigs = spark.createDataFrame([(1, "A" * 1500 + "C" * 800)], "contig long, seq string")
    rows = [(1, 10, 0, "-"), (1, 1023, 1, "G"), (1, 1023, 2, "T"), (1, 1500, 0, "T"), (1, 2299, 0, "-")]
    e = spark.createDataFrame(rows, "contig long, pos long, slot int, base string")
    want = "A" * 1023 + "GT" + "A" * 476 + "T" + "C" * 798
    assert polish.apply_edits(contigs, e).collect()[0].seq == want
    got = sorted((r.pos, r.slot, r.new_pos) for r in polish.rebased(e).collect())
    assert got == [(10, 0, 10), (1023, 1, 1023), (1023, 2, 1024), (1500, 0, 1501), (2299, 0, 2300)]
    assert want[1023:1025] == "GT" and want[1501] == "T"
    assert polish.apply_edits(contigs, e.limit(0)).collect()[0].seq == "A" * 1500 + "C" * 800


def longest(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_parts_are_a_longest_chain():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(1, 8) * rng.choice((1, -1)) for _ in range(rng.randrange(12))] for _ in range(2))
        m = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y]
        got = bubble_merge.common_parts([i for i, _ in m], [j for _, j in m])
        assert len(got) == longest(a, b) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:])) and set(got) <= set(m)


def test_merge_arms(spark):
    layouts = {1: [(10, 5), (11, 9), (12, 5), (13, 5), (14, 5)], 2: [(10, 5), (21, 3), (22, 3), (12, 5), (14, 5)],       # fork, then a part that one arm skips
               3: [(30, 5), (31, 2), (32, 5)], 4: [(-32, 5), (-41, 7), (-30, 5)],                                         # turned, second arm wins
               5: [(50, 50), (51, 2), (52, 5)], 6: [(50, 50), (61, 2), (52, 5)],                                          # shared part covered too well
               7: [(70, 5), (71, 2)], 8: [(70, 5), (81, 2)],                                                              # no shared end
               9: [(90, 5), (91, 2), (90, 5)], 100: [(90, 5), (92, 2), (90, 5)],                                          # the same contig on both ends
               11: [(110, 5), (111, 5)], 12: [(110, 5), (111, 5)]}                                                        # nothing to crush
    parts = spark.createDataFrame([(n, i, c, 100, v) for n, p in layouts.items() for i, (c, v) in enumerate(p)], "node long, idx int, contig long, len int, cov int")
    pairs = spark.createDataFrame([(1, 2), (3, -4), (5, 6), (7, 8), (9, 100), (11, 12)], "node long, opposite long")
    merged, crushed = bubble_merge.merge_arms(pairs, parts, 20, 20)
    got = {}
    for r in sorted(merged.collect(), key=lambda r: (r.node, r.idx)):
        got.setdefault(r.node, []).append((r.contig, r.arm, r.node_cov))
    assert got == {1: [(10, 0, 5.8), (11, 1, 5.8), (12, 0, 5.8), (13, 1, 5.8), (14, 0, 5.8)], 3: [(30, 0, 17 / 3), (41, 2, 17 / 3), (32, 0, 17 / 3)]}
    assert sorted((r.node, r.stretch, r.contig, r.arm) for r in crushed.collect()) == [(1, 1, 21, 2), (1, 1, 22, 2), (3, 1, 31, 1)]
    assert bubble_merge.merge_arms(pairs.limit(0), parts, 20, 20)[0].collect() == []


def test_merge_arms_deals_parts_once(spark):
    """Only arms travel and only pairs that merge are written: two exchanges of
    arms and one of pairs, whatever the steps behind them."""
    import glob
    from helixframe import session
    n = 400
    parts = [(node, i, 100 * (node // 2) + (c if node % 2 else d), 10, v) for node in range(2, 2 * n + 2) for i, (c, d, v) in enumerate([(1, 1, 5), (2, 3, 5 + node % 2), (4, 4, 5 if node < 12 else 50)])]
    pairs = [(node, node + 1) for node in range(2, 2 * n + 2, 2)]
    before = set(glob.glob(f"{session.work_dir(spark)}/*/*.parquet"))
    merged, crushed = bubble_merge.merge_arms(spark.createDataFrame(pairs, "node long, opposite long"), spark.createDataFrame(parts, "node long, idx int, contig long, len int, cov int"), 20, 20)
    assert {r.node for r in merged.collect()} == {r.node for r in crushed.collect()} == {2, 4, 6, 8, 10}
    assert sorted(r.contig for r in merged.where("node = 2").collect()) == [101, 102, 104]
    made = set(glob.glob(f"{session.work_dir(spark)}/*/*.parquet")) - before
    assert len({f.rsplit("/", 1)[0] for f in made}) == 1 and spark.read.parquet(*made).count() == 5
    for t in (merged, crushed):
        assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()


def test_merge_arms_with_parts_that_repeat(spark):
    layouts = {1: [(1, 5), (2, 5), (1, 5), (3, 9), (4, 5)], 2: [(1, 5), (2, 5), (5, 3), (4, 5)],        # a shared part comes twice in one arm
               3: [(1, 5), (4, 5), (2, 3), (4, 5)], 4: [(1, 5), (4, 5), (3, 4)]}                          # no chain ends at both last parts
    parts = spark.createDataFrame([(n, i, c, 10, v) for n, p in layouts.items() for i, (c, v) in enumerate(p)], "node long, idx int, contig long, len int, cov int")
    merged, crushed = bubble_merge.merge_arms(spark.createDataFrame([(1, 2), (3, 4)], "node long, opposite long"), parts, 20, 20)
    assert [(r.contig, r.arm) for r in sorted(merged.collect(), key=lambda r: r.idx)] == [(1, 0), (2, 0), (1, 1), (3, 1), (4, 0)]
    assert [(r.node, r.stretch, r.contig, r.arm) for r in crushed.collect()] == [(1, 2, 5, 2)]


def test_chains_over_bent_overlaps(spark):
    """Reads whose overlap holds a deletion or an insertion still close the gap,
    with the text of the earlier read; without a band they do not."""
    from helixframe.operators import gapclose as gc
    rng = random.Random(11)
    gaps, reads, want = [], [], {}
    for g in range(12):
        t = "".join(rng.choice("ACGT") for _ in range(160))
        first, second = t[5:100], t[50:160]
        if g % 3 == 0:
            first = t[5:80] + t[81:100]
        elif g % 3 == 1:
            first = t[5:80] + "ACGT"["ACGT".index(t[80]) - 1] + t[80:100]
        gaps.append((str(g), t[:40], t[130:]))
        reads += [(str(g), 2 * g, first), (str(g), 2 * g + 1, second)]
        want[str(g)] = first[35:] + t[100:130]
    gaps = spark.createDataFrame(gaps, "gap_id string, head string, tail string")
    reads = spark.createDataFrame(reads, "gap_id string, read_id bigint, seq string")
    got = {r["gap_id"]: (r["seq"], r["shrink"]) for r in gc.overlap_chains(gaps, reads, 15).collect()}
    assert got == {g: (s, 0) for g, s in want.items()}
    tight = {r["gap_id"] for r in gc.overlap_chains(gaps, reads, 15, max_miss=0.0).collect()}
    assert tight == {str(g) for g in range(2, 12, 3)}


def test_head_that_overlaps_its_tail(spark):
    from helixframe.operators import gapclose as gc
    rng = random.Random(12)
    t = "".join(rng.choice("ACGT") for _ in range(60))
    gaps = spark.createDataFrame([("g", t[:40], t[20:])], "gap_id string, head string, tail string")
    none = spark.createDataFrame([], "gap_id string, read_id bigint, seq string")
    assert [tuple(r) for r in gc.overlap_chains(gaps, none, 15).select("length", "seq", "shrink").collect()] == [(0, "", 20)]
