"""Evidence for scaffold edges: strands, pooled thresholds, lifting; readers."""

from pyspark.sql import functions as F

from helixframe.functions.numeric import placements
from helixframe.operators import coverage as cv, edges as ed, links as lk
from helixframe.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


HITS = "read_id long, node long, q_start long, q_end long, t_start long, score long"


def test_long_reads_on_both_strands(spark):
    sizes = spark.createDataFrame([(1, 100), (2, 80)], "node long, len long")
    hits = spark.createDataFrame([
        (1, 1, 0, 90, 10, 5), (1, -2, 120, 200, 0, 5),        # 1 then 2 turned
        (2, 2, 0, 60, 0, 5), (2, -1, 100, 190, 10, 5),        # the same way, read from the other side
        (3, -1, 0, 90, 0, 5), (3, 2, 130, 200, 5, 5),         # 1 turned, then 2
    ], HITS)
    got = lk.long_read_links(hits, sizes, 1, 10)
    way = got.select((F.col("id1") * F.col("direction")).alias("a"), (F.col("id2") * F.col("direction")).alias("b"), "gap", "read_id")
    # a read seen from its other side gives the same edge
    assert rows(way, "read_id", "a", "b") == [(1, 1, -2), (2, 1, -2), (3, -1, 2)]
    # read 1: node 1 ends at 89, node 2 begins at 120
    assert rows(way.where("read_id = 1"), "gap") == [(30,)]
    # read 2: node 2 ends at 79; node 1 turned begins at 100 - (100 - 10 - 90)
    assert rows(way.where("read_id = 2"), "gap") == [(20,)]
    assert lk.long_read_links(hits.where("read_id = 1"), sizes, 2, 10).count() == 0


def test_pooled_evidence_has_one_threshold(spark):
    links = spark.createDataFrame([(1, 2, 10, 1, False), (-2, -1, 12, 1, False), (3, 4, 5, 1, False)], "id1 long, id2 long, gap long, score long, is_overlap boolean")
    ends = spark.createDataFrame([("x", 1), ("x", -2), ("y", 3), ("z", 5), ("z", -6), ("w", 5), ("w", -6), ("v", 5), ("v", -6)], "tag string, end long")
    got = lk.pooled_links(links, ends, 3)
    # two links and one common barcode; barcodes alone; one link and none is not enough
    assert rows(got, "id1", "id2", "n_link") == [(1, 2, 3), (5, 6, 3)]
    one = lk.pooled_links(links, None, 1)
    assert rows(one, "id1", "id2", "n_link") == [(1, 2, 2), (3, 4, 1)]
    assert ed.same_target(got).count() == 0


def test_rows_of_one_edge_are_not_rivals(spark):
    e = spark.createDataFrame([(1, 2, 5), (1, 2, 6), (1, -3, 4), (1, 3, 9)], "id1 long, id2 long, n_link long")
    assert rows(ed.same_target(e), "id1", "id2") == [(1, -3)]


def test_hits_and_barcodes_follow_their_contig(spark):
    parts = spark.createDataFrame([(7, 0, 1, 0, 100), (7, 1, -2, 120, 200)], "node long, idx int, contig long, start long, end long")
    hits = spark.createDataFrame([(1, 2, 0, 30, 10, 4), (1, -1, 40, 60, 5, 4)], HITS)
    assert rows(lk.lift_hits(hits, parts), "node", "t_start") == [(-7, 5), (-7, 160)]
    codes = spark.createDataFrame([("t", 2, 0), ("t", 1, 9)], "tag string, node long, pos long")
    assert rows(lk.lift_barcodes(codes, parts), "node", "pos") == [(7, 9), (7, 199)]


def test_sliding_windows_match_frames(spark):
    t = [(1, i, (i * 7919) % 13 + (30 if 40 < i < 70 else 0)) for i in range(160)] + [(2, i, 5) for i in range(9)]
    cover = spark.createDataFrame(t, "contig_id long, pos long, occ long")
    width, step = 6, 3
    want = []
    v = [x[2] for x in t if x[0] == 1]
    mean = lambda i: sum(v[i:i + width]) / width
    sd = lambda i: max(sum(x * x for x in v[i:i + width]) / width - mean(i) ** 2, 0) ** 0.5
    for i in range(160 - 2 * width - step + 1):
        j = i + width + step
        near = mean(i) * 1.5 >= mean(j) and mean(j) * 1.5 >= mean(i)
        if not near and abs(mean(i) - mean(j)) > max(sd(i), sd(j)) * 2.0:
            want.append((1, i))
    assert rows(cv.window_breaks(cover, width, step, 1.5), "contig_id", "pos") == want and want
    gaps = spark.createDataFrame([(1, i, 1) for i in range(0, 160, 3)], "node long, pos long, gap int")
    depth = cover.select(F.col("contig_id").alias("node"), "pos", F.col("occ").alias("depth"))
    got = {(r.node, r.pos): r.depth for r in cv.gap_rate_compensated(depth, gaps, 8).collect()}
    for node, i, d in t:
        n = [k for k in range(i - 4, i + 5) if 0 <= k < (160 if node == 1 else 9)]
        g = sum(1 for k in n if node == 1 and k % 3 == 0)
        assert got[node, i] == int(d * len(n) / (len(n) - g) + 0.5)


def test_placements_count_fragment_starts(spark):
    case = spark.createDataFrame([(500, 600, 50), (500, 600, -30), (20, 600, 10), (500, 600, 390), (60, 60, 100)], "a long, b long, g long")
    got = [r[0] for r in case.select(placements("a", "b", "g", 400, 100)).collect()]
    assert got == [251, 301, 71, 0, 0]


def test_paf_score_stands_anywhere(spark, tmp_path):
    base = "q\t10\t0\t9\t+\tt\t20\t1\t10\t8\t9\t60"
    (tmp_path / "a.paf").write_text(base + "".join(f"\tx{i}:i:{i}" for i in range(12)) + "\tAS:i:-77\n" + base + "\n")
    assert rows(readers.read_paf(spark, str(tmp_path / "a.paf")), "q_name", "score", "match") == [("q", -77, 8), ("q", 8, 8)]


def test_pairs_of_several_files(spark, tmp_path):
    for name, seqs in (("a_1", ["AC", "CC"]), ("b_1", ["GT"]), ("a_2", ["TT", "TA"]), ("b_2", ["GG"])):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{i}\n{s}\n+\nII\n" for i, s in enumerate(seqs)))
    read = lambda k: readers.read_fastq(spark, [str(tmp_path / f"{x}_{k}.fq") for x in "ab"])
    got = readers.paired_files(read(1), read(2))
    assert rows(got, "pair_id", "mate", "seq") == [(0, 0, "AC"), (0, 1, "TT"), (1, 0, "CC"), (1, 1, "TA"), (2, 0, "GT"), (2, 1, "GG")]


def trimmed_run(ids, size, factor):
    """The run of the majority label of one node, step by step."""
    total = {}
    for i, n in zip(ids, size):
        total[i] = total.get(i, 0) + (n if i else 0)
    label = min((k for k in total if k), key=lambda k: (-total[k], k))
    at = [i for i, x in enumerate(ids) if x == label]
    first, last = at[0], at[-1]

    def trim(order, keep):
        score = 0
        for i in order:
            if score > 0:
                score, keep = 0, i
            score += 0 if not ids[i] else -size[i] if ids[i] == label else size[i] * factor
        return keep
    first = trim(range(first, last + 1), first)
    return label, first, trim(range(last, first, -1), last)


def test_majority_run_drops_outweighed_ends(spark):
    import random

    from helixframe.operators import division as dv
    rng = random.Random(3)
    cases = {n: ([rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 30))]) for n in range(60)}
    cases = {n: ids if any(ids) else [1] for n, ids in cases.items()}
    size = {n: [rng.randrange(1, 50) for _ in ids] for n, ids in cases.items()}
    df = spark.createDataFrame([(n, i, x, size[n][i]) for n, ids in cases.items() for i, x in enumerate(ids)], "node long, idx int, label long, len long")
    for factor in (1.0, 2.0):
        got = {r.node: (r.label, r.first, r.last) for r in dv.majority_run(df, factor).collect()}
        assert got == {n: trimmed_run(ids, size[n], factor) for n, ids in cases.items()}
