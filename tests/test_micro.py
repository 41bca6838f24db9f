"""Hand-made cases and brute-force comparisons."""

import gzip
import os
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bases as b, numeric as nu
from helixframe.operators import (composition as cp, coverage as cv, dbg, division as dv, edges as ed, gapclose as gc, kmers as km,
                                  layout as ly, links as lk, mapping as mp, overlap as ov, scaffold as sc, skew)
from helixframe.plans import commands as cmd
from helixframe.session import materialize
from helixframe.sources import readers as rd, writers as wr


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def rand_seq(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def canon(s):
    return min(s, rc(s))


# --- sequence functions and k-mers -------------------------------------------------

def test_sql_functions(spark):
    b.register(spark)
    r = spark.sql("SELECT revcomp('AACGN') a, canonical_kmer('TTT') c, kmers('ACGNACG', 3) k, overlap_len('AACG', 'CGTT', 2) o, self_overlap('ACGTAC', 2) s").first()
    assert tuple(r) == ("NCGTT", "AAA", ["ACG", "ACG"], 2, 2)


@pytest.mark.parametrize("k", [5, 31, 33])
def test_kmers_match_brute_force(spark, k):
    seqs = [rand_seq(300, 1), "N" * 40, rand_seq(60, 2) + "NN" + rand_seq(70, 3), "ACG", rand_seq(k, 4), rc(rand_seq(300, 1))]
    want = Counter(canon(s[i:i + k]) for s in seqs for i in range(len(s) - k + 1) if "N" not in s[i:i + k])
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    t = km.count_kmers(km.kmer_rows(df, k))
    text = b.unpack("kmer", k) if k <= 31 else F.col("kmer")
    assert {r[0]: r[1] for r in t.select(text, "occ").collect()} == dict(want)
    assert sum(want.values()) == km.kmer_rows(df, k).count()


def test_long_sequences_are_cut_without_loss(spark):
    s = rand_seq(1000, 5)
    df = spark.createDataFrame([(1, s)], "read_id long, seq string")
    cut = km.cut_long(df, 9, piece=64)
    got = sorted((r["_off"], r["seq"]) for r in cut.collect())
    assert sorted(o + i for o, t in got for i in range(len(t) - 8)) == list(range(992))
    whole = km.kmer_rows(df, 9, keep=["read_id"], positions=True).select("pos", b.unpack("kmer", 9).alias("kmer"))
    assert {r["pos"]: r["kmer"] for r in whole.collect()} == {i: canon(s[i:i + 9]) for i in range(992)}


def test_words_from_the_end(spark):
    df = spark.createDataFrame([(1, rand_seq(37, 6))], "read_id long, seq string").withColumn("len", F.length("seq"))
    w = km.kmer_rows(df, 10, keep=["len"], positions=True, words="len")
    assert sorted(r["pos"] for r in w.collect()) == [0, 7, 17, 27]


def test_counts_saturate(spark):
    df = spark.range(70_000).select(F.lit(1).cast("bigint").alias("kmer"))
    assert km.count_kmers(df).first()["occ"] == 65534


@pytest.mark.parametrize("gaps,want", [([3], 3), ([-5, -2], -2), ([1, 2, 9], 2), ([1, 4], 2), ([-4, -4], -3), ([-3, -2, -1, 0], -1 + 1)])
def test_gap_median(spark, gaps, want):
    # even counts: halved towards zero, then plus one half cut towards zero
    df = spark.createDataFrame([(1, 2, g, 1) for g in gaps], "id1 int, id2 int, gap int, score int")
    assert lk.merge_links(df, 1).first()["gap"] == spark.range(1).select(nu.gap_median(F.array(*[F.lit(g) for g in gaps]))).first()[0] == want


# --- skew ---------------------------------------------------------------------------

def test_hot_keys_are_found_and_salted_join_keeps_rows(spark):
    many = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    hot = skew.hot_keys(many, F.col("k"), 0.1)
    assert hot == [7]
    one = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.join_unique(many, one, ["k"], hot=hot)
    assert got.count() == 9000 and got.where("k = 7").select("v").distinct().collect()[0][0] == 14


def test_blocked_scans_equal_plain_windows(spark):
    # one key holds almost all rows; small blocks are kept apart for the test
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    data = [(1 if i % 10 else 2, i, (i * 7) % 11) for i in range(500)]
    df = spark.createDataFrame(data, "k int, o int, v long").repartition(7)
    blocks = skew.ordered_blocks(df, ["k"], ["o"])
    assert blocks.select("_blk").distinct().count() > 1
    out = skew.running_sum(skew.lagged(blocks, ["k"], ["o"], {"v": "p"}), ["k"], ["o"], "v", "cum")
    ahead = skew.lagged(blocks, ["k"], ["o"], {"v": "n"}, ahead=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key in (1, 2):
        mine = [d for d in data if d[0] == key]
        total, prev = 0, None
        got = {r["o"]: (r["p"], r["cum"]) for r in out.where(F.col("k") == key).collect()}
        nxt = {r["o"]: r["n"] for r in ahead.where(F.col("k") == key).collect()}
        for i, (_, o, v) in enumerate(mine):
            total += v
            assert got[o] == (prev, total)
            assert nxt[o] == (mine[i + 1][2] if i + 1 < len(mine) else None)
            prev = v


@pytest.mark.parametrize("support", [2, 3])
def test_shared_groups_with_a_group_of_everything(spark, support):
    r = random.Random(3)
    inc = {(0, x) for x in range(60)} | {(g, r.randrange(60)) for g in range(1, 40) for _ in range(5)}
    by = defaultdict(set)
    for g, x in inc:
        by[x].add(g)
    want = sorted((x, y, len(by[x] & by[y])) for x, y in itertools.combinations(sorted(by), 2) if len(by[x] & by[y]) >= support)
    df = spark.createDataFrame(sorted(inc), "g int, x int")
    assert rows(lk.co_occurring(df, "g", "x", support), "id1", "id2", "common") == want


def test_results_do_not_depend_on_partitions(spark):
    seqs = [(i, rand_seq(200, i % 4)) for i in range(12)]
    seen = set()
    for n in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = spark.createDataFrame(seqs, "contig_id long, seq string").repartition(n)
        g = dbg.compact(dbg.as_segments(km.count_kmers(km.kmer_rows(df, 15)), 15), 15)
        seen.add(tuple(sorted((canon(r["seq"]), r["cov"]) for r in g.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


# --- de Bruijn graph ----------------------------------------------------------------

def graph(spark, seqs, k):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")
    return dbg.compact(dbg.as_segments(km.count_kmers(km.kmer_rows(df, k)), k), k)


def texts(segs):
    return sorted(canon(r["seq"]) for r in segs.where("not junction").collect())


def test_single_path_is_one_unitig(spark):
    s = rand_seq(300, 11)
    assert texts(graph(spark, [s], 21)) == [canon(s)]
    assert texts(graph(spark, [rc(s)], 21)) == [canon(s)]


def test_ring_is_opened_once(spark):
    s = rand_seq(90, 12)
    g = graph(spark, [s + s[:14]], 15).collect()
    assert len(g) == 1 and g[0]["n_kmer"] == 90 and len(g[0]["seq"]) == 104
    ring = s + s
    assert g[0]["seq"][:90] in ring + s or rc(g[0]["seq"])[:90] in ring + s


def test_tip_goes_and_chain_closes(spark):
    s = rand_seq(200, 13)
    tip = s[80:100] + ("A" if s[100] != "A" else "C") + "GT"
    g = graph(spark, [s] * 4 + [tip], 15)
    assert len(texts(g)) > 1
    assert texts(dbg.cut_tips(g, 15)) == [canon(s)]


def test_bubble_keeps_the_covered_arm(spark):
    s = rand_seq(200, 14)
    other = s[:100] + ("A" if s[100] != "A" else "C") + s[101:]
    g = graph(spark, [s] * 3 + [other], 15)
    arms = dbg.bubble_arms(g, 15, 0.05).collect()
    assert len(arms) == 1 and arms[0]["n_kmer"] == 15 and arms[0]["cov"] == 1
    assert texts(dbg.crush_bubbles(g, 15, 0.05)) == [canon(s)]
    # too different arms stay
    far = s[:90] + rand_seq(30, 99) + s[120:]
    assert dbg.bubble_arms(graph(spark, [s] * 3 + [far], 15), 15, 0.02).count() == 0


def test_scopes_stay_apart(spark):
    a, c = rand_seq(60, 15), rand_seq(60, 16)
    reads = spark.createDataFrame([("g1", a), ("g2", c), ("g2", a)], "gap_id string, seq string")
    s = gc.local_graph(reads, 15, 1)
    assert rows(s, "scope", "seq") == sorted([("g1", a), ("g2", c), ("g2", a)])


def test_assembly_of_two_genomes(spark):
    a, c = rand_seq(600, 21), rand_seq(500, 22)
    reads = []
    for g, step in ((a, 5), (c, 12)):
        for i in range(0, len(g) - 59, step):
            s = g[i:i + 60]
            reads.append(s if i % 2 else rc(s))
        reads.append(g[-60:])
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    out = cmd.assemble(df, ks=(25, 31), min_cov=1)
    assert texts(out.contigs) == sorted([canon(a), canon(c)])


# --- mapping, overlaps, containment -----------------------------------------------------

def test_tied_votes_are_unmapped(spark):
    a, c = rand_seq(60, 31), rand_seq(60, 32)
    contigs = spark.createDataFrame([(0, a), (1, c)], "contig_id long, seq string")
    reads = spark.createDataFrame([(0, a[10:20] + c[10:20]), (1, a[5:25]), (2, rc(c[20:50]))], "read_id long, seq string")
    got = {r["read_id"]: (r["id"], r["offset"]) for r in mp.map_by_votes(reads, contigs, 10).collect()}
    assert got == {1: (1, 5), 2: (-2, 49)}


def test_exact_overlaps_brute_force(spark):
    base = rand_seq(120, 33)
    seqs = [base[:60], base[40:100], rc(base[85:120]), "A" * 30, "A" * 25 + rand_seq(20, 34)]
    want = {}
    for i, j in itertools.combinations(range(len(seqs)), 2):
        for si, sj in itertools.product((1, -1), repeat=2):
            x, y = (seqs[i] if si > 0 else rc(seqs[i])), (seqs[j] if sj > 0 else rc(seqs[j]))
            n = max((n for n in range(12, min(len(x), len(y)) + 1) if x[-n:] == y[:n]), default=0)
            if n:
                want[((i + 1) * si, (j + 1) * sj)] = n
    df = spark.createDataFrame(list(enumerate(seqs)), "contig_id long, seq string")
    assert {(r["id1"], r["id2"]): r["length"] for r in ov.exact_overlaps(df, 12).collect()} == want


@pytest.mark.parametrize("prefix", [9, 10])
def test_containment_brute_force(spark, prefix):
    base = rand_seq(150, 35)
    seqs = [base, base[20:90], rc(base[100:140]), rand_seq(50, 36), rc(base), base, base[20:60], rc(base[20:60]), base[:30] + rand_seq(30, 37)]
    want = set()
    for j, s in enumerate(seqs):
        for i, t in enumerate(seqs):
            inside = s in t or rc(s) in t
            if i != j and inside and (len(t) > len(s) or (len(t) == len(s) and i < j)):
                want.add(j)
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    assert {r["id"] for r in ov.contained(df, prefix).collect()} == want


def test_pairs_make_links_and_inserts(spark):
    p = spark.createDataFrame([(1, 1, 10, -1, 200, 50), (2, 1, 90, -2, 30, 50), (3, 2, 5, 1, 7, 50), (4, -1, 10, 1, 200, 50)],
                              "pair_id int, f_id int, f_off int, r_id int, r_off int, min_len int")
    assert rows(mp.insert_lengths(p), "pair_id", "contig", "left", "insert") == [(1, 1, 10, 191)]
    assert rows(mp.pair_links(p), "pair_id", "id1", "off1", "id2", "off2") == [(2, 1, 90, 2, 30), (3, 1, 7, -2, 5)]


def test_greedy_suppression_brute_force(spark):
    r = random.Random(5)
    hits = [(read, i, s := r.randrange(400), s + r.randrange(20, 120), r.randrange(50)) for i, read in enumerate(x % 3 for x in range(60))]
    want = set()
    for read in range(3):
        kept = []
        mine = sorted((h for h in hits if h[0] == read), key=lambda h: (-h[4], -(h[3] - h[2]), h[1]))
        for h in mine:
            if all(min(h[3], k[3]) - max(h[2], k[2]) <= 10 for k in kept):
                kept.append(h)
        want |= {k[1] for k in kept}
    df = spark.createDataFrame(hits, "read_id int, hit long, q_start long, q_end long, score long")
    assert {x["hit"] for x in lk.suppress_greedy(df, 10).collect()} == want


def test_session_gaps(spark):
    pos = [0, 9_999, 19_999, 30_000, 30_000]
    df = spark.createDataFrame([(1, "a", p) for p in pos] + [(1, "b", 5)], "tag int, node string, pos long")
    assert rows(lk.sessions(df), "node", "first", "last", "n") == [("a", 0, 19_999, 3), ("a", 30_000, 30_000, 2), ("b", 5, 5, 1)]


# --- scaffold graph -----------------------------------------------------------------------

def edges_df(spark, data):
    return spark.createDataFrame(data, "id1 long, id2 long, gap long, n_link long")


def test_chain_with_ring_and_branch(spark):
    e = edges_df(spark, [(1, 2, 0, 5), (2, 3, 0, 5), (3, 4, 0, 5), (10, 11, 0, 5), (11, 12, 0, 5), (-12, -10, 0, 5), (20, 21, 0, 5), (20, 22, 0, 5)])
    got = defaultdict(list)
    for r in sc.path_joins(e).collect():
        got[r["head"]].append((r["dist"], r["node"]))
    chains = sorted(tuple(n for _, n in sorted(v)) for v in got.values())
    four = [c for c in chains if len(c) == 4]
    assert four in ([(1, 2, 3, 4)], [(-4, -3, -2, -1)])
    assert all(abs(n) < 20 for c in chains for n in c)
    joins = rows(sc.pair_joins(e), "u", "v")
    used = [abs(x) for p in joins for x in p]
    assert len(used) == len(set(used)) and (1, 2) in joins and (3, 4) in joins


@pytest.mark.parametrize("parallel,crossed,want", [(9, 1, {(1, 4), (2, 5)}), (3, 3, set()), (1, 9, {(1, 5), (2, 4)})])
def test_cross(spark, parallel, crossed, want):
    # 3 is the centre, 1 and 2 lie left, 4 and 5 right
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (3, 5)], "id1 long, id2 long")
    ev = spark.createDataFrame([(1, 4, parallel, 10), (2, 5, parallel, 10), (1, 5, crossed, 10), (2, 4, crossed, 10)], "id1 long, id2 long, n long, gap long")
    p = sc.resolved_crosses(sc.cross_evidence(sc.crosses(e), ev, "n"), 0.25, 2)
    assert {(r["left"], r["right"]) for r in p.collect()} == want
    # the mirrored graph gives the same joints
    m = spark.createDataFrame([(-3, -1), (-3, -2), (-4, -3), (-5, -3)], "id1 long, id2 long")
    q = sc.resolved_crosses(sc.cross_evidence(sc.crosses(m), ev, "n"), 0.25, 2)
    assert {(r["left"], r["right"]) for r in q.collect()} == want


def test_collisions(spark):
    nodes = spark.createDataFrame([(1, 1000), (2, 500), (3, 500), (4, 500)], "node long, len long")
    e = edges_df(spark, [(1, 2, 0, 20), (1, 3, 100, 3), (1, 4, 600, 3)])
    assert rows(ed.repeats(e, nodes, 50), "node") == [(1,)]
    assert rows(ed.weak_by_rate(e, nodes, 50), "id1", "id2") == [(1, 3)]
    apart = edges_df(spark, [(1, 2, 0, 20), (1, 4, 600, 3)])
    assert ed.repeats(apart, nodes, 50).count() == 0


def test_layout_grows_in_order_and_strand(spark):
    n = spark.createDataFrame([(i, 100, 0, False) for i in range(1, 6)], "node long, len long, cluster long, repeat boolean")
    e = edges_df(spark, [(1, 2, 10, 5), (2, -3, 20, 6), (-4, 3, 5, 4), (4, 5, 7, 1)])
    lay = sorted((r["start"], r["end"], r["node"]) for r in sc.grow_layouts(n, e, 5).collect())
    order = [x[2] for x in lay]
    assert order in ([1, 2, -3, 4, 5], [-5, -4, 3, -2, -1])
    assert all(a[1] <= c[0] for a, c in zip(lay, lay[1:]))
    apart = spark.createDataFrame([(i, 100, i % 2 + 1, False) for i in range(1, 6)], "node long, len long, cluster long, repeat boolean")
    assert sc.grow_layouts(apart, e, 5).select("scaffold").distinct().count() == 5


def test_split_drops_segments_without_own_contig(spark):
    p = spark.createDataFrame([(1, 0, 5, 0, 10), (1, 1, -6, 20, 30), (2, 0, 6, 0, 10), (2, 1, 7, 40, 50)], "node long, idx int, contig long, start long, end long")
    at = spark.createDataFrame([(2, 1)], "node long, idx int")
    every = dv.split_at(p, at)
    assert rows(every, "parent", "seg", "contig", "start") == [(1, 0, -6, 20), (1, 0, 5, 0), (2, 0, 6, 0), (2, 1, 7, 0)]
    out = dv.split_at(p, at, unique=True)
    assert rows(out, "parent", "seg", "contig", "start") == [(1, 0, -6, 20), (1, 0, 5, 0), (2, 1, 7, 0)]


@pytest.mark.parametrize("in_seed_order", [False, True])
def test_scaffold_from_pairs(spark, in_seed_order):
    g = rand_seq(3000, 41)
    cuts = [(0, 900), (960, 1900), (1960, 3000)]
    seqs = [g[a:c] for a, c in cuts]
    seqs[1] = rc(seqs[1])
    contigs = spark.createDataFrame([(i, s, 10) for i, s in enumerate(seqs)], "contig_id long, seq string, cov int")
    pairs = []
    for n, i in enumerate(range(0, len(g) - 400, 7)):
        pairs += [(n, 0, g[i:i + 60]), (n, 1, rc(g[i + 340:i + 400]))]
    p = spark.createDataFrame(pairs, "pair_id long, mate int, seq string")
    out = cmd.scaffold(contigs, p, seed=21, min_link=3, min_len=1, in_seed_order=in_seed_order)
    got = out.results.collect()
    assert len(got) == 1
    s = got[0]["seq"]
    s = s if s.startswith(g[:100]) else rc(s)
    known = [x for x in s.split("N") if x]
    assert known == [g[a:c] for a, c in cuts] and abs(len(s) - len(g)) < 30


def test_gaps_close_and_overlapping_flanks_shrink(spark):
    g = rand_seq(400, 42)
    scaffolds = spark.createDataFrame([(1, g[:150] + "N" * 12 + g[180:]), (2, g[:200] + "N" * 10 + g[195:])], "node long, seq string")
    reads = spark.createDataFrame([(i, g[p:p + 110]) for i, p in enumerate(range(100, 200, 9))], "read_id long, seq string")
    got = {r["node"]: r["seq"] for r in cmd.close_gaps(scaffolds, reads, word=21).collect()}
    assert got == {1: g, 2: g}


def test_consensus_agreement(spark):
    data = [(1, 4, "ACGT")] * 3 + [(1, 4, "ACGA"), (1, 3, "ACG"), (2, 3, "AAA"), (2, 4, "CCCC"), (3, 0, ""), (3, 0, "")]
    df = spark.createDataFrame(data, "gap_id int, length long, seq string")
    assert rows(gc.consensus(df, 0.66), "gap_id", "length", "seq") == [(1, 4, "ACGT"), (3, 0, "")]


def test_masks_and_unknown_runs(spark):
    df = spark.createDataFrame([(1, "NNACGTNACN"), (2, "ACGT"), (3, "NNN")], "node long, seq string")
    assert rows(cv.unknown_runs(df), "node", "s", "e") == [(1, 0, 2), (1, 6, 7), (1, 9, 10), (3, 0, 3)]
    assert rows(df.select(b.trim_unknown("seq").alias("s")), "s") == [("",), ("ACGT",), ("ACGTNAC",)]
    m = spark.createDataFrame([(2, 1, 3)], "node long, s long, e long")
    assert rows(cv.hidden(df, m), "node", "seq") == [(1, "NNACGTNACN"), (2, "ANNT"), (3, "NNN")]


# --- composition --------------------------------------------------------------------------

def test_upgma_brute_force(spark):
    r = random.Random(8)
    pts = {i: (r.random(), r.random()) for i in range(9)}
    w = {i: r.randrange(1, 5) for i in pts}
    dist = {(i, j): ((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) ** 0.5 for i, j in itertools.combinations(pts, 2)}
    d, n, heights = dict(dist), dict(w), []
    while d:
        (a, c), h = min(d.items(), key=lambda x: x[1])
        heights.append(round(h / 2, 9))
        new = (a, c)
        get = lambda x, y: d[(x, y)] if (x, y) in d else d[(y, x)]
        others = [x for x in n if x not in (a, c)]
        nd = {k: v for k, v in d.items() if a not in k and c not in k}
        for x in others:
            nd[(x, new)] = (n[a] * get(a, x) + n[c] * get(c, x)) / (n[a] + n[c])
        n[new] = n.pop(a) + n.pop(c)
        d = nd
    t = cp.upgma(spark.createDataFrame([(i, j, v) for (i, j), v in dist.items()], "id1 long, id2 long, distance double"),
                 spark.createDataFrame(list(w.items()), "id long, weight long"))
    assert sorted(round(x["height"], 9) for x in t.collect()) == sorted(heights)
    assert cp.newick(t).count(",") == 8


# --- files --------------------------------------------------------------------------------

def test_fasta_and_fastq_files(spark, tmp_path):
    seqs = [("r%d" % i, rand_seq(50 + i, i)) for i in range(40)]
    fa = tmp_path / "a.fa"
    fa.write_text("".join(f">{n} BX:Z:AC{n}\n{s[:30]}\n{s[30:].lower()}\n" for n, s in seqs))
    got = rd.with_barcode(rd.read_fasta(spark, str(fa)))
    assert {r["name"].split()[0]: (r["seq"], r["barcode"]) for r in got.collect()} == {n: (s, "AC" + n) for n, s in seqs}
    fq = tmp_path / "a.fq.gz"
    with gzip.open(fq, "wt") as f:
        f.writelines(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in seqs)
    q = rd.read_fastq(spark, str(fq))
    assert [(r["name"], r["seq"]) for r in q.orderBy("ord").collect()] == seqs
    assert rd.sniff_format(spark, str(fq)) == "FASTQ" and rd.sniff_format(spark, str(fa)) == "FASTA"
    assert rd.sniff_quality_offset(q) == 64 and rd.parse_size("1.5k") == 1500
    pairs = rd.interleaved_pairs(q)
    assert pairs.groupBy("pair_id").count().where("count = 2").count() == 20


def test_large_fastq_is_split_and_kept_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    fq = tmp_path / "b.fq"
    want = [("r%d" % i, rand_seq(80, i)) for i in range(200)]
    fq.write_text("".join(f"@{n}\n{s}\n+\n{'#' * 80}\n" for n, s in want))
    q = rd.read_fastq(spark, str(fq))
    got = [(r["name"], r["seq"]) for r in q.orderBy("ord").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    assert rd.sniff_quality_offset(q) == 33


def test_genes_and_coding_sequence(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("# c1\n# gc = 0.5\n# self: b\ngene_1\t1\t9\t+\t0\t11\ngene_2\t10\t18\t-\t0\t11\n# c2\n# gc = 0.4\n# self: a\n")
    g = rd.read_genes(spark, str(f))
    seq = rand_seq(30, 50)
    c = spark.createDataFrame([("c1", seq)], "name string, seq string")
    assert rows(rd.coding_sequence(g, c), "contig", "cds") == [("c1", seq[:9] + "NNN" + rc(seq[9:18]))]


def test_paf_and_table_files(spark, tmp_path):
    f = tmp_path / "a.paf"
    f.write_text("q1\t100\t0\t90\t+\tc1\t500\t10\t100\t85\t90\t60\ttp:A:P\tAS:i:77\nq2\t100\t0\t90\t-\tc1\t500\t10\t100\t85\t90\t60\n")
    assert rows(rd.read_paf(spark, str(f)), "q_name", "strand", "score") == [("q1", "+", 77), ("q2", "-", 85)]
    recs = spark.createDataFrame([("s1", "ACGT" * 30, 1), ("s2", "AC", 0)], "name string, seq string, cluster_id int")
    wr.write_fasta(recs, str(tmp_path / "out"), min_len=3)
    assert rows(rd.read_fasta(spark, str(tmp_path / "out")), "name", "seq") == [("s1", "ACGT" * 30)]
    wr.write_by_cluster(recs, str(tmp_path / "bins"))
    assert sorted(p.name for p in (tmp_path / "bins").iterdir() if p.is_dir()) == ["cluster=1", "cluster=unclassified"]


def test_stages_are_taken_up_again(spark, tmp_path):
    p = cmd.Pipeline(spark, str(tmp_path / "run"), skip=["b"])
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    assert p.stage("a", make).count() == 3 and p.stage("a", make).count() == 3 and len(calls) == 1
    assert p.stage("b", make) is None


def test_running_counts(spark, tmp_path):
    from helixframe.streaming.counts import running_counts
    src = tmp_path / "in"
    spark.createDataFrame([("ACGTACGT",), ("ACGTT",)], "seq string").write.parquet(str(src))
    stream = spark.readStream.schema("seq string").parquet(str(src))
    q = running_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName("kc").start()
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: r["occ"] for r in spark.table("kc").select(b.unpack("kmer", 4).alias("k"), "occ").collect()}
    assert got == dict(Counter(canon(s[i:i + 4]) for s in ("ACGTACGT", "ACGTT") for i in range(len(s) - 3)))


def test_phase_and_cluster_fill(spark):
    n = spark.createDataFrame([(1, 10.0, 100), (2, 9.0, 100), (3, 5.0, 100), (4, 10.0, 100)], "node long, cov double, len long")
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "id1 long, id2 long")
    assert rows(cmd.phase(None, e, n), "node", "opposite", "primary") == [(2, 3, True), (3, 2, False)]
    g = rand_seq(500, 61)
    reads = spark.createDataFrame([(i, g[p:p + 110]) for i, p in enumerate(range(0, 390, 4))], "read_id long, seq string")
    s = spark.createDataFrame([(1, g[:200] + "N" * 9 + g[230:], 1), (2, g[300:380], 1), (3, g[300:380], 2)], "node long, seq string, cluster long")
    got = {r["node"]: r["seq"] for r in cmd.cluster_fill(s, reads, word=21, prefix=21).collect()}
    assert got == {1: g, 3: g[300:380]}


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes more than a minute")
def test_iterate_rebuilds_a_genome(spark):
    g = rand_seq(900, 62)
    contigs = spark.createDataFrame([(0, g[:400], 5), (1, rc(g[430:]), 5)], "contig_id long, seq string, cov int")
    reads = spark.createDataFrame([(i, g[p:p + 110]) for i, p in enumerate(range(0, 790, 4))], "read_id long, seq string")
    pairs = [x for n, i in enumerate(range(0, 600, 4)) for x in ((n, 0, g[i:i + 50]), (n, 1, rc(g[i + 250:i + 300])))]
    out = cmd.iterate(contigs, reads, spark.createDataFrame(pairs, "pair_id long, mate int, seq string"), k=25, rounds=1).collect()
    assert [canon(r["seq"]) for r in out] == [canon(g)]
