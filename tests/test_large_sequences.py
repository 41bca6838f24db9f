"""Cases of the third review on growth: each failed before its change."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bases as b
from helixframe.operators import composition as cp, coverage as cv, edges as ed, kmers as km, overlap as ov


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def sequences(spark, seed=3):
    r = random.Random(seed)
    base = "".join(r.choices("ACGT", k=2000))
    texts = ["".join(r.choices("ACGT", weights=(9, 3, 2, 2), k=r.randrange(0, 900))) for _ in range(30)]
    texts += [base, base, rc(base), "A" * 3000, "", "ACGTN" * 40, base[:700] + "N" + base[700:], "AC" * 400, "".join(r.choices("ACGT", k=70000))]
    texts += [base[:200]] * 30 + ["".join(r.choices("ACGT", k=150)) + base[:200] + "".join(r.choices("ACGT", k=150)) for _ in range(4)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "contig_id long, seq string").repartition(3)


def counted(texts, k):
    n = Counter()
    for t in texts:
        n.update(min(w, rc(w)) for w in (t[i:i + k] for i in range(len(t) - k + 1)) if "N" not in w)
    return n


def test_breaks_and_ends_without_a_row_for_each_window(spark, capsys):
    texts, df = sequences(spark)
    k, width, step = 10, 20, 6
    table = counted(texts, k)
    dense = km.dense_table(df, k)
    assert sorted(x for x in dense if x) == sorted(table.values())
    breaks, trims = [], []
    for c, t in enumerate(texts):
        v = {i: table[min(w, rc(w))] for i, w in ((i, t[i:i + k]) for i in range(len(t) - k + 1)) if "N" not in w}
        if v:
            med = sorted(v.values())[len(v) // 2]
            near = [i for i, x in v.items() if x * 2 >= med and med * 2 >= x]
            trims.append((c, min(near), max(near) + k))
        for p in range(len(t)):
            if all(p + i in v for i in range(2 * width + step)):
                one, two = [v[p + i] for i in range(width)], [v[p + width + step + i] for i in range(width)]
                m, m2 = sum(one) / width, sum(two) / width
                sd = [math.sqrt(max(sum(x * x for x in w) / width - mm * mm, 0)) for w, mm in ((one, m), (two, m2))]
                if not (m * 2 >= m2 and m2 * 2 >= m) and abs(m - m2) > max(sd) * 2:
                    breaks.append((c, p))
    got = cv.breaks_in_sequences(df, dense, k, width, step, 2.0)
    assert sorted(map(tuple, got.collect())) == breaks and breaks
    ends = cv.trims_in_sequences(df, dense, k, 2.0)
    assert sorted(map(tuple, ends.collect())) == trims
    for x in (got, ends):
        assert "hashpartitioning" not in plan_of(x, capsys)


@pytest.mark.parametrize("k", [9, 13, 25, 31, 33])
def test_counts_of_whole_sequences(spark, monkeypatch, capsys, k):
    monkeypatch.setattr(km, "PART", 3000)
    texts, df = sequences(spark)
    want = counted(texts, k)
    unpacked = lambda t: dict(map(tuple, t.select(b.unpack("kmer", k) if k < 32 else "kmer", "occ").collect()))
    t = km.count_sequences(df, k)
    assert unpacked(t) == want
    assert unpacked(km.count_sequences(df, k, min_occ=3)) == {w: n for w, n in want.items() if n >= 3}
    keys = km.kmer_rows(df.where("contig_id > 28"), k)
    asked = {w: want[w] for w in counted(texts[29:], k)}
    for travel in (1 << 20, 10):
        monkeypatch.setattr(km, "TRAVEL", travel)
        assert unpacked(km.count_among(df, keys, k)) == asked
    if 12 < k < 32:
        # runs of windows are exchanged once, and their keys not again
        assert plan_of(t, capsys).count("hashpartitioning") == 1


def test_a_common_word_and_copies_are_few_runs(spark):
    texts = ["A" * 20000, *["ACGTTGCATGCCATTGACCATGATACCATGA" * 30] * 200]
    df = spark.createDataFrame([(t,) for t in texts], "seq string").coalesce(1)
    runs = df.mapInArrow(km._stretches(25, 4, "seq"), "part int, n int, copies int, hi bigint, lo bigint")
    windows = sum(len(t) - 24 for t in texts)
    assert runs.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] == windows and runs.count() < 200


def test_reads_with_a_key_are_found_before_they_are_grouped(spark, capsys):
    texts, df = sequences(spark)
    reads = df.withColumnRenamed("contig_id", "read_id")
    keys = km.kmer_rows(df.where("contig_id = 30"), 15).limit(5)
    held = {r[0] for r in keys.select(b.unpack("kmer", 15)).collect()}
    got = km.reads_with(km.kmer_rows(reads, 15, keep=["read_id"]), F.broadcast(keys.localCheckpoint()))
    want = [i for i, t in enumerate(texts) if held & set(counted([t], 15))]
    assert sorted(r[0] for r in got.collect()) == want
    assert "hashpartitioning(read_id#" in plan_of(got, capsys) and ", kmer#" not in "".join(x for x in plan_of(got, capsys).splitlines() if "hashpartitioning" in x)


@pytest.mark.parametrize("tile", [7, 512])
def test_distances_of_tiles(spark, capsys, tile):
    r = random.Random(4)
    vectors = [(i * 3, [r.uniform(-1, 1) for _ in range(9)]) for i in range(60)]
    vectors += [(7, None), (8, [0.5] * 4), (10, [0.25] * 4), (11, [0.5, None, 1.0, 2.0]), (13, []), (14, vectors[3][1])]
    df = spark.createDataFrame(vectors, "id long, vec array<float>")
    known = {i: v for i, v in df.collect()}

    def distance(v, w):
        if v is None or w is None or len(v) != len(w) or None in v or None in w:
            return None
        s = 0.0
        for x, y in zip(v, w):
            s += (x - y) * (x - y)
        return math.sqrt(s)

    want = {(a, b): distance(known[a], known[b]) for a in known for b in known if a < b}
    m = cp.distance_matrix(df, "vec", tile=tile)
    got = m.collect()
    assert {(a, b): d for a, b, d in got} == want and len(got) == len(want)
    if tile == 7:
        # the tiles keep tasks of their own, however small they are
        assert m.rdd.getNumPartitions() > 8


def test_sequences_travel_once_to_their_distances(spark):
    """Pairs of groups are not dealt out; ids that repeat are cut into pieces of a group."""
    r = random.Random(6)
    vectors = [(r.choice((3, 3, 3, i)), [float(r.randrange(9)) for _ in range(r.choice((3, 3, 4)))]) for i in range(90)] + [(None, [1.0, 2.0, 3.0]), (4, [None, 2.0, 3.0])]
    df = spark.createDataFrame(vectors, "id int, vec array<double>").repartition(3)
    m = cp.distance_matrix(df, "vec", tile=6)
    want = sorted(((a, b, math.dist(v, w) if len(v) == len(w) and None not in v + w else None) for a, v in vectors for b, w in vectors
                   if a is not None and b is not None and a < b), key=str)
    got = sorted(map(tuple, m.collect()), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for (*_, x), (*_, y) in zip(got, want))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert m.schema["id1"].dataType.simpleString() == "int"


def test_distances_of_named_sequences(spark):
    df = spark.createDataFrame([("b", [0.0, 3.0]), ("a", [4.0, 0.0]), ("c", [0.0, 0.0])], "id string, vec array<double>")
    assert sorted(map(tuple, cp.distance_matrix(df, "vec").collect())) == [("a", "b", 5.0), ("a", "c", 4.0), ("b", "c", 3.0)]


def test_windows_of_wanted_keys_only_are_shuffled(spark, monkeypatch, capsys):
    texts, df = sequences(spark)
    keys = km.kmer_rows(df.where("contig_id in (3, 30)"), 15)
    held = {r[0] for r in keys.select(b.unpack("kmer", 15)).collect()}
    want = sorted((c, i, min(w, rc(w)), 1 if w <= rc(w) else -1) for c, t in enumerate(texts) for i, w in ((i, t[i:i + 15]) for i in range(len(t) - 14)) if min(w, rc(w)) in held)
    for bits in (28, 8):
        # few bits let other windows through to the exact join, and no more
        monkeypatch.setattr(km, "FILTER_BITS", bits)
        got = km.rows_among(df, keys, 15, keep=["contig_id"])
        assert sorted(map(tuple, got.select("contig_id", "pos", b.unpack("kmer", 15), "s").collect())) == want


def test_contained_texts_of_all_lengths(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ov, "rows_among", lambda df, wanted, *a, **k: made.append(wanted.count()) or km.rows_among(df, wanted, *a, **k))
    r = random.Random(6)
    base = ["".join(r.choices("ACGT", k=600)) for _ in range(20)]
    texts = [*base]
    for t in base:
        a, n = r.randrange(0, 300), r.randrange(25, 300)
        texts += [t[a:a + n], rc(t[a:a + n]), t[a:a + n][:-1] + ("A" if t[a + n - 1] != "A" else "C")]
    texts += [base[0], rc(base[1])]
    got = {x[0] for x in ov.contained(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), 15).collect()}
    want = {i for i, t in enumerate(texts) if any((len(u) > len(t) and (t in u or t in rc(u))) or (j < i and u in (t, rc(t))) for j, u in enumerate(texts))}
    assert got == want and len(made) == 1


@pytest.mark.parametrize("tolerance", [0, 20, 150])
def test_best_rivals_without_rows_of_pairs(spark, capsys, tolerance):
    r = random.Random(9)
    edges = [(1, r.choice((1, -1)) * (2 + i), r.randrange(-50, 3000), r.randrange(3, 40)) for i in range(150)]
    edges += [(1, 200 + i, 7, 5 + i % 2) for i in range(4)] + [(400, 401, 10, 9)]
    nodes = [(i, r.choice((0, 10, 100, 700, 5000))) for i in range(1, 402)]
    length = dict(nodes)
    half = ed.half_edges(spark.createDataFrame(edges, "id1 long, id2 long, gap long, n_link long"))
    best = ed.rival_best(half, spark.createDataFrame(nodes, "node long, len long"), tolerance, "n_link")
    seen = [(h["src"], h["dir"], h["gap"], length[abs(h["dst"])], h["n_link"], i) for i, h in enumerate(half.collect())]
    want = {}
    for s, d, g, n, _, i in seen:
        rivals = [w for s2, d2, g2, n2, w, j in seen if (s2, d2) == (s, d) and j != i and g + n - g2 > tolerance and g2 + n2 - g > tolerance]
        if rivals:
            want.setdefault((s, d, g, n), []).append(max(rivals))
    got = {tuple(x)[:4]: x["best"] for x in best.collect()}
    # a class of several edges also meets its own best
    assert got == {k: max(v) for k, v in want.items()} and got
    assert "Join" not in plan_of(best, capsys).split("FlatMapGroupsInArrow")[0]
