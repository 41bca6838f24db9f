"""Vectors, mixing and packing against brute force."""

import heapq
import itertools

import numpy as np
import pytest
from llm_cases import DOC, groups, prose

from helixframe.llm import embed_dedup, mix, packing, tables
from pyspark.sql import functions as F
import random


def brute(rows, threshold):
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for (i, u), (j, v) in itertools.combinations(ok, 2):
        if len(u) == len(v):
            u_, v_ = np.array(u), np.array(v)
            if u_ @ v_ / np.sqrt((u_ @ u_) * (v_ @ v_)) >= threshold:
                links.append((i, j))
    group = groups([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], group[i], group[i] == i) for i in n}


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    centre = rng.normal(size=(12, 24))
    for c in centre:
        rows += [c + rng.normal(scale=s, size=24) for s in (0, 0, 0.05, 0.1, 0.2, 0.25, 0.3, 0.33, 0.36, 0.5)]
    rows += [centre[0] + rng.normal(scale=0.15, size=24) for _ in range(150)]      # one large group
    rows += [centre[0] * 1e30, centre[1] * 1e-30, -centre[2]]
    rows = [[float(x) for x in np.float32(r)] for r in rows]
    rows += [[1.0, 0.0], [2.0, 0.0], [1.0, 0.1], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, None, [], [None, 1.0]]
    table = [(1000 - i, r, 1) for i, r in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df).collect()}
    want = brute([(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v, _ in table], 0.95)
    assert got == want
    assert sum(v[0] for v in want.values()) > 1000


def test_near_vectors_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8, 10))[rng.integers(0, 8, 160)] + rng.normal(scale=0.25, size=(160, 10))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df, threshold=0.9).collect()}
    assert got == brute(rows, 0.9)


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(df).collect() == []
    assert [tuple(r) for r in embed_dedup.near_vectors(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).collect()] == [(3, 0, 3, True)]


def test_near_vectors_with_repeated_and_missing_ids(spark):
    """The smallest id of one class may be that of another; rows count by themselves."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 8))
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.01, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.001])]
    rows += [(int(rng.integers(20, 35)) if rng.random() < 0.8 else None, [float(x) for x in base[k] + rng.normal(scale=0.1, size=8) * (rng.random() < 0.6)])
             for k in rng.integers(0, 6, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    numbered = brute(list(enumerate(v for _, v in rows)), 0.95)
    lowest = {}
    for i, (_, root, _) in numbered.items():
        lowest.setdefault(root, []).append(rows[i][0])
    lowest = {root: min((x for x in ids if x is not None), default=None) for root, ids in lowest.items()}
    want = []
    for i, (n, root, _) in numbered.items():
        own, low = rows[i][0], lowest[root]
        want.append((own, n, low, True if own is None or low is None else own == low))
    got = [tuple(r) for r in embed_dedup.near_vectors(df).collect()]
    order = lambda x: repr(x)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert (4, 2, 1, False) in got and (3, 2, 1, False) in got and (9, 2, 9, True) in got


def test_pairs_of_tiles_are_not_shuffled(spark, monkeypatch):
    """Vectors travel once, with 4 bytes a number where that loses nothing."""
    monkeypatch.setattr(embed_dedup, "TILE", 15)
    plans, keep = {}, embed_dedup.stored
    monkeypatch.setattr(embed_dedup, "stored", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), keep(df, label))[1])
    sizes, pack = [], embed_dedup._tiles
    monkeypatch.setattr(embed_dedup, "_tiles", lambda *a: (t := pack(*a), sizes.extend((r.dim, len(r.sizes) // 8, len(r.data)) for r in t.collect()))[0])
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=(9, 6))[rng.integers(0, 9, 120)] + rng.normal(scale=0.2, size=(120, 6))).astype(float)
    y = rng.normal(size=(3, 5))[rng.integers(0, 3, 40)] + rng.normal(scale=0.1, size=(40, 5))
    rows = list(enumerate([list(map(float, r)) for r in [*x, *x[:30], *y, *y[:5], *(np.float32(y[:5]).astype(float))]]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df, threshold=0.9).collect()}
    assert got == brute(rows, 0.9)
    assert "CartesianProduct" in plans["links"] and "Exchange" not in plans["links"]
    assert plans["tiles"].count("Exchange hashpartitioning") == 1
    assert {n for d, n, b in sizes} != {1} and all(b == 4 * d * n for d, n, b in sizes if d == 6) and any(b == 8 * d * n for d, n, b in sizes if d == 5)


def test_step_tables_leave_no_shuffle_files(spark):
    made = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = lambda: {f for f in (str(x) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(made())) if "shuffle_" in f}
    before = files()
    kept = tables.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert not files() - before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    u, v = (embed_dedup.unit(rng.normal(size=(300, 40)) * rng.exponential(size=(1, 40))) for _ in range(2))
    (cu, su, lu, eu), (cv, sv, lv, ev) = embed_dedup.quantise(u), embed_dedup.quantise(v)
    near = (cu.astype(float) @ cv.T) * np.outer(su, sv)
    bound = np.outer(lu, ev) + np.outer(eu, lv) + np.outer(eu, ev)
    assert (np.abs(u @ v.T - near) <= bound + 1e-12).all()
    assert bound.max() < 0.05


def seats(votes, n):
    won = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(n):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague(spark, seed):
    rng = random.Random(seed)
    parties = []
    for g in range(4):
        n = rng.choice([1, 3, 20, 60])
        total = rng.choice([0, 1, 5, 40, 1000])
        votes = [rng.choice([0, 1, 7, 7, rng.randrange(1, 10_000)]) for _ in range(n)]
        total = total if any(votes) else 0
        parties += [(g, i, float(v), total) for i, v in enumerate(votes)]
    df = spark.createDataFrame(parties, "g int, i int, votes double, seats long")
    got = {(r.g, r.i): r.quota for r in mix.sainte_lague(df, "votes", "seats", ["i"], ["g"]).collect()}
    for g in range(4):
        own = [p for p in parties if p[0] == g]
        assert [got[g, p[1]] for p in own] == seats([p[2] for p in own], own[0][3])


def shares(size, weights=(5, 2, 1)):
    """Targets by resharing the excess again and again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        open_ = [s for s in names if s not in full]
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > 3 * size[s]}
        if not over:
            return t | {s: 3.0 * size[s] for s in full}
        full |= over


def mix_case(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        source = None if i % 17 == 0 else "big" if i % 3 == 0 else f"s{i % 8}"
        n = 0 if i % 23 == 0 else rng.randrange(1, 900 if source == "big" else 300 if source != "s5" else 12)
        rows.append((i, None if i == 46 else prose(rng, n), "en", source, n))
    rows.append(rows[30])
    return rows, spark.createDataFrame(rows, DOC)


def test_mix(spark):
    rows, docs = mix_case(spark)
    got = [r for r in mix.plan(docs.repartition(5), ["doc_id", "source"], shard_words=3000).collect()]
    again = [r for r in mix.plan(docs.repartition(2), ["doc_id", "source"], shard_words=3000).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = {}
    for r in got:
        size[r.doc.source] = size.get(r.doc.source, 0) + r.size
    want = shares(size)
    for s in size:
        mine = [r for r in got if r.doc.source == s]
        assert all(r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + sum(p.b - p.a for p in r.parts) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 64 * (1 + len(mine) // 20), s
    assert mix.plan(docs.limit(0), ["doc_id"]).collect() == []


def test_mixed_texts(spark):
    rows, docs = mix_case(spark)
    plan = {}
    for r in mix.plan(docs, ["doc_id"]).collect():
        plan[r.doc.doc_id] = plan.get(r.doc.doc_id, 0) + r.taken
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    taken = {}
    text = {r[0]: r[1] for r in rows}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
    assert taken == {i: n for i, n in plan.items() if n}


def padding(lengths, borders):
    return sum(min(b for b in borders if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(5))
def test_optimal_borders(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 9), rng.randrange(1, 60)]) for _ in range(40)]
    kinds = sorted(set(lengths))[:11]
    lengths = [n for n in lengths if n in kinds]
    count = np.array([lengths.count(k) for k in kinds])
    total = count * np.array(kinds)
    for k in range(1, 5):
        best = min(padding(lengths, [*c, kinds[-1]]) for c in itertools.combinations(kinds[:-1], min(k, len(kinds)) - 1))
        got = packing.borders(np.array(kinds), count, total, k)
        assert len(got) <= k and padding(lengths, got) == best


def test_pack(spark):
    rng = random.Random(3)
    texts = [None, "", *[prose(rng, rng.choice([5, 30, rng.randrange(1, 400)])) for _ in range(300)], prose(rng, 3000)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumnRenamed("lang", "bucket")
    got = packing.pack(docs.repartition(4), docs.columns, buckets=5, budget=1000, shard_rows=20).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.n_tokens == len((r.doc.text or "").split()) <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for key, b in batches.items():
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) * b[0].bucket_len <= 1000 or len(b) == 1
    for bucket in {k[0] for k in batches}:
        sizes = [len(b) for k, b in sorted(batches.items()) if k[0] == bucket]
        assert all(s == sizes[0] for s in sizes[:-1]) and sizes[-1] <= sizes[0]
    assert packing.pack(docs.limit(0), ["doc_id"]).collect() == []


def test_very_long_document_leaves_borders_optimal(spark):
    rng = random.Random(8)
    lengths = [min(int(rng.lognormvariate(5, 1)), 4096) for _ in range(500)]
    for longest in ([], [400_000], [2_000_000, 9_000]):
        all_ = lengths + longest
        kinds = sorted(set(all_))
        count = np.array([all_.count(k) for k in kinds])
        best = packing.borders(np.array(kinds), count, count * np.array(kinds), 6)
        docs = spark.createDataFrame([(i, "", "en", "s", n) for i, n in enumerate(all_)], DOC)
        got = packing.pack(docs, ["doc_id"], tokens=F.col("n_chars"), buckets=6).collect()
        assert len(got) == len(all_) and all(r.n_tokens <= r.bucket_len for r in got)
        assert sum(r.bucket_len - r.n_tokens for r in got) == padding(all_, best)


def test_histogram_groups_only_the_tail(spark):
    lengths = [0, 1, 4095, 4096, 4096, 4097, 4112, 4113, 8192, 8193, 8224, 8225, 2_000_000_000, 2_000_000_001]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    top, n, total = packing.histogram(df)
    assert list(zip(top, n, total)) == [
        (0, 1, 0), (1, 1, 1), (4095, 1, 4095), (4096, 2, 8192), (4112, 2, 8209), (4113, 1, 4113), (8192, 1, 8192),
        (8224, 2, 16417), (8225, 1, 8225), (2_000_000_001, 2, 4_000_000_001)]
    top, n, total = packing.histogram(df.where("n_tokens < 0"))
    assert len(top) == len(n) == len(total) == 0
