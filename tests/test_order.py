"""Rules that read like scans in order, and chains of seeds, against serial versions."""

import random

from helixframe.operators import edges as ed


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def graph(rng, n=14, m=40):
    """Edges, links on each part of either end, node lengths."""
    lengths = {i: rng.randrange(20, 200) for i in range(1, n + 1)}
    edges, parts = {}, {}
    for _ in range(m):
        a, b = sorted(rng.sample(range(1, n + 1), 2))
        if any((abs(x), abs(y)) == (a, b) for x, y in edges):
            continue
        e = (a * rng.choice((1, -1)), b * rng.choice((1, -1)))
        for side in (1, 2):
            split = [rng.randrange(0, 5) for _ in range(3)]
            split[0] += 1
            parts[e, side] = {p: k for p, k in enumerate(split) if k}
        total = max(sum(parts[e, s].values()) for s in (1, 2))
        for s in (1, 2):        # both sides split the same links
            parts[e, s][0] = parts[e, s].get(0, 0) + total - sum(parts[e, s].values())
        edges[e] = (rng.randrange(-20, 150), total)
    return edges, parts, lengths


def views(edges):
    out = {}
    for (x, y), (gap, n) in edges.items():
        s = (1 if x > 0 else -1) * (1 if y > 0 else -1)
        out.setdefault(abs(x), []).append(((1 if x > 0 else -1), abs(y) * s, (x, y), 1, gap, n))
        out.setdefault(abs(y), []).append(((-1 if y > 0 else 1), abs(x) * s, (x, y), 2, gap, n))
    return {k: sorted(v) for k, v in out.items()}


def collide(e, f, lengths, tolerance):
    return e[0] == f[0] and e[4] + lengths[abs(e[1])] - f[4] > tolerance and f[4] + lengths[abs(f[1])] - e[4] > tolerance


def serial_loss(edges, parts, lengths, tolerance, min_link, opposite, clear):
    bad, gone = set(), set()
    for node, half in views(edges).items():
        left = [h[5] for h in half]
        on = [dict(parts[h[2], h[3]]) for h in half]
        for i in range(len(half)):
            for j in range(i + 1, len(half)):
                hit = collide(half[i], half[j], lengths, tolerance)
                if not clear and not hit:
                    hit = abs(half[i][1]) == opposite.get(abs(half[j][1]))
                if not hit:
                    continue
                for p in range(3):
                    if clear:
                        if min(on[i].get(p, 0), on[j].get(p, 0)) < min_link:
                            continue
                        gone.add((node, p))
                        take = [o.get(p, 0) for o in on]
                    else:
                        take = [min(on[i].get(p, 0), on[j].get(p, 0))] * len(half)
                    for k in range(len(half)):
                        left[k] -= take[k]
                        on[k][p] = on[k].get(p, 0) - take[k]
        bad |= {h[2] for h, n in zip(half, left) if n < min_link}
    return sorted(bad), sorted(gone)


def test_repeat_edges_follow_the_serial_scan(spark):
    for seed in range(4):
        rng = random.Random(seed)
        edges, parts, lengths = graph(rng)
        arms = {1: 2, 2: 1, 5: 6, 6: 5} if seed % 2 else {}
        e = spark.createDataFrame([(x, y, g, n) for (x, y), (g, n) in edges.items()], "id1 long, id2 long, gap long, n_link long")
        p = spark.createDataFrame([(x, y, s, k, n) for ((x, y), s), v in parts.items() for k, n in v.items()], "id1 long, id2 long, side int, part int, n long")
        nd = spark.createDataFrame(list(lengths.items()), "node long, len long")
        b = spark.createDataFrame(list(arms.items()), "node long, opposite long") if arms else None
        want, _ = serial_loss(edges, parts, lengths, 10, 4, arms, False)
        assert rows(ed.repeat_edge_links(e, p, nd, 10, 4, b), "id1", "id2") == want
        want, gone = serial_loss(edges, parts, lengths, 10, 3, {}, True)
        cleared, bad = ed.repeat_parts(e, p, nd, 10, 3)
        assert rows(bad, "id1", "id2") == want
        assert rows(cleared, "src", "part") == gone
        assert 0 < len(want) <= len(edges)


def test_chain_of_three_colliding_edges(spark):
    """The pair (2, 3) takes 5 - 0, then (2, 4) gives 4 back, then (3, 4) nothing:
    one link is off every edge at the end, not five."""
    e = spark.createDataFrame([(1, 2, 0, 5), (1, 3, 0, 6), (1, 4, 0, 1)], "id1 long, id2 long, gap long, n_link long")
    p = spark.createDataFrame([(1, 2, 1, 0, 5), (1, 3, 1, 0, 6), (1, 4, 1, 0, 1)], "id1 long, id2 long, side int, part int, n long")
    nd = spark.createDataFrame([(i, 100) for i in range(1, 5)], "node long, len long")
    assert rows(ed.repeat_edge_links(e, p, nd, 5, 1), "id1", "id2") == [(1, 4)]
    assert rows(ed.repeat_edge_links(e, p, nd, 5, 5), "id1", "id2") == [(1, 2), (1, 4)]


def test_ways_equal_enumeration_and_the_normal_formula(spark):
    from pyspark.sql import functions as F
    from helixframe.functions.numeric import expected_links
    from helixframe.operators import stretches as gs
    rng = random.Random(5)
    parts, lengths = {}, {}
    for node in range(1, 9):
        at, parts[node] = rng.randrange(0, 4), []
        for _ in range(rng.randrange(1, 5)):
            size = rng.randrange(4, 30)
            parts[node].append((at, at + size))
            at += size + rng.choice((-2, 0, 0, 3, 9))
        lengths[node] = max(e for _, e in parts[node]) + rng.randrange(0, 3)
    inserts = {k: rng.randrange(1, 6) for k in (18, 19, 22, 25, 31, 40)}
    edges = [(a * rng.choice((1, -1)), b * rng.choice((1, -1)), rng.randrange(-5, 40)) for a in range(1, 8) for b in range(a + 1, 9)]
    r = 4

    def laid(node, shift):
        n, own = lengths[abs(node)], set()
        for s, e in parts[abs(node)]:
            own |= set(range(s, e)) if node > 0 else set(range(n - e, n - s))
        return {x + shift for x in own}

    want = []
    for a, b, gap in edges:
        one, two = laid(a, -lengths[abs(a)]), laid(b, gap)
        p = [x for x in one if all(x + i in one for i in range(r))]
        q = [x + r for x in two if all(x + i in two for i in range(r))]
        want.append((a, b, sum(inserts.get(y - x, 0) for x in p for y in q)))
    e = spark.createDataFrame(edges, "id1 long, id2 long, gap long")
    pt = spark.createDataFrame([(k, s, t) for k, v in parts.items() for s, t in v], "node long, start long, end long")
    ln = spark.createDataFrame(list(lengths.items()), "node long, len long")
    ins = spark.createDataFrame(list(inserts.items()), "insert long, n long")
    assert rows(gs.fragment_ways(e, gs.gapless_stretches(pt), ln, ins, r), "id1", "id2", "ways") == sorted(want)
    assert any(w for *_, w in want) and any(not w for *_, w in want)
    # nodes without gaps: the sum over inserts is the closed formula of a normal insert size
    import math
    bell = [(x, round(1e6 * math.exp(-((x - 350) / 40) ** 2 / 2))) for x in range(100, 601)]
    whole = spark.createDataFrame([(1, 0, 900), (2, 0, 700)], "node long, start long, end long")
    one = spark.createDataFrame([(1, 2, 30, 20.0, 3)], "id1 long, id2 long, gap long, cov double, n_link long")
    got = gs.expected_over_stretches(one, whole, whole.select("node", F.col("end").alias("len")), spark.createDataFrame(bell, "insert long, n long"), 100)
    x = got.withColumn("y", expected_links(F.lit(20.0), F.lit(900), F.lit(700), F.col("gap"), F.lit(350), F.lit(40.0), F.lit(100))).first()
    assert abs(x["expected"] - x["y"]) < 0.02 * x["y"]
    assert gs.below_gapless_expectation(got).count() == 1
    assert gs.below_gapless_expectation(got.withColumn("n_link", F.lit(100))).count() == 0


def test_longest_rise_is_longest():
    from itertools import combinations
    import numpy as np
    from helixframe.operators.chain import longest_rise
    rng = random.Random(2)
    for n in range(9):
        t = [rng.randrange(6) for _ in range(n)]
        got = longest_rise(np.array(t))
        best = max((k for k in range(n + 1) for c in combinations(t, k) if all(x < y for x, y in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(t[i] < t[j] and i < j for i, j in zip(got, got[1:]))


def test_arms_are_found_on_results(spark):
    from helixframe.operators import chain
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b, shared = text(9000), text(500), text(200)
    results = [(0, a), (1, b + shared), (2, shared + text(300)), (3, "")]
    kept = a[4050:4250]                 # lies over the border of two tiles
    # the result was polished since: two bases more, one less
    noisy = kept[:50] + kept[51:120] + "GG" + kept[120:]
    bubbles = [
        (1, kept[:100] + "T" * 7 + kept[107:], kept),
        (2, flip(b[100:160] + "ACACAC" + b[170:260]), flip(b[100:260])),
        (3, text(150), shared),         # two results hold it: a tie
        (4, text(150), text(150)),      # nowhere
        (5, noisy, noisy),
        (6, "", b[300:400]),
    ]
    got = {r["bubble"]: r for r in chain.bubbles_on_results(spark.createDataFrame(bubbles, "bubble long, arm string, opposite string"),
                                                            spark.createDataFrame(results, "target long, seq string"), 17).collect()}
    assert sorted(got) == [1, 2, 5, 6]
    r = got[1]
    changed = [i for i in range(100, 107) if kept[i] != "T"]
    assert (r["target"], r["strand"], r["start"], r["end"]) == (0, 1, 4050 + 100 if changed[0] > 99 and kept[100] != "T" else r["start"], 4050 + changed[-1] + 1)
    assert r["removed"] == a[r["start"]:r["end"]] and a[:r["start"]] + r["arm"] + a[r["end"]:] == a[:4150] + "T" * 7 + a[4157:]
    r = got[2]
    assert (r["target"], r["strand"]) == (1, -1)
    assert b[:r["start"]] + r["arm"] + b[r["end"]:] == b[:160] + "ACACAC" + b[170:]
    r = got[5]                          # the place is the whole stretch in spite of the gaps
    assert a[:r["start"]] + r["arm"] + a[r["end"]:] == a[:4050] + noisy + a[4250:]
    assert (got[6]["start"], got[6]["end"], got[6]["arm"]) == (300, 400, "")
    empty = chain.bubbles_on_results(spark.createDataFrame([], "bubble long, arm string, opposite string"), spark.createDataFrame(results, "target long, seq string"), 17)
    assert empty.count() == 0


def test_noisy_pieces_give_the_gap_back(spark):
    from helixframe.operators import consensus
    rng = random.Random(21)
    truth, pieces = {}, []
    for gap in range(6):
        truth[gap] = "".join(rng.choice("ACGT") for _ in range(rng.randrange(150, 400)))
        for _ in range(15):
            t = list(truth[gap])
            for k in sorted(rng.sample(range(12, len(t) - 12), len(t) // 20), reverse=True):
                op = rng.random()
                if op < 0.4:
                    t[k] = rng.choice("ACGT")
                elif op < 0.7:
                    t.insert(k, rng.choice("ACGT"))
                else:
                    t.pop(k)
            pieces.append((gap, "".join(t)))
    pieces += [(90, "ACGT"), (90, None), (90, ""), (91, "ACGTACGTAC"), (91, "ACGTACGTAC"), (91, "ACGTTCGTAC")]
    df = spark.createDataFrame(pieces, "gap long, piece string").repartition(4)
    got = {r["gap"]: (r["seq"], r["depth"]) for r in consensus.gap_consensus(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 91]
    assert got[91] == ("ACGTACGTAC", 2)
    assert {k: got[k][0] for k in truth} == truth
    assert consensus.gap_consensus(df.limit(0)).count() == 0
