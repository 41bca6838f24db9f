"""Cases of the third review: each failed before its change."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric as nu
from helixframe.operators import coverage as cv, gapclose as gc, links as lk, mapping as mp
from helixframe.plans import commands as cmd


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


# the last word of the left flank comes back ten bases on, inside the gap
REPEAT = ("TTGCTTAACCTATTACTACTACAGGCCACTACCTGTACGCAGGTACTAGCACTAGCTAGCACTAGCTAGCGCACCATAGCACGTAGACGCTATTAGTTGACATATTTAACAATTATGAATGCACGG")


def _gap(spark, text):
    scaffold = spark.createDataFrame([(1, text[:60] + "N" * 20 + text[80:])], "node long, seq string")
    return scaffold, gc.gaps(scaffold)


@pytest.mark.parametrize("turn", [False, True])
def test_flank_word_repeated_inside_the_gap(spark, turn):
    reads = spark.createDataFrame([(i, rc(REPEAT[i:i + 60]) if turn else REPEAT[i:i + 60]) for i in range(0, 64, 7)], "read_id long, seq string")
    scaffold, gaps = _gap(spark, REPEAT)
    got = mp.gap_spanning_reads(reads, gaps.select("gap_id", F.col("head").alias("left"), F.col("tail").alias("right")), 15)
    want = sorted((i, 20, REPEAT[60:80]) for i in range(0, 64, 7) if i <= 45 and i + 60 >= 95)
    assert sorted(tuple(r) for r in got.select("read_id", "length", "seq").collect()) == want
    assert cmd.close_gaps(scaffold, reads, word=15).first()["seq"] == REPEAT


def test_lacking_base_in_runs_keeps_the_end_of_the_overlap(spark):
    text = "CAATTATAGTATCACAGATAGCACAATAGTAGCGTAAAAAAAACTTCAAACTGAAAAACTACAAAAAAAAGTAAACAAAACCAACTACAATGAACAATTACATAAATTATAGAAACTGAGAACGC"
    reads = spark.createDataFrame([("1:60", i, text[i:i + 22] + text[i + 23:i + 60]) for i in range(0, 57, 14)], "gap_id string, read_id long, seq string")
    scaffold, gaps = _gap(spark, text)
    closed = gc.overlap_chains(gaps, reads, 20)
    assert gc.apply_closures(scaffold, gaps, closed).first()["seq"] == text


@pytest.mark.parametrize("limit", [1, 6, 60])
def test_small_groups_are_opened_and_large_ones_looked_up(spark, monkeypatch, limit):
    r = random.Random(8)
    monkeypatch.setattr(lk, "SMALL_GROUP", limit)
    n = {(g, x): r.randrange(1, 5) for g in range(60) for x in r.sample(range(40), 2 if g % 3 else 12)}
    both = {(x, y): [min(n[g, x], n[g, y]) for g in range(60) if (g, x) in n and (g, y) in n] for x in range(40) for y in range(x + 1, 40)}
    t = spark.createDataFrame([(*k, v) for k, v in n.items()], "tag int, node int, n int")
    for support in (1, 2, 3):
        want = sorted((x, y, len(v)) for (x, y), v in both.items() if len(v) >= support)
        assert sorted(tuple(q) for q in lk.co_occurring(t, "tag", "node", support).collect()) == want
    asked = [(y, x) if (x + y) % 2 else (x, y) for x, y in both]
    want = sorted((a, b, sum(both[min(a, b), max(a, b)])) for a, b in asked)
    assert sorted(tuple(q) for q in lk.common_tags(spark.createDataFrame(asked, "id1 int, id2 int"), t).collect()) == want
    # a group opens into at most (limit - 1) / 2 pairs for each of its rows
    small, large = lk._by_size(t)
    assert lk._in_small_groups(small).count() <= small.count() * (limit - 1) / 2 and small.count() + large.count() == len(n)


def test_error_function_needs_no_series(spark, capsys):
    values = [None, float("-inf"), -7.0, -2.5, -1e-9, 0.0, 0.3, 1.0, 3.9, 6.0, 6.1, float("inf"), float("nan")]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", nu.error_function("x").alias("y"))
    for r in got.collect():
        v = values[r["i"]]
        assert r["y"] is None if v is None else math.isnan(r["y"]) if math.isnan(v) else r["y"] == math.erf(v)
    got.explain()
    assert "lambda" not in capsys.readouterr().out


def test_alignment_chains_in_one_order(spark, capsys):
    r = random.Random(5)
    hits = [(q, 50, n, s, s + r.randrange(1, 60)) for q in range(6) for n in range(3) for s in r.choices(range(600), k=12)] + [(9, 50, 1, 7, 20), (9, 50, 1, 7, 30)]
    want = []
    for q, n in {(h[0], h[2]) for h in hits}:
        widest = {}
        for s, e in ((min(h[3], 499), min(h[4], 499)) for h in hits if (h[0], h[2]) == (q, n)):
            widest[s] = max(e, widest.get(s, e))
        runs = []
        for s, e in sorted(widest.items()):
            if not runs or s - runs[-1][-1][1] + 1 > 50:
                runs.append([])
            runs[-1].append((s, e))
        best = max(runs, key=lambda x: max(e for _, e in x) - x[0][0])
        want += [(q, n, s, e, best[i + 1][0] if i + 1 < len(best) else None) for i, (s, e) in enumerate(best)]
    got = cv.alignment_chains(spark.createDataFrame(hits, "read_id int, read_len int, node int, t_start int, t_end int"),
                              spark.createDataFrame([(n, 500) for n in range(3)], "node int, len int"))
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want))
    capsys.readouterr()
    got.explain()
    assert "Aggregate" not in capsys.readouterr().out
