"""Rules, near-duplicates, repeated passages against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from llm_cases import documents, groups, prose, texts_with_copies, words

from helixframe.llm import neardup, rules, substring, tables
from helixframe.llm.tables import components


@pytest.fixture(scope="module")
def texts():
    return texts_with_copies()


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + s for at in windows.values() if len(at) > 1 for i in at for s in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def test_rule_ledger(spark, texts):
    texts = [*texts, "a## b$$ c|" * 30, "same line\n" * 60, "é ñ ü " * 60]
    docs = documents(spark, texts).withColumnRenamed("n_chars", "n_words")      # a clashing name
    got = {r.doc_id: r for r in rules.ledger(docs, docs.columns).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        m = measures(t)
        assert tuple(got[i].ledger[k] for k in rules.MEASURES) == m, i
        n, chars, symbols, lines, dup, rep = m
        fails = [n < 50, 100 * rep > 50 * n, 10 * symbols > n, 100 * dup > 50 * lines, chars < 2 * n, chars > 12 * n]
        assert got[i].ledger.failed == sum(1 << k for k, f in enumerate(fails) if f)
        assert got[i].text == t
    kept = {r.doc_id for r in rules.keep_good(docs).collect()}
    assert kept == {i for i in got if got[i].ledger.failed == 0}
    assert rules.keep_good(docs).columns == docs.columns


def test_ablations_are_bitwise(spark, texts):
    led = rules.ledger(documents(spark, texts), ["doc_id"])
    bits = [r.ledger.failed for r in led.collect()]
    for r in rules.ablations(led).collect():
        mask, bit = rules.policy_mask(r.policy), rules.BITS[r.rule]
        assert r.n_docs == len(bits)
        assert r.n_failed == sum(1 for b in bits if b & bit)
        assert r.n_failed_alone == sum(1 for b in bits if b & mask == bit)
        assert r.n_kept_without == sum(1 for b in bits if not b & mask & ~bit)


def shingles(text, size):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, texts, size):
    sets = [shingles(t, size) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(range(len(sets)), linked)
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, size=size).collect()}
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in want} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert {r.doc_id for r in neardup.keep_one(docs, size=size).collect()} == {i for i in want if want[i] == i}


def test_near_duplicates_one_large_group(spark):
    """Near copies of one text, most rows, and a line that all others share."""
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = [" ".join("q" + str(rng.randrange(9)) if rng.random() < 0.06 else w for w in base) for _ in range(150)]
    line = prose(rng, 12)
    texts += [prose(rng, 40, 10_000) + " " + line for _ in range(100)]
    sets = [shingles(t, 2) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(range(len(sets)), linked)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts), size=2).collect()}
    assert got == want


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (9, "a b c d e f", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "component_id")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, size=2).collect()), key=str)
    assert got == sorted([(None, 7, True), (7, 7, True), (7, 7, True), (9, 7, False)], key=str) or got[-1][0] is None
    assert neardup.near_duplicates(docs.limit(0), size=2).collect() == []
    assert neardup.keep_one(docs, size=2).columns == docs.columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(90)]
    rng.shuffle(edges)
    want = groups({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 4), (3, None)], "a long, b long")).collect()}
    loops = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_loss_is_small():
    assert neardup.loss(neardup.K, 0.8, neardup.LEAST) < 1e-7


def cut(texts, length):
    seen, out = set(), []
    for t in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            if key in seen:
                gone.update(range(i, i + length))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("length", [5, 9, 20, 33])
def test_repeated_passages(spark, texts, length):
    rng = random.Random(4)
    common = prose(rng, 60, 50)
    texts = [*texts, *[prose(rng, rng.randrange(9)) + " " + common + " " + prose(rng, 7) for _ in range(20)], "a b " * 100, "ab " * 60]
    want = cut(texts, length)
    got = {r.doc_id: r for r in substring.remove_repeats(documents(spark, texts), length=length).collect()}
    for i, (n, gone, kept) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (n, gone, kept, hashlib.sha256(kept.encode()).hexdigest()), i


def test_difference_covers():
    for m, cover in substring.COVERS.items():
        assert {(a - b) % m for a in cover for b in cover} == set(range(m))


def test_repeated_passages_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a " * 50), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert got == {None: 0, 1: 0}
    assert substring.remove_repeats(docs.limit(0)).collect() == []


def test_keep_one_goes_by_text_where_ids_repeat(spark):
    a, b, c = "a b c d e f g", "q r s t u v w x", "one two three four five six"
    rows = [(7, a, 1), (7, a, 2), (7, b, 3), (3, b, 4), (None, c, 5), (None, c, 6), (None, a, 7), (9, "", 8), (9, "", 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumn("_row", F.lit("x"))
    out = neardup.keep_one(docs, size=2)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(7, a), (3, b), (None, c), (9, ""), (9, ""), (None, None)], key=str)
    plain = neardup.keep_one(docs.where("_gone in (1, 4)"), size=2)
    assert plain.columns == docs.columns and plain.count() == 2


def test_unlike_documents_of_a_list_are_no_rows(spark, monkeypatch):
    """A phrase in common makes neither guests of a crowd nor pairs, and texts
    that nothing asks for are dropped before they are dealt out."""
    rng = random.Random(8)
    base = [f"c{i}" for i in range(120)]
    crowd = []
    for i in range(24):
        words = list(base)
        for k in rng.sample(range(20, 120), 3):
            words[k] = f"z{i}q{k}"
        crowd.append(words)
    phrase = base[:20]
    other = [phrase + [f"d{i}w{j}" for j in range(100)] for i in range(40)]
    almost = [[w if k % 9 else f"y{k}" for k, w in enumerate(base)], base[:115]]
    texts = [" ".join(w) for w in [*crowd, *other, *almost]]
    made, plans, keep = {}, {}, neardup.stored

    def stored(df, label):
        out = keep(df, label)
        made.setdefault(label, []).append(out.count())
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(neardup, "stored", stored)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts), size=2).collect()}
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == groups(range(len(texts)), links) and len(set(got.values())) > 40
    assert made["guests"][0] <= 2 and made["pairs"][1] <= 2
    joins = [x for x in plans["texts"].split("\n") if "Join" in x]
    assert len(joins) == 2 and "_bits" in joins[1] and "strategy=broadcast" in joins[1]      # the filter comes first


def test_filter_of_ids(spark):
    ids = spark.range(0, 30000, 7).withColumnRenamed("id", "k")
    rows = spark.range(30000).withColumnRenamed("id", "k")
    for words in (1, 64, 1 << 20):
        tables.WORDS, before = words, tables.WORDS
        kept = {r.k for r in tables.may_hold(rows, ids, "k").collect()}
        tables.WORDS = before
        assert kept >= set(range(0, 30000, 7)) and (words < 1 << 20 or len(kept) < 30000 // 7 + 3000)
    assert tables.may_hold(rows, ids.limit(0), "k").collect() == []


def test_marks_bound_what_two_sketches_share(spark):
    rng = random.Random(2)
    pool = [f"p{i}" for i in range(70)]
    texts = [" ".join(rng.sample(pool, rng.choice((3, 20, 45, 60)))) for _ in range(40)]
    texts += [" ".join(x.split()[:-1]) for x in texts[:20]] + ["", "one", "one"]
    s = neardup.sketches(documents(spark, texts), "doc_id", "text", 1, 48).localCheckpoint()
    x, y = s.alias("x"), s.alias("y")
    may = x.join(y, (F.col("x.id") < F.col("y.id")) & (F.col("x.n") > 0) & (F.col("y.n") > 0)).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), neardup._may_link(48, 21, 80).alias("may"))
    allowed = {(r.a, r.b) for r in may.where("may").collect()}
    possible = {(r.a, r.b) for r in neardup._likely(may.select("a", "b"), s, 48, 21, 80).where("possible").collect()}
    assert possible <= allowed and 20 < len(possible) and len(allowed) < may.count()
