"""Vector codes, phrase collocations and SimHash against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import documents, prose, texts_with_copies, words

from helixframe.llm import phrases, simhash, vector_codes as vc

# ---- vector codes


def plain_codes(rows, rounds=4):
    """rows: (id, label, vector); the contract, word for word."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    w = len(kept[0][2]) // 4
    x = np.array([r[2] for r in kept], dtype=np.int64).reshape(len(kept), 4, w)
    book = [x[:256, p].copy() for p in range(4)]

    def nearest(p):
        d = ((x[:, p, None, :] - book[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)
    for _ in range(rounds):
        own = [nearest(p)[0] for p in range(4)]
        for p in range(4):
            for c in range(len(book[p])):
                if (own[p] == c).any():
                    book[p][c] = x[own[p] == c, p].sum(0) // (own[p] == c).sum()
    both = [nearest(p) for p in range(4)]
    error = sum(b[1] for b in both)
    by = Counter()
    for r, e in zip(kept, error):
        by[r[1]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for p in range(4) for e in book[p] for v in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{b[0][i]:02x}" for b in both), int(error[i]), by[r[1]], digest) for i, r in enumerate(kept))


def vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, d))
    out = [(int(i), int(i % 5) if i % 7 else None, [float(np.float32(v)) for v in centre[rng.integers(40)] + spread * rng.normal(size=d)]) for i in rng.permutation(n)]
    # copies, and ties between equal entries
    return out + [(n + i, 3, out[i % min(9, n)][2]) for i in range(40)]


@pytest.mark.parametrize("n, d, spread", [(1500, 16, 0.05), (700, 8, 1.0), (90, 4, 0.3), (1, 4, 1.0)])
def test_codes_equal_plain_rounds(spark, n, d, spread):
    rows = vectors(n, n, d, spread)
    rows += [(-1, 1, None), (-2, 1, [None] * d), (-3, 1, [float("nan")] + [0.0] * (d - 1)), (-4, None, [float("-inf")] * d)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(5)
    got = sorted(tuple(r) for r in vc.codes(df).collect())
    assert got == plain_codes(rows)


def test_bounds_spare_most_comparisons(spark):
    rows = vectors(5, 4000, 16, 0.05)
    done = vc.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    assert done.listed[0] == [vc.LISTED] * 4 and all(b <= a for x, y in zip(done.listed, done.listed[1:]) for a, b in zip(x, y))
    x = np.array([[math.floor(1024 * v) for v in r[2]] for r in rows])
    part, moved = vc.Part(x[:, :4], x[:256, :4]), x[:256, :4] + 3
    part.from_scratch(16)
    later = vc.Part(x[:, :4], moved)
    later.again(part.own, part.near, part.bound, np.full(256, 6.1), 16)
    assert later.needed[vc.ENTRIES] < len(x) / 4
    assert np.array_equal(later.own, ((x[:, None, :4] - moved[None]) ** 2).sum(2).argmin(1))


def test_codes_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert vc.codes(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, 1, [0.5] * 6), (2, 1, [0.25] * 6), (2, 1, [0.25] * 6), (3, 2, [1.0, 2.0]), (None, None, [0.5] * 6), (4, None, [1e30] * 6), (5, 5, [])]
    got = {(r.vec_id, r.code, r.error) for r in vc.codes(spark.createDataFrame(rows, kind)).collect()}
    # a code by hand: entries are those of ids 1, 2, 2 and 4; the later twin is never used, the last part is filled up
    assert got == {(1, "00000000", 0), (2, "01010100", 0), (3, None, None), (None, "00000000", 0), (4, "03030300", 0), (5, None, None)}


# ---- phrases


def plain_collocations(rows, least, inside, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                count.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(100 * b >= inside * a for (g, v), b in cand.items() if g == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))):
            continue
        score, _, left, right = min((1000000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(best)]
    return sorted(ranked)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "é", "zu", "İx", *[f"w{i}" for i in range(30)]]
    out = []
    for i in range(150):
        w = [rng.choice(vocabulary) if rng.random() < 0.6 else "new york city" for _ in range(rng.randrange(40))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", " - "]) for x in w)
        out.append((rng.choice(["en", "de", None, *[f"l{k}" for k in range(20)]]) if i % 3 else "en", text))
    return [*out, ("en", None), (None, ""), ("xx", " ,. \n"), ("en", "hot pair " * 3000), ("en", "a " * 500)]


@pytest.mark.parametrize("entries, burst", [(phrases.ENTRIES, phrases.BURST), (200, 40)])
def test_collocations(spark, monkeypatch, entries, burst):
    rows = phrase_rows(2)
    monkeypatch.setattr(phrases, "BURST", burst)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    kind = "lang string, text string, phrase string, n long"
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], kind).repartition(3)
    want = plain_collocations(rows, 5, 50, 40)
    # the trie itself runs here with small limits, so that it bursts and spills
    counter, got = phrases.Counter(3, entries), Counter()
    runs = []
    for a in range(0, len(rows), 10):
        part = rows[a:a + 10]
        runs += counter.add(pa.array([t for _, t in part], pa.string()), [g or "und" for g, _ in part])
    for run in [*runs, *counter.finish()]:
        for lang, size, piece in zip(*(c.to_pylist() for c in run.columns[1:])):
            names, n = phrases._opened(size, piece)
            assert len(names) == size == len(n)
            for k, m in zip(names.to_pylist(), n):
                got[lang, k.decode()] += int(m)
    assert entries > 1000 or len(runs) > 5
    stored = {(r.lang, r.phrase): r.n for r in phrases.phrase_counts(docs).collect()}
    assert stored == dict(got)
    assert sorted(tuple(r) for r in phrases.collocations(docs, min_count=5, top=40).collect()) == want
    assert len(want) > 40


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(documents(spark, [None, "", "once only"])).collect() == []


def test_trie_bursts_below_one_word():
    trie = phrases.Node(0)
    keys = np.array([(7 << 40) | (3 << 20) | i for i in range(1, 200_001)], dtype=np.uint64)
    trie.add(keys, np.ones(len(keys), np.int64))
    trie.add(keys[::2], np.full(100_000, 2))
    got = phrases._sorted(*trie.items())
    assert trie.size == 200_000 and np.array_equal(got[0], keys) and got[1][0] == 3 and got[1][1] == 1
    assert isinstance(trie.children[0], phrases.Node)


# ---- SimHash


def plain_fingerprint(text):
    w = words(text)
    terms = [" ".join(w[i:i + 2]) for i in range(max(1, len(w) - 1))] if w else []
    votes = [0] * 60
    for t in terms:
        h = int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
        for b in range(60):
            votes[b] += min(15, len(t)) * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(60) if votes[b] > 0)


def test_edited_fingerprints(spark):
    texts = [*texts_with_copies(9), "é" * 9, "\x01 odd \x0b\x0c words", "end"]
    got = {r.doc_id: r for r in simhash.edited(documents(spark, texts).withColumnRenamed("source", "fingerprint")).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        new = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        f, g, h = map(plain_fingerprint, (t, new, after))
        like = lambda a, b: max(0, 30 - (a ^ b).bit_count()) / 30
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), f, g), i
        assert (r.near_edited, r.near_next) == (like(f, g), like(f, h))


def test_edited_odd_rows(spark):
    rows = [(5, "b c d e f g h"), (5, "a b c d"), (None, "x y z w"), (None, "x y z w"), (2**60, "last one here"), (-3, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _blk int, id int")
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in simhash.edited(df).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(-3, 0, sha("")), (5, 7, sha("a b c " + "b")), (5, 13, sha("b c d e f " + "las")), (2**60, 13, sha("last one h")), (None, 7, None), (None, 7, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.edited(df.limit(0)).collect() == []
    one = simhash.edited(df.where("id = 2 and doc_id = -3")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in one] == [(0, 1.0, 1.0)]
    counted = simhash.with_near_counts(simhash.edited(df)).collect()
    assert sorted((r.doc_id or 0, r.n_near) for r in counted)[1:3] == [(0, 1), (0, 1)]


@pytest.mark.parametrize("radius, blocks", [(3, 6), (1, 2), (2, 4), (4, 5), (0, 3)])
def test_block_tables_find_all_near(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(60) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(60), rng.randrange(6))) for b in base for _ in range(8)]
    fps = sorted({*base, *near})
    got = sorted(tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fingerprint long"), radius, blocks).collect())
    want = [(a, b, (a ^ b).bit_count()) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= radius]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([], "fingerprint long"), 6, 6)


def test_near_counts_one_large_group(spark):
    """Half of the rows are copies of one text, others near copies of it."""
    rng = random.Random(4)
    base = prose(rng, 300)
    texts = [base] * 60 + [base + f" extra{i % 20}" for i in range(40)] + [prose(rng, 100) for _ in range(20)]
    rows = simhash.fingerprints(documents(spark, texts))
    got = {r.doc_id: r.n_near for r in simhash.with_near_counts(rows).collect()}
    f = [plain_fingerprint(t) for t in texts]
    assert got == {i: sum((f[i] ^ g).bit_count() <= 3 for g in f) - 1 for i in range(len(f))}
    assert got[0] >= 59
