"""Small tables with the awkward cases, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.repartition(3)


def groups(ids, linked):
    """Smallest reachable id under an edge list."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def texts_with_copies(seed=3):
    """Prose with exact copies, near copies, repeats inside a text, and edge cases."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(25)]
    out = [None, "", "  \n\t ", "one", "one", "Two words", "two WORDS", *base]
    for t in base[:8]:
        out += [t, t.upper()]
        for rate in (0.02, 0.05, 0.1, 0.2):
            out.append(" ".join("zz" if rng.random() < rate else w for w in t.split()))
    passage = prose(rng, 40)
    out += [prose(rng, 15) + "\n" + passage + " " + prose(rng, 15) for _ in range(12)]
    out += [passage + " " + passage, "x " * 500, prose(rng, 20_000), base[3] + "\r\n" + base[4]]
    return out
