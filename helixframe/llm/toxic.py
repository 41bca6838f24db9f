"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embedding rows; filters of several widths run over all
words of a text, the largest response of each filter is kept, and a logistic
layer scores the result. The model is trained on all labelled documents, whole
texts; embeddings start from how much more often a word stands in toxic documents.
A fifth of the documents only calibrates: the score's scale for all, and a threshold
for each language that is used for ``flagged`` and never for the score.

Documents are dealt by their id to shards of about ``SHARD_WORDS`` words. In an epoch
every shard trains on its documents from the model of the epoch before, and the
changes are averaged: of the filters over all shards, of an embedding row over those
that changed it. Changes are summed as integers, so the model depends on the rows
alone. Through the driver pass tables of a fixed size (``ROWS`` rows at most) for the
word counts and each epoch, and one row a language; never a document.

Defined cases: null and empty texts get the score of an empty one; texts of any
length are scored whole, in bounded memory per piece; labels that are null or
without a document are ignored; labels that repeat with different values count
as toxic; without labels of both classes every score is 0; rows that repeat are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import discard, materialize
from . import words as W

SHARD_WORDS = 1 << 20   # words that train one after another in an epoch
ROWS = 1 << 18          # embedding rows
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 32
FOLDS = 5
PARTS = 5 * FOLDS       # parts of the documents; the last FOLDS only calibrate
SCALE = 1 << 36         # changes are summed in these units
BITS = 1 << 24          # bits that tell which documents have no label
BINS = 1024             # scores are counted in bins of this many to one unit of log odds
SMOOTH = 6.0           # documents that a word is thought to be in beforehand
SEED = 5
CHUNK = 1 << 16        # words scored at once


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]            # width * DIM x FILTERS each
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding row of every word and the n + 1 borders of the texts."""
    w = W.split(texts, W.PUNCTUATION, lower=True)
    return (W.hashes(w) % np.uint64(ROWS)).astype(np.int64), w.first


def features(m: Model, rows: np.ndarray, first: np.ndarray, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in every text, and the word where it
    stands; 0 and -1 for texts shorter than the filter. ``lead`` stands in for
    the first embedding column in training."""
    n = len(first) - 1
    out = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
    where = np.full(out.shape, -1, dtype=np.int64)
    for f, width in enumerate(WIDTHS):
        columns = slice(f * FILTERS, (f + 1) * FILTERS)
        for i, a, b in _chunks(first, width):
            x = m.embedding[rows[a:b]]
            if lead is not None:
                x[:, 0] = lead[a:b]
            k = b - a - width + 1
            y = np.hstack([x[s:s + k] for s in range(width)]) @ m.filters[f] + m.bias[f]
            docs = np.arange(i.start, i.stop)
            lo, hi = np.maximum(first[docs], a) - a, np.minimum(first[docs + 1], b) - a - width + 1
            there = hi > lo
            docs, lo, hi = docs[there], lo[there], hi[there]
            if not len(docs):
                continue
            # odd slots of the cuts are the stretches between texts
            cuts = np.stack([lo, hi], axis=1).ravel()
            best = np.maximum.reduceat(np.vstack([y, np.full((1, FILTERS), -np.inf, np.float32)]), cuts, axis=0)[::2]
            better = best > out[docs, columns]
            out[docs, columns] = np.where(better, best, out[docs, columns])
            if m.shift is None:               # training also needs the place
                for d, p, q in zip(docs, lo, hi):
                    arg = y[p:q].argmax(axis=0) + p + a
                    where[d, columns] = np.where(out[d, columns] > 0, arg, -1)
    return out, where


def _chunks(first: np.ndarray, width: int) -> Iterator[tuple[slice, int, int]]:
    """Stretches of words of at most ``CHUNK``, whole texts where they fit;
    longer texts are cut with an overlap of the filter's width."""
    n, i = len(first) - 1, 0
    while i < n:
        j = max(int(np.searchsorted(first, first[i] + CHUNK, side="right")) - 1, i + 1)
        a, end = int(first[i]), int(first[j])
        while end - a >= width:
            b = min(a + CHUNK, end)
            yield slice(i, j), a, b
            if b == end:
                break
            a = b - width + 1
        i = j


def log_odds(m: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    x, _ = features(m, rows, first)
    return (x @ m.out[:-1] + m.out[-1] + (m.shift or 0.0)).astype(np.float64)


def scores(m: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-log_odds(m, rows, first)))


def fresh(share: np.ndarray) -> Model:
    """The model before training; ``share`` is the first embedding column."""
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
    embedding[:, 0] = share
    filters = [rng.normal(0, 0.3 / np.sqrt(width), (width * DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
    for f, width in zip(filters, WIDTHS):
        f[::DIM, 0] = 1.0 / width
    m = Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.concatenate([rng.normal(0, 0.1, len(WIDTHS) * FILTERS), [-1.0]]).astype(np.float32), None)
    m.out[:-1][::FILTERS] = 0.5
    return m


def small(m: Model) -> list[np.ndarray]:
    """What is trained besides the embedding."""
    return [*m.filters, *m.bias, m.out]


def laid_out(params: list[np.ndarray], first_moment: list[np.ndarray], second_moment: list[np.ndarray], step: float) -> np.ndarray:
    return np.concatenate([*(a.ravel() for a in (*params, *first_moment, *second_moment)), [step]]).astype(np.float64)


def taken_apart(state: np.ndarray, like: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], float]:
    out, at = [], 0
    for a in like * 3:
        out.append(state[at:at + a.size].reshape(a.shape).astype(np.float32))
        at += a.size
    k = len(like)
    return out[:k], out[k:2 * k], [np.maximum(a, 0) for a in out[2 * k:]], float(state[-1])


def epoch(m: Model, state: np.ndarray, rows: np.ndarray, first: np.ndarray, toxic: np.ndarray, fold: np.ndarray,
          told: np.ndarray, weight: np.ndarray, seed: list[int]) -> tuple[Model, np.ndarray, np.ndarray]:
    """One pass over the documents of a shard: the model, the state and the
    embedding rows that changed. A document trains on what the other folds say of
    its words (``told``); ``weight`` makes both classes weigh alike."""
    params, first_moment, second_moment, step = taken_apart(state, small(m))
    n = len(WIDTHS)
    m = replace(m, embedding=m.embedding.copy(), filters=params[:n], bias=params[n:2 * n], out=params[-1], shift=None)
    changed = np.zeros(ROWS, dtype=bool)
    order = np.random.default_rng(seed).permutation(len(toxic))
    for a in range(0, len(order), BATCH):
        pick = order[a:a + BATCH]
        size = first[pick + 1] - first[pick]
        at = np.concatenate([[0], np.cumsum(size)])
        own = rows[np.repeat(first[pick] - at[:-1], size) + np.arange(at[-1])]
        lead = told[np.repeat(fold[pick], size), own]
        x, where = features(m, own, at, lead)
        p = 1 / (1 + np.exp(-(x @ m.out[:-1] + m.out[-1])))
        delta = ((p - toxic[pick]) * weight[toxic[pick]] / len(pick)).astype(np.float32)
        grads = [np.zeros_like(q) for q in params]
        grads[-1][:-1], grads[-1][-1] = x.T @ delta + 1e-4 * m.out[:-1], delta.sum()
        back = delta[:, None] * m.out[:-1][None, :]
        rows_hit, rows_grad = [], []
        for f, width in enumerate(WIDTHS):
            d, c = np.nonzero(where[:, f * FILTERS:(f + 1) * FILTERS] >= 0)
            pos, g = where[d, f * FILTERS + c], back[d, f * FILTERS + c]
            for s in range(width):
                r = own[pos + s]
                part = slice(s * DIM, (s + 1) * DIM)
                value = m.embedding[r]
                value[:, 0] = lead[pos + s]
                np.add.at(grads[f][part].T, c, g[:, None] * value)
                rows_hit.append(r)
                rows_grad.append(g[:, None] * m.filters[f][part].T[c])
            np.add.at(grads[n + f], c, g)
        step += 1
        rate = 0.01 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        for q, g, u, v in zip(params, grads, first_moment, second_moment):
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            q -= (rate * u / (np.sqrt(v) + 1e-7)).astype(q.dtype)
        if rows_hit:
            hit, place = np.unique(np.concatenate(rows_hit), return_inverse=True)
            g = np.zeros((len(hit), DIM), np.float32)
            np.add.at(g, place, np.concatenate(rows_grad))
            m.embedding[hit, 1:] -= 0.5 * g[:, 1:]
            changed[hit] = True
    return m, laid_out(params, first_moment, second_moment, step), np.flatnonzero(changed)


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, toxic: str) -> DataFrame:
    """A step table of all labelled documents: id, lang, toxic, part, words (their
    embedding rows). The part follows from the id."""
    given = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic")).where("toxic in (0, 1)")
    given = given.select(F.xxhash64(F.col("id").cast(docs.schema[doc_id].dataType)).alias("id"), "toxic")
    # texts without a label are dropped where they are read, by a bit array of fixed size; the join decides
    bit = F.pmod("id", F.lit(BITS))
    marks = given.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(id, 64) as int))")).alias("bits")).toArrow()
    marked = np.zeros(BITS // 64, dtype=np.int64)
    marked[marks["at"].to_numpy()] = marks["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(marked)
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.xxhash64(doc_id).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % BITS
            there = (shared.value[at // 64] >> (at % 64)) & 1
            for piece in W.pieces([batch.filter(pa.array(there == 1))]):
                rows, first = word_rows(piece.column(2))
                words = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], words], ["id", "lang", "words"])

    got = texts.mapInArrow(run, "id long, lang string, words array<int>").join(given.hint("merge"), "id")
    table = materialize(got.select("id", "lang", "toxic", "words", F.pmod("id", F.lit(PARTS)).cast("int").alias("part")), "toxic-words")
    shared.destroy()
    return table


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and the n + 1 borders of a column of lists."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64), offsets - offsets[0]


def _word_shares(own: DataFrame, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much more often each word stands in toxic documents, told by the other
    folds (FOLDS x ROWS) and by all; smoothed by the classes' shares, so that a word
    never seen is at zero. ``size`` is the documents by fold and class."""
    here = lambda k, c: ((F.col("part") % FOLDS == k) & (F.col("toxic") == c)).alias(f"n{k}_{c}")
    cells = [(k, c) for k in range(FOLDS) for c in (0, 1)]
    seen = own.select(*[here(k, c) for k, c in cells], F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        *[F.count_if(f"n{k}_{c}").cast("int").alias(f"n{k}_{c}") for k, c in cells]).toArrow()      # ROWS rows at most, whatever the data
    count = np.zeros((FOLDS, 2, ROWS))
    for k, c in cells:
        count[k, c, seen["word"].to_numpy()] = seen[f"n{k}_{c}"].to_numpy()

    def share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
        of = np.maximum(of, 1)
        rate = (n + SMOOTH * (of / of.sum())[:, None]) / (of + SMOOTH)[:, None]
        return (np.log(rate[1]) - np.log(rate[0])).astype(np.float32)

    whole, all_ = count.sum(axis=0), size.sum(axis=0)
    return np.stack([share(whole - count[k], all_ - size[k]) for k in range(FOLDS)]), share(whole, all_)


def _trained(own: DataFrame, told: np.ndarray, share: np.ndarray, weight: np.ndarray, n_shards: int) -> Model:
    """``EPOCHS`` rounds over the shards; each is one row that holds its documents."""
    dealt = own.select(F.pmod(F.xxhash64("id"), F.lit(n_shards)).alias("shard"), F.struct("id", "toxic", (F.col("part") % FOLDS).alias("fold"), "words").alias("doc"))
    shards = materialize(dealt.repartition(n_shards, "shard").groupBy("shard").agg(F.sort_array(F.collect_list("doc")).alias("docs")).select(
        "shard", F.col("docs.toxic").alias("toxic"), F.col("docs.fold").alias("fold"), F.col("docs.words").alias("words")), "toxic-shards")
    context = own.sparkSession.sparkContext
    m = fresh(share)
    zeros = [np.zeros_like(p) for p in small(m)]
    state = laid_out(small(m), zeros, zeros, 0)
    wide = DIM - 1
    names = [f"v{k}" for k in range(wide)]
    fixed = context.broadcast((told, weight))
    for turn in range(EPOCHS):
        shared = context.broadcast((m, state))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            (m, state), (told, weight) = shared.value, fixed.value
            for batch in batches:
                for k in range(batch.num_rows):
                    shard, toxic, fold, words = (c.slice(k, 1) for c in batch.columns)
                    rows, first = _lists(words.flatten())
                    after, moved, hit = epoch(m, state, rows, first, toxic.flatten().to_numpy(), fold.flatten().to_numpy(), told, weight, [SEED, turn, shard[0].as_py()])
                    moved = np.concatenate([moved - state, np.zeros(-len(state) % wide)]).reshape(-1, wide)
                    value = np.vstack([after.embedding[hit, 1:].astype(np.float64) - m.embedding[hit, 1:], moved])
                    value = np.rint(value * SCALE).astype(np.int64)
                    at = np.concatenate([hit, ROWS + np.arange(len(moved))])
                    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v) for v in value.T)], ["at", *names])

        changes = shards.mapInArrow(run, "at long, " + ", ".join(f"{c} long" for c in names)).groupBy(F.col("at").cast("int").alias("at")).agg(
            *[(F.avg(c) / SCALE).cast("float").alias(c) for c in names]).toArrow()      # ROWS and a few hundred rows at most
        at, value = changes["at"].to_numpy(), np.stack([changes[c].to_numpy() for c in names], axis=1)
        words = at < ROWS
        embedding = m.embedding.copy()
        embedding[at[words], 1:] += value[words]
        rest = value[~words][np.argsort(at[~words])].ravel()[:len(state)]
        state = state + rest
        params, *_ = taken_apart(state, small(m))
        n = len(WIDTHS)
        m = replace(m, embedding=embedding, filters=params[:n], bias=params[n:2 * n], out=params[-1])
        shared.destroy()
    fixed.destroy()
    discard(shards)
    return replace(m, shift=0.0)


def _cuts(found: DataFrame) -> list:
    """Threshold of the score with the largest F1, in the middle of the gap below it:
    one row for each ``lang`` and one without for all; found: lang, toxic, odds."""
    low, high = F.min("odds").alias("low"), F.max("odds").alias("high")
    bins = found.groupBy("lang", F.floor(F.least(F.greatest(F.col("odds"), F.lit(-64.0)), F.lit(64.0)) * BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"), low, high)
    whole = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    bins = bins.unionByName(whole.withColumn("lang", F.lit(None).cast("string")))
    down, of = Window.partitionBy("lang").orderBy(F.desc("bin")), Window.partitionBy("lang")
    t = bins.select("lang", "low", F.lead("high").over(down).alias("below"), F.sum("n").over(down).alias("taken"), F.sum("hits").over(down).alias("right"),
                    F.sum("n").over(of).alias("n"), F.sum("hits").over(of).alias("toxic"))
    t = t.withColumn("f1", 2.0 * F.col("right") / (F.col("taken") + F.col("toxic")))
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    cut = (p("low") + F.coalesce(p("below"), F.lit(0.0))) / 2
    return t.groupBy("lang").agg(F.max_by(cut, F.struct("f1", "low")).alias("cut"), F.first("n").alias("n"), F.first("toxic").alias("toxic")).collect()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        toxic: str = "toxic") -> Model | None:
    """Train and calibrate on all labelled documents."""
    table = _labelled(docs, labels, doc_id, text, lang, toxic)
    known = table.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")).collect()   # PARTS * 2 rows at most
    count = np.zeros((PARTS, 2), dtype=np.int64)
    for r in known:
        count[r["part"], r["toxic"]] = r["n"]
    if not count.sum(axis=0).all():
        discard(table)
        return None
    held = PARTS - FOLDS
    if not (count[:held].sum(axis=0).all() and count[held:].sum(axis=0).all()):
        held = PARTS                          # too few: all train, and all calibrate
    own = table.where(F.col("part") < held)
    size = count[:held].reshape(-1, FOLDS, 2).sum(axis=0)
    told, share = _word_shares(own, size)
    n_words = sum(r["words"] for r in known if r["part"] < held)
    m = _trained(own, told, share, size.sum() / (2 * size.sum(axis=0)), -(-n_words // SHARD_WORDS) or 1)
    shared = table.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = log_odds(shared.value, *_lists(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odds)], ["lang", "toxic", "odds"])

    check = table.where(F.col("part") >= held) if held < PARTS else table
    cuts = _cuts(check.select("lang", "toxic", "words").mapInArrow(run, "lang string, toxic int, odds double"))
    shared.destroy()
    discard(table)
    logit = lambda p: float(np.log(p / (1 - p)))
    m.shift = -logit(min(max(next(r["cut"] for r in cuts if r["lang"] is None), 1e-4), 1 - 1e-4))
    for r in cuts:
        if r["lang"] is not None and r["toxic"] >= 10 and r["n"] - r["toxic"] >= 10:
            m.thresholds[r["lang"]] = 1 / (1 + float(np.exp(-logit(min(max(r["cut"], 1e-9), 1 - 1e-9)) - m.shift)))
    return m


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns ``keep`` and the struct ``toxicity``: score, threshold of the
    document's language, flagged (score at or above it)."""
    keep = [c for c in keep if c != "toxicity"]
    slim = docs.select(*dict.fromkeys([*keep, text, lang]))
    if model is None:
        zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.5).alias("threshold"), F.lit(False).alias("flagged"))
        return slim.select(*keep, zero.alias("toxicity"))
    out = T.StructType([*[slim.schema[c] for c in keep], T.StructField("toxicity", T.StructType(
        [T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())]))])
    # a table of fixed size (ROWS * DIM floats), whatever the data
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in W.pieces(batches, text):
            column = lambda c: piece.column(piece.schema.get_field_index(c))  # noqa: E731, B023
            s = scores(m, *word_rows(column(text)))
            cut = np.array([m.thresholds.get(x or "", 0.5) for x in column(lang).to_pylist()])
            struct = pa.StructArray.from_arrays([pa.array(s), pa.array(cut), pa.array(s >= cut)], ["score", "threshold", "flagged"])
            yield pa.RecordBatch.from_arrays([*map(column, keep), struct], [*keep, "toxicity"])

    return slim.mapInArrow(run, out)
