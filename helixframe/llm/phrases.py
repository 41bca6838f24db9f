"""Phrase collocations by HAT-trie counting.

Every task counts the words, word pairs and word triples of its texts in one
trie over word ids. A trie node routes by one word of the phrase; its children
are hash containers for a range of words. A container that grows too large is
split in two at a word border, or, once it holds a single word, bursts into a
node that routes by the next word. When the trie is full, its largest subtrees
are spilled whole as sorted runs. A run is cut by prefix partition (language and
first two words; the third word spreads a prefix over ``SPREAD`` partitions, so
that a frequent pair is not one task's work) and packed; Spark deals the pieces to
tasks, which merge one prefix partition after the other. Scores are exact decimal
arithmetic on what remains above the minimum count: the parts of a candidate
occur at least as often as the candidate, so nothing else is looked up.

Word ids live inside one trie (words are compared, not their hashes). A key
packs language and ids in trie order into 64 bits; when a task meets more words
or languages than fit, it spills everything and starts a new dictionary.

Defined cases: null texts are empty, null languages are ``und``; repeated rows
count as rows; ties go by count and then by phrase in UTF-8 order; other columns
are not read; an empty table, or one without candidates, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import words as W

ID_BITS = 20
LANGS = 16                 # languages of one dictionary
VOCABULARY = 1_000_000     # words of one dictionary
CHUNK = 400_000            # words that are counted at a time
BURST = 1 << 16            # phrases of a container
ROWS = 1 << 17             # phrases of a run that are written at a time
ENTRIES = 1_000_000        # phrases of a trie before its largest subtrees are spilled
PIECE_ROWS = 16384         # phrases of a packed piece of a run, at most
PARTS = 2                  # prefix partitions of a shuffle partition; one is merged at a time
SPREAD = 16
SHARES = 64
RUN = "part int, lang string, rows int, piece binary"
RUN_SCHEMA = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("rows", pa.int32()), ("piece", pa.binary())])

#: bytes that end a piece, `[.,;:!?\x0A-\x0D]`, and those that end a word
PIECE = np.zeros(256, dtype=bool)
PIECE[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ENDS_WORD = PIECE.copy()
ENDS_WORD[[0x20, 0x09]] = True


class Container:
    """Counts of packed phrases in an open-addressing hash table; 0 is a free slot."""

    def __init__(self, room: int = 1024):
        self.table, self.counts, self.size = np.zeros(room, np.uint64), np.zeros(room, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct keys."""
        if 2 * (self.size + len(keys)) > len(self.table):
            old = self.items()
            self.__init__(1 << int(2 * (self.size + len(keys))).bit_length())
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = np.uint64(len(self.table) - 1)
        at = (W.mix(keys) & mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            slot, key = at[left], keys[left]
            free = self.table[slot] == 0
            self.table[slot[free]] = key[free]       # one of the keys that claim a slot stays in it
            here = self.table[slot] == key
            self.counts[slot[here]] += counts[left[here]]
            self.size += int(np.count_nonzero(here & free))
            left = left[~here]
            at[left] = (at[left] + 1) & int(mask)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.table != 0
        return self.table[used], self.counts[used]


class Node:
    """Routes keys by the word at ``depth`` (0: language and first word):
    child i takes words from ``bounds[i]`` up to the next bound."""

    def __init__(self, depth: int):
        self.depth, self.shift = depth, np.uint64(ID_BITS * (2 - depth))
        self.bounds, self.children = np.zeros(1, np.uint64), [Container()]

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct keys in ascending order; all agree above ``depth``."""
        cuts = np.searchsorted(keys >> self.shift, self.bounds[1:])
        parts = [(c, int(a), int(b)) for c, a, b in zip(self.children, [0, *cuts], [*cuts, len(keys)])]
        for child, a, b in parts:
            if a < b:
                child.add(keys[a:b], counts[a:b])
                if isinstance(child, Container) and child.size > BURST:
                    self._burst(child)

    def _burst(self, child: Container) -> None:
        i = self.children.index(child)
        keys, counts = _sorted(*child.items())
        word = keys >> self.shift
        if word[0] == word[-1]:
            if self.depth < 2:
                below = Node(self.depth + 1)
                below.bounds[0] = keys[0] >> below.shift
                below.add(keys, counts)
                self.children[i] = below
            return
        cut = int(np.searchsorted(word, word[len(word) // 2]))
        cut = cut or int(np.searchsorted(word, word[0], "right"))
        halves = [Container(), Container()]
        halves[0].add(keys[:cut], counts[:cut])
        halves[1].add(keys[cut:], counts[cut:])
        self.bounds = np.insert(self.bounds, i + 1, word[cut])
        self.children[i:i + 1] = halves

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        both = [c.items() for c in self.children]
        return np.concatenate([k for k, _ in both]), np.concatenate([n for _, n in both])

    def take_largest(self) -> tuple[np.ndarray, np.ndarray]:
        """Remove the largest subtree and return its phrases; its range stays with
        an empty container."""
        i = int(np.argmax([c.size for c in self.children]))
        run = self.children[i].items()
        self.children[i] = Container()
        return run


def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], counts[order]


class Counter:
    """A trie, the dictionary of its word ids, and the occurrences per language."""

    def __init__(self, largest: int = 3, entries: int = ENTRIES, parts: int = PARTS):
        self.largest, self.entries, self.parts = largest, entries, parts
        self._start()

    def _start(self) -> None:
        self.trie, self.ids, self.langs, self.total = Node(0), {}, {}, np.zeros(LANGS, np.int64)

    def add(self, texts: pa.Array, langs: list[str]) -> Iterator[pa.RecordBatch]:
        w = W.split(texts, ENDS_WORD, lower=True)
        piece = np.concatenate([[0], np.cumsum(PIECE[w.data])])[w.start]
        for a in range(0, len(w.start), CHUNK):
            yield from self._chunk(w, piece, langs, a, min(a + CHUNK, len(w.start)))

    def _chunk(self, w: W.Words, piece: np.ndarray, langs: list[str], a: int, b: int) -> Iterator[pa.RecordBatch]:
        """Count the phrases that start at words a to b - 1; they may end after b."""
        stop = min(b + 2, len(w.start))
        doc, piece = w.doc[a:stop], piece[a:stop]
        vocabulary, code = _encoded(w, a, stop)
        names = sorted({langs[i] for i in np.unique(doc)})
        for some in (names[i:i + LANGS] for i in range(0, len(names), LANGS)):
            new = [x for x in some if x not in self.langs]
            unknown = [x for x in vocabulary if x not in self.ids]
            if len(self.langs) + len(new) > LANGS or len(self.ids) + len(unknown) > VOCABULARY:
                yield from self.finish()
                new, unknown = some, vocabulary
            self.langs |= {x: len(self.langs) + i for i, x in enumerate(new)}
            self.ids |= {x: len(self.ids) + i + 1 for i, x in enumerate(unknown)}
            word = np.fromiter((self.ids[x] for x in vocabulary), np.uint64, len(vocabulary))[code]
            place = np.array([self.langs.get(x, 0) if x in some else -1 for x in langs])[doc]
            starts = (place >= 0) & (np.arange(len(doc)) < b - a)
            same = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
            first = (np.maximum(place, 0).astype(np.uint64) << np.uint64(3 * ID_BITS)) | (word << np.uint64(2 * ID_BITS))
            keys = [first[starts]]
            if self.largest > 1:
                keys.append((first[:-1] | (word[1:] << np.uint64(ID_BITS)))[same & starts[:-1]])
            if self.largest > 2:
                keys.append((first[:-2] | (word[1:-1] << np.uint64(ID_BITS)) | word[2:])[same[:-1] & same[1:] & starts[:-2]])
            self.total += np.bincount(place[starts], minlength=LANGS)
            self.trie.add(*np.unique(np.concatenate(keys), return_counts=True))
            if self.trie.size > self.entries:
                taken = []
                while self.trie.size > self.entries // 2:
                    taken.append(self.trie.take_largest())
                yield from self._run(*(np.concatenate(x) for x in zip(*taken)))

    def finish(self) -> Iterator[pa.RecordBatch]:
        """Spill everything; occurrences per language come as the empty phrase."""
        if self.ids:
            yield from self._run(*self.trie.items())
            names = list(self.langs)
            yield _pieces(np.zeros(len(names), np.int64), np.arange(len(names)), names, _array([b""] * len(names)), self.total[:len(names)])
        self._start()

    def _run(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Phrases as a sorted run, cut by prefix partition."""
        words, names = _array(list(self.ids)), list(self.langs)
        h = np.concatenate([np.zeros(1, np.uint64), _hashes(words)])
        rank = np.zeros(len(h), np.uint64)
        rank[1 + pc.array_sort_indices(words).to_numpy().astype(np.int64)] = np.arange(1, len(h), dtype=np.uint64)
        low = np.uint64((1 << ID_BITS) - 1)
        ids = [((keys >> np.uint64(ID_BITS * s)) & low).astype(np.int64) for s in (2, 1, 0)]
        lang = (keys >> np.uint64(3 * ID_BITS)).astype(np.int64)
        prefix = W.mix(_hashes(_array([x.encode() for x in names]))[lang] + h[ids[0]] * np.uint64(3) + h[ids[1]] * np.uint64(5))
        part = ((prefix + (h[ids[2]] % np.uint64(SPREAD)) * np.uint64(W.BASE)) % np.uint64(self.parts)).astype(np.uint32)
        ranked = (lang.astype(np.uint64) << np.uint64(3 * ID_BITS)) | (rank[ids[0]] << np.uint64(2 * ID_BITS)) | (rank[ids[1]] << np.uint64(ID_BITS)) | rank[ids[2]]
        order = np.argsort(ranked)
        order = order[np.argsort(part[order].astype(np.uint16 if self.parts <= 1 << 16 else np.uint32), kind="stable")]
        for a in range(0, len(order), ROWS):
            o = order[a:a + ROWS]
            known = [words.take(pa.array(np.maximum(i[o], 1) - 1, mask=i[o] == 0)) for i in ids]
            phrase = pc.binary_join_element_wise(*known, pa.scalar(b" ", pa.binary()), null_handling="skip")
            yield _pieces(part[o].astype(np.int64), lang[o], names, phrase, counts[o])


def _pieces(part: np.ndarray, lang: np.ndarray, names: list[str], phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Rows in order as packed pieces: phrases by line, then their counts."""
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(part * LANGS + lang) != 0]))
    cuts = sorted({int(c) for a, b in zip(fresh, [*fresh[1:], len(part)]) for c in range(a, b, PIECE_ROWS)})
    ends = [*cuts[1:], len(part)]
    lines = pc.binary_join_element_wise(phrase, pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
    at = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4)
    data, codec, counts = memoryview(lines.buffers()[2]), pa.Codec("zstd", 1), counts.astype("<i8")
    packed = [_size(raw := bytes(data[at[a]:at[b]]) + counts[a:b].tobytes()) + codec.compress(raw, asbytes=True) for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array([names[i] for i in lang[cuts]], pa.string()),
                                       pa.array(np.diff([*cuts, len(part)]), pa.int32()), pa.array(packed, pa.binary())], schema=RUN_SCHEMA)


def _size(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little")


def _opened(rows: int, piece: bytes) -> tuple[pa.Array, np.ndarray]:
    """Phrases and counts of a packed piece."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(piece[8:], int.from_bytes(piece[:8], "little")), np.uint8)
    text = raw[:len(raw) - 8 * rows]
    stop = np.flatnonzero(text == 0x0A)
    # without the line ends, each phrase starts where the one before ended
    borders = np.concatenate([[0], stop + 1 - np.arange(1, rows + 1)])
    return W.arrow_binary(text[text != 0x0A], borders), raw[len(raw) - 8 * rows:].view("<i8")


def _merged(lang: str, phrases: list[pa.Array], counts: list[np.ndarray], least: int) -> pa.RecordBatch:
    table = pa.table({"phrase": pa.chunked_array(phrases), "n": np.concatenate(counts)})
    table = table.group_by("phrase").aggregate([("n", "sum")])
    phrase, n = table["phrase"], table["n_sum"]
    some = pc.or_(pc.greater_equal(n, least), pc.equal(pc.binary_length(phrase), 0))
    phrase = phrase.filter(some).combine_chunks().cast(pa.string())
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": phrase, "n": n.filter(some).combine_chunks()})


def _hashes(words: pa.Array) -> np.ndarray:
    """Hashes of the values of a binary array without nulls."""
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    return W.hashes(W.Words(data[:at[-1]], at, at[:-1], at[1:], np.zeros(0, int), np.zeros(0, int)))


def _array(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary())


def _encoded(w: W.Words, a: int, b: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct ones of the words a to b - 1, and the place of each among them."""
    start, size = w.start[a:b], (w.end[a:b] - w.start[a:b]).astype(np.int64)
    stop = np.cumsum(size)
    data = w.data[np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]))]
    found = W.arrow_binary(data, np.concatenate([[0], stop])).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", largest: int = 3, min_count: int = 1) -> DataFrame:
    """lang, phrase, n: occurrences of all phrases of 1 to ``largest`` (at most 3)
    words with at least ``min_count``; the empty phrase has the words of a language."""
    if not 1 <= largest <= 3:
        raise ValueError("phrases have 1 to 3 words")

    spark = docs.sparkSession
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        counter = Counter(largest, parts=PARTS * dealt)
        for batch in W.pieces(batches):
            yield from counter.add(batch.column(0), batch.column(1).to_pylist())
        yield from counter.finish()

    def merge(batches):
        now, held = None, ([], [])
        for batch in batches:
            for part, lang, rows, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (part, lang) and now is not None:
                    yield _merged(now[1], *held, min_count)
                    held = ([], [])
                now = part, lang
                for store, values in zip(held, _opened(rows, piece)):
                    store.append(values)
        if now is not None:
            yield _merged(now[1], *held, min_count)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    runs = rows.mapInArrow(count, RUN).repartition(dealt, "part").sortWithinPartitions("part", "lang")
    return runs.mapInArrow(merge, "lang string, phrase string, n long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of two
    and three words of every language. A phrase that stands in a longer candidate
    with at least ``inside`` percent of its count is dropped."""
    counts = materialize(phrase_counts(docs, text, lang, 3, min_count), "phrases")
    n = counts.where("phrase = ''").select("lang", F.col("n").alias("total"))
    known = counts.where("phrase <> ''")
    word = F.split("phrase", " ")
    candidates = known.select("lang", "phrase", F.col("n").alias("a"), word.alias("w")).where(F.size("w") > 1)

    def joined(a: int, b: int | None) -> Column:
        return F.array_join(F.slice("w", a + 1, F.lit(b - a) if b else F.size("w")), " ")

    cut = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("rest")))
    cuts = candidates.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    told = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = told.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # phrases inside a longer candidate, by the largest count of those
    held = candidates.where(F.size("w") == 3).select("lang", "a", F.explode(F.array(joined(0, 2), joined(1, None))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < inside * F.col("a").cast("decimal(20,0)")))
    # first the best of each share of a language, so that a large language is ranked by many tasks
    best = kept.withColumn("share", F.pmod(F.hash("phrase"), F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("s.score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"),
        F.col("total").alias("n"), F.col("s.score").cast("long").alias("score"))
