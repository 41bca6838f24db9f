"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit per failed
rule and the measurements behind it. A policy is a named, versioned set of bits,
so a verdict is one bitwise AND, and ablations are sums over masks that never
read a text again.

Defined cases: null and empty texts have no words and fail ``few_words``; every
input row gives one row, repeated rows too; texts of any length are measured
whole; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words as W

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: rule -> condition on the measurements; the bit is the position in this list
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: versioned policies: the rules whose failure rejects a document
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"],
}


def policy_mask(policy: str | list[str]) -> int:
    return sum(BITS[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of one piece of texts."""
    w = W.split(texts)
    n = len(texts)
    inside = np.concatenate([[0], np.cumsum(~W.SPACE[w.data] & ((w.data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[w.data])])
    # three-word windows that the same text holds twice
    three = W.whole(w, 3)
    at = np.flatnonzero(three)
    key = W.mix(W.windows(W.hashes(w), w, 3)[at] + w.doc[at].astype(np.uint64) * np.uint64(W.BASE))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[times[where] > 1]
    covered = np.zeros(len(w.start), dtype=bool)
    for shift in range(3):
        covered[twice + shift] = True
    lines = np.zeros(n, dtype=np.int64)
    repeated = np.zeros(n, dtype=np.int64)
    for i in range(n):
        seen = set()
        for line in w.text(i).split(b"\n"):
            if line.strip():
                lines[i] += 1
                if line in seen:
                    repeated[i] += 1
                seen.add(line)
    return {
        "n_words": w.count().astype(np.int64),
        "word_chars": (inside[w.offsets[1:]] - inside[w.offsets[:-1]]).astype(np.int64),
        "n_symbols": (symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]).astype(np.int64),
        "n_lines": lines,
        "n_dup_lines": repeated,
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n).astype(np.int64),
    }


def ledger(docs: DataFrame, keep: list[str], text: str = "text", column: str = "ledger") -> DataFrame:
    """Columns ``keep`` of ``docs`` plus the struct ``column``: ``failed`` (one
    bit per failed rule) and the measurements. A column of that name in the
    input is replaced; other names cannot clash because the ledger is one struct."""
    keep = [c for c in keep if c != column]
    slim = docs.select(*dict.fromkeys([*keep, text]))
    fields = [slim.schema[c] for c in keep]
    out = T.StructType([*fields, T.StructField("_measures", T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, text):
            got = measure(piece.column(piece.schema.get_field_index(text)))
            struct = pa.StructArray.from_arrays([pa.array(got[m]) for m in MEASURES], MEASURES)
            yield pa.RecordBatch.from_arrays([*[piece.column(piece.schema.get_field_index(c)) for c in keep], struct], [*keep, "_measures"])

    measured = slim.mapInArrow(run, out)
    failed: Column = F.lit(0).cast("long")
    for name, condition in RULES.items():
        for m in sorted(MEASURES, key=len, reverse=True):
            condition = condition.replace(m, f"_measures.{m}")
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.select(*keep, F.struct(failed.alias("failed"), *[F.col(f"_measures.{m}").alias(m) for m in MEASURES]).alias(column))


def fails(policy: str | list[str], column: str = "ledger") -> Column:
    """Whether a document fails a rule of the policy."""
    return F.col(f"{column}.failed").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) != 0


def ablations(ledgers: DataFrame, policies: list[str] = ("base", "v1"), column: str = "ledger") -> DataFrame:
    """For every policy and rule of it: documents that fail the rule, that fail
    no other rule of the policy, and that are kept without the rule. One pass
    of bitwise sums over the ledger; one row per policy and rule."""
    bits = F.col(f"{column}.failed")
    aggs, labels = [F.count(F.lit(1)).alias("all")], []
    for p in policies:
        mask = policy_mask(p)
        for r in POLICIES[p]:
            labels.append((p, r))
            test = [bits.bitwiseAND(F.lit(BITS[r]).cast("long")) != 0, bits.bitwiseAND(F.lit(mask).cast("long")) == BITS[r],
                    bits.bitwiseAND(F.lit(mask & ~BITS[r]).cast("long")) == 0]
            aggs += [F.count_if(t).alias(f"c{len(labels)}_{i}") for i, t in enumerate(test)]
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col("all").alias("n_docs"), F.col(f"c{j}_0").alias("n_failed"),
                     F.col(f"c{j}_1").alias("n_failed_alone"), F.col(f"c{j}_2").alias("n_kept_without"))
            for j, (p, r) in enumerate(labels, 1)]
    return ledgers.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Documents that pass the policy, with the columns they came with."""
    name = "ledger"
    while name in docs.columns:
        name += "_"
    return ledger(docs, docs.columns, text, name).where(~fails(policy, name)).drop(name)
