"""Sequence functions as Column expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# fixed values: base order and complements
BASES = "ACGT"
COMPLEMENT_FROM = "ACGTN"
COMPLEMENT_TO = "TGCAN"
# fixed values: limits and defaults of the file formats
MAX_OCCURRENCE = 65534
SEED_LENGTH = 32
LINE_WIDTH = 80
DEFAULT_READ_LENGTH = 100


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode(seq) -> Column:
    """Letters to digits 0..4, case-insensitive; anything unknown is 4."""
    known = F.translate(F.upper(c(seq)), "ACGT", "0123")
    return F.regexp_replace(known, "[^0-3]", "4")


def decode(digits) -> Column:
    return F.translate(c(digits), "01234", "ACGTN")


def revcomp(seq) -> Column:
    return F.reverse(F.translate(c(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def canonical(kmer) -> Column:
    return F.least(c(kmer), revcomp(kmer))


def unpack(packed, k: int) -> Column:
    """BIGINT k-mer (2 bits a base, k <= 31) back to letters."""
    digits = F.lpad(F.conv(c(packed).cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", BASES)


def pack(kmer, k: int | None = None) -> Column:
    return F.conv(F.translate(c(kmer), BASES, "0123"), 4, 10).cast("bigint")


def known_length(seq) -> Column:
    """Number of bases other than N."""
    return F.length(F.replace(c(seq), F.lit("N"), F.lit("")))


def trim_unknown(seq) -> Column:
    """Drop N at both ends."""
    return F.regexp_replace(c(seq), "^N+|N+$", "")


def known_pieces(seq) -> Column:
    """Array of the maximal pieces without N."""
    return F.filter(F.split(c(seq), "N+"), lambda p: F.length(p) > 0)


def close_ratio(a, b, ratio: float) -> Column:
    return (c(a) * F.lit(ratio) >= c(b)) & (c(b) * F.lit(ratio) >= c(a))


def base_of_flag(flag) -> Column:
    """Base code when exactly one of the four low bits is set, else 4."""
    f = c(flag).bitwiseAND(F.lit(15))
    out = F.lit(4)
    for code in range(4):
        out = F.when(f == F.lit(1 << code), F.lit(code)).otherwise(out)
    return out


def flag_count(flag) -> Column:
    return F.bit_count(c(flag).bitwiseAND(F.lit(15)))


def mismatches(a, b) -> Column:
    """Ungapped mismatches of two equally long sequences; N never counts."""
    pairs = F.zip_with(F.split(c(a), ""), F.split(c(b), ""),
                       lambda x, y: F.when((x != y) & (x != "N") & (y != "N"), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def identity_ok(a, b, identity: float) -> Column:
    # the allowance is a whole number of bases
    return mismatches(a, b) <= F.floor(F.lit(1.0 - identity) * F.length(c(a)) + F.lit(1e-9))


def _longest(lengths: Column, test) -> Column:
    return F.coalesce(F.get(F.filter(lengths, test), F.lit(0)), F.lit(0)).cast("int")


def overlap_length(a, b, low, high) -> Column:
    """Longest n in [low, high] with suffix(a, n) = prefix(b, n), else 0."""
    a, b = c(a), c(b)
    top = F.least(F.lit(high), F.length(a), F.length(b)).cast("int")
    lengths = F.when(top >= low, F.sequence(top, F.lit(low).cast("int"), F.lit(-1)))
    return _longest(lengths, lambda n: F.right(a, n) == F.left(b, n))


def self_overlap(seq, low) -> Column:
    """Longest proper prefix that is also a suffix, at least ``low`` long."""
    s = c(seq)
    top = (F.length(s) - 1).cast("int")
    lengths = F.when(top >= low, F.sequence(top, F.lit(low).cast("int"), F.lit(-1)))
    return _longest(lengths, lambda n: F.left(s, n) == F.right(s, n))


def common_trim(a, b) -> Column:
    """Struct (prefix, suffix): lengths shared at either end of two sequences,
    each at most half of the shorter one."""
    a, b = c(a), c(b)
    half = F.floor(F.least(F.length(a), F.length(b)) / 2).cast("int")
    lengths = F.when(half >= 1, F.sequence(half, F.lit(1), F.lit(-1)))
    return F.struct(_longest(lengths, lambda n: F.left(a, n) == F.left(b, n)).alias("prefix"),
                    _longest(lengths, lambda n: F.right(a, n) == F.right(b, n)).alias("suffix"))


def header_number(name, key: str, default: int) -> Column:
    """Number behind ``key`` in a header such as ``seq1_len500_cov12``."""
    hit = F.regexp_extract(c(name), key + r"([0-9]+)", 1)
    return F.coalesce(F.when(hit != "", hit.cast("bigint")), F.lit(default).cast("bigint"))


def header_length_like(name, key: str) -> Column:
    """As ``header_number``; values up to 1 mean the default read length."""
    v = header_number(name, key, 0)
    return F.when(v <= 1, F.lit(DEFAULT_READ_LENGTH).cast("bigint")).otherwise(v)


def barcode(header) -> Column:
    hit = F.regexp_extract(c(header), r"BX:Z:([0-9A-Za-z]+)", 1)
    return F.when(hit != "", hit)


def wrap(seq, width: int = LINE_WIDTH) -> Column:
    """Insert a line break after every ``width`` letters."""
    return F.regexp_replace(c(seq), "(.{%d})(?=.)" % width, "$1\n")


def rendered(seq, strand, gap) -> Column:
    """A part of a layout as text: N for the gap before it, or trimmed by the
    overlap when the gap is negative; reversed on the minus strand."""
    s = F.when(c(strand) < 0, revcomp(seq)).otherwise(c(seq))
    g = c(gap)
    return F.when(g >= 0, F.concat(F.repeat(F.lit("N"), g.cast("int")), s)).otherwise(
        F.substring(s, (F.lit(1) - g).cast("int"), F.length(s)))


def register(spark: SparkSession) -> None:
    """Make the sequence functions available to SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING "
              f"RETURN reverse(translate(s, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canonical_kmer(s STRING) RETURNS STRING "
              f"RETURN least(s, reverse(translate(s, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS ARRAY<STRING> "
              "RETURN CASE WHEN length(s) >= k THEN filter(transform(sequence(1, length(s) - k + 1), "
              "i -> substring(s, i, k)), x -> NOT contains(x, 'N')) ELSE array() END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION overlap_len(a STRING, b STRING, low INT) RETURNS INT "
              "RETURN coalesce(filter(sequence(least(length(a), length(b)), 1, -1), "
              "n -> n >= low AND right(a, n) = left(b, n))[0], 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION self_overlap(a STRING, low INT) RETURNS INT "
              "RETURN coalesce(filter(sequence(greatest(length(a) - 1, 1), 1, -1), "
              "n -> n >= low AND n < length(a) AND right(a, n) = left(a, n))[0], 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION saturating_count(n BIGINT) RETURNS INT "
              f"RETURN cast(least(n, {MAX_OCCURRENCE}) as int)")
