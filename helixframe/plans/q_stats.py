"""Queries on distributions and summary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import decreased_cutoff, error_function, expected_links, join_log_probability, normal_density, placements
from ..operators import stats as st
from . import fixtures as fx
from .catalog import query
from .fixtures import sql

# insert sizes of the driver tables: folded text lengths give a peaked histogram
_INS = ", ins AS (SELECT 200 + n_chars % 400 AS len, count(*) AS n FROM documents GROUP BY 1)"


def _inserts(spark, d):
    t = fx.table(spark, d, "documents").select((F.col("n_chars") % 400 + 200).alias("len"))
    return st.histogram(t, "len")


def _read_lengths(spark, d):
    return fx.reads(spark, d).select("read_id", F.length("seq").cast("bigint").alias("len"))


@query("insert_size_histogram", "S22 T4", sql(_INS + " SELECT len, n FROM ins", "reads"))
def insert_size_histogram(spark, d):
    return _inserts(spark, d)


_PEAK = _INS + """, ctr AS (SELECT unnest(range(len - 50, len + 51)) AS centre, n FROM ins),
    sums AS (SELECT centre, sum(n) AS s FROM ctr WHERE centre >= 50 AND centre <= (SELECT max(len) FROM ins) - 50 GROUP BY 1),
    peak AS (SELECT centre AS peak FROM sums ORDER BY s DESC, centre LIMIT 1)"""


@query("insert_size_peak", "W2", sql(_PEAK + " SELECT peak FROM peak", "reads"))
def insert_size_peak(spark, d):
    return st.moving_sum_peak(_inserts(spark, d))


@query("insert_size_estimate", "A24 A25", sql(_PEAK + """,
    lim AS (SELECT peak, least(cast(floor(peak * 1.75 + 0.5) as bigint), (SELECT max(len) FROM ins)) AS upper FROM peak),
    lim2 AS (SELECT peak, least(cast(floor(peak * 0.25 + 0.5) as bigint), upper) AS lower, upper FROM lim),
    inside AS (SELECT len, n FROM ins, lim2 WHERE len BETWEEN lower AND upper),
    m AS (SELECT cast(floor(sum(len * n) / sum(n) + 1.0) as bigint) AS mean FROM inside),
    s AS (SELECT cast(floor(sqrt(sum((len - mean) * (len - mean) * n) / (sum(n) - 1)) + 0.5) as bigint) AS sd FROM inside, m)
    SELECT peak, lower, upper, mean, sd FROM lim2, m, s""", "reads"))
def insert_size_estimate(spark, d):
    return st.insert_size(_inserts(spark, d))


@query("read_length_mean", "A29 A6", sql(" SELECT round(sum(length(seq)) / count(*), 6) AS mean FROM reads", "reads"))
def read_length_mean(spark, d):
    h = st.histogram(_read_lengths(spark, d), "len")
    return st.weighted_mean(h, "len").select(F.round("mean", 6).alias("mean"))


_LENS = ", lens AS (SELECT cast(length(seq) as bigint) AS len FROM reads)"


@query("n_statistics", "A26 S24", sql(_LENS + """,
    h AS (SELECT len, count(*) AS n FROM lens GROUP BY 1),
    r AS (SELECT len, n, sum(len * n) OVER (ORDER BY len DESC) AS cum, sum(len * n) OVER () AS total FROM h)
    SELECT cast(sum(n) as bigint) AS n, cast(max(total) as bigint) AS total, min(len) AS shortest, max(len) AS longest,
    round(max(total) / sum(n), 6) AS mean, """ + ", ".join(
        f"max(CASE WHEN cum * 100 >= total * {q} THEN len END) AS n{q}" for q in range(10, 100, 10)) + " FROM r", "reads"))
def n_statistics(spark, d):
    return st.n_statistics(_read_lengths(spark, d)).withColumn("mean", F.round("mean", 6))


@query("read_length_suffix_totals", "W6 A35", sql(_LENS + """, h AS (SELECT len, count(*) AS n FROM lens GROUP BY 1)
    SELECT len, cast(sum(n) OVER (ORDER BY len DESC) as bigint) AS num,
    cast(sum(len * n) OVER (ORDER BY len DESC) as bigint) AS total FROM h""", "reads"))
def read_length_suffix_totals(spark, d):
    return st.suffix_totals(_read_lengths(spark, d))


@query("histogram_tails_cut", "A27", sql(_LENS + """, h AS (SELECT len, count(*) AS n FROM lens GROUP BY 1),
    r AS (SELECT len, n, sum(n) OVER (ORDER BY len) AS lo, sum(n) OVER (ORDER BY len DESC) AS hi, sum(n) OVER () AS t FROM h)
    SELECT len, n FROM r WHERE lo > t * 0.05 AND hi > t * 0.05""", "reads"))
def histogram_tails_cut(spark, d):
    return st.truncate_tails(st.histogram(_read_lengths(spark, d), "len"), 0.05)


@query("histogram_normalised", "A28", sql(_INS + """,
    c AS (SELECT p_size * 100 AS l, count(*) AS m FROM part GROUP BY 1),
    p AS (SELECT len, n, (SELECT sum(greatest(l + 1 - len, 0) * m) FROM c) AS places FROM ins),
    q AS (SELECT *, n / places AS rate FROM p WHERE places > 0)
    SELECT len, n, cast(places as bigint) AS places,
    round(rate * (SELECT sum(n) / sum(rate) FROM q), 6) AS normalised FROM q""", "reads"))
def histogram_normalised(spark, d):
    r = st.placement_normalised(_inserts(spark, d), fx.nodes(spark, d))
    return r.withColumn("normalised", F.round("normalised", 6))


@query("coverage_local_minimum", "A7", sql("""
    , h AS (SELECT cov % 97 + 1 AS v, count(*) AS n FROM nodes GROUP BY 1),
    g AS (SELECT unnest(range(1, (SELECT max(v) FROM h) + 2)) AS v0),
    s AS (SELECT v0, coalesce((SELECT sum(n) FROM h WHERE v >= v0 AND v < v0 + 3), 0) AS s FROM g),
    t AS (SELECT v0, s, lead(s) OVER (ORDER BY v0) AS nx FROM s)
    SELECT cast(min(v0) as bigint) AS minimum FROM t WHERE nx >= s""", "nodes"))
def coverage_local_minimum(spark, d):
    h = st.histogram(fx.nodes(spark, d), F.col("cov") % 97 + 1, "v")
    return st.left_local_minimum(h, "v", 3)


@query("coverage_weighted_mean", "A14 P10", sql(
    " SELECT round(sum(cov * len) / sum(len), 6) AS mean FROM nodes WHERE len >= 1000", "nodes"))
def coverage_weighted_mean(spark, d):
    return st.length_weighted_coverage(fx.nodes(spark, d), 1000).select(F.round("mean", 6).alias("mean"))


_SKEWED = """, nod AS (SELECT node, len, CASE WHEN node % 50 = 0 THEN cov * 500 WHEN node % 51 = 0 THEN 1 ELSE cov END AS cov FROM nodes)"""


def _skewed_nodes(spark, d):
    n = F.col("node")
    return fx.nodes(spark, d).withColumn(
        "cov", F.when(n % 50 == 0, F.col("cov") * 500).when(n % 51 == 0, 1).otherwise(F.col("cov")))


@query("coverage_without_outliers", "A15", sql(_SKEWED + """,
    f AS (SELECT sum(cov * len) / sum(len) AS m FROM nod WHERE len >= 1000)
    SELECT round(sum(cov * len) / sum(len), 6) AS mean FROM nod, f WHERE len >= 1000 AND cov >= m / 100 AND cov <= m * 100""", "nodes"))
def coverage_without_outliers(spark, d):
    return st.coverage_without_outliers(_skewed_nodes(spark, d), 1000).select(F.round("mean", 6).alias("mean"))


@query("coverage_truncated_mean", "A22", sql(_SKEWED + """,
    f AS (SELECT floor(sum(cov * len) / sum(len) + 0.5) AS m FROM nod)
    SELECT cast(floor(sum(cov * len) / sum(len) + 0.5) as bigint) AS mean FROM nod, f WHERE cov <= m * 2 AND cov * 2 >= m""", "nodes"))
def coverage_truncated_mean(spark, d):
    return st.truncated_coverage(_skewed_nodes(spark, d))


@query("coverage_hetero_mean", "A23", sql("""
    , h AS (SELECT len, CASE WHEN node % 3 = 0 THEN cov ELSE cov / 2.0 END AS cov FROM nodes
      WHERE node % 3 = 0 OR (SELECT count(*) FROM nodes WHERE node % 3 = 0) < 10000),
    f AS (SELECT floor(sum(cov * len) / sum(len) + 0.5) AS m FROM h)
    SELECT cast(floor(sum(cov * len) / sum(len) + 0.5) as bigint) AS mean FROM h, f WHERE cov <= m * 2 AND cov * 2 >= m""", "nodes"))
def coverage_hetero_mean(spark, d):
    return st.hetero_coverage(fx.nodes(spark, d).withColumn("bubble", F.col("node") % 3 == 0))


@query("median_by_cluster", "A40 A42", sql("""
    , r AS (SELECT cluster, len, row_number() OVER (PARTITION BY cluster ORDER BY len) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM nodes)
    SELECT cluster, len AS med FROM r WHERE rn = n // 2 + 1""", "nodes"))
def median_by_cluster(spark, d):
    return st.median_by(fx.nodes(spark, d), ["cluster"], "len", "med")


@query("bubble_quartile_length", "A46", sql("""
    , r AS (SELECT len, row_number() OVER (ORDER BY len) AS rn, count(*) OVER () AS n FROM nodes WHERE node % 3 = 0)
    SELECT len AS quartile FROM r WHERE rn = n // 4 + 1""", "nodes"))
def bubble_quartile_length(spark, d):
    h = st.histogram(fx.nodes(spark, d).where("node % 3 = 0"), "len")
    from pyspark.sql import Window
    run = h.withColumn("cum", F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)))
    total = h.agg(F.sum("n").alias("t")).scalar()
    return run.where(F.col("cum") > F.floor(total / 4)).agg(F.min("len").alias("quartile"))


@query("empirical_tail", "W20 F22", sql("""
    , v AS (SELECT cast(floor(cov % 89 / 8.0) as bigint) AS bin FROM nodes),
    h AS (SELECT bin, count(*) AS n FROM v GROUP BY 1),
    r AS (SELECT bin, n, sum(CASE WHEN bin = 0 THEN n * 1.0::double ELSE n / (SELECT sum(n) FROM h) END) OVER (ORDER BY bin) AS cdf FROM h)
    SELECT bin, n, round(cdf, 6) AS cdf, round(1.0 - cdf, 6) AS tail FROM r""", "nodes"))
def empirical_tail(spark, d):
    v = fx.nodes(spark, d).select((F.col("cov") % 89).alias("v"))
    t = st.empirical_distribution(v, "v", 8.0)
    return t.select("bin", "n", F.round("cdf", 6).alias("cdf"), F.round("tail", 6).alias("tail"))


@query("empirical_tail_lookup", "F22", sql("""
    , v AS (SELECT cast(floor(cov % 89 / 8.0) as bigint) AS bin FROM nodes WHERE cov % 89 > 8 AND cov % 89 < 70),
    h AS (SELECT bin, count(*) AS n FROM v GROUP BY 1),
    r AS (SELECT bin, 1 - sum(n / (SELECT sum(n) FROM h)) OVER (ORDER BY bin) AS tail FROM h),
    q AS (SELECT node, cast(floor((len % 7900) / 100.0 / 8.0) as bigint) AS b FROM nodes)
    SELECT node, round(CASE WHEN b > (SELECT max(bin) FROM h) THEN 0.0
      ELSE coalesce((SELECT max_by(tail, bin) FROM r WHERE bin <= b), 1.0) END, 6) AS p FROM q""", "nodes"))
def empirical_tail_lookup(spark, d):
    n = fx.nodes(spark, d)
    v = n.select((F.col("cov") % 89).alias("v")).where("v > 8 and v < 70")
    dist = st.empirical_distribution(v, "v", 8.0)
    q = n.select("node", (F.col("len") % 7900 / 100.0).alias("x"))
    return st.tail_probability(q, "x", dist, "p", 8.0).select("node", F.round("p", 6).alias("p"))


@query("gap_likelihood", "A12", sql("""
    , s AS (SELECT id1, id2, 300 + off1 * 3 - off2 AS observed FROM links),
    g AS (SELECT unnest(range(-60, 61)) AS gap),
    l AS (SELECT id1, id2, gap, count(*) AS n, round(sum(-power(observed + gap - 320.0, 2) / 1800), 9) AS ll FROM s, g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY ll DESC, gap) AS rn FROM l)
    SELECT id1, id2, n, gap FROM r WHERE rn = 1""", "links"))
def gap_likelihood(spark, d):
    s = fx.links(spark, d).select("id1", "id2", (F.lit(300) + F.col("off1") * 3 - F.col("off2")).alias("observed"))
    return st.best_gap(s, ["id1", "id2"], 320.0, 30.0, -60, 60)



@query("normal_density", "F12", sql("""
    SELECT node, round(exp(-0.5 * power((len / 100.0 - 25) / 9.0, 2)) / (sqrt(2 * pi()) * 9.0), 9) AS p FROM nodes""", "nodes"))
def normal_density_query(spark, d):
    return fx.nodes(spark, d).select("node", F.round(normal_density(F.col("len") / 100.0, F.lit(25.0), F.lit(9.0)), 9).alias("p"))


@query("join_log_probability", "F13", sql("""
    , m AS (SELECT node, (cov % 40 + 1) * (150.0 - 75 + 1) / 150.0 AS m FROM nodes)
    SELECT node, round(-(50 + 1.0) * exp(-m) * (1 + m + m * m / 2 + m * m * m / 6), 6) AS lp FROM m""", "nodes"))
def join_log_probability_query(spark, d):
    p = join_log_probability(F.col("cov") % 40 + 1, F.lit(150.0), 4, 75, 25)
    return fx.nodes(spark, d).select("node", F.round(p, 6).alias("lp"))


_LP = ["1"]
for _i in range(1, 4):
    _LP.append(_LP[-1] + " + " + " * ".join(["m"] * _i) + f" / {[1, 1, 2, 6][_i]}")


@query("coverage_cutoff_decrease", "F14", sql("""
    , m AS (SELECT node, (cov % 40 + 1) * (150.0 - 75 + 1) / 150.0 AS m FROM nodes)
    SELECT node, CASE """ + " ".join(
        f"WHEN -(51.0) * exp(-m) * ({_LP[i - 1]}) > -0.02 THEN {i}" for i in (4, 3, 2)) + " ELSE 1 END AS cutoff FROM m", "nodes"))
def coverage_cutoff_decrease(spark, d):
    cut = decreased_cutoff(F.col("cov") % 40 + 1, F.lit(150.0), 4, -0.02, 75, 25)
    return fx.nodes(spark, d).select("node", cut.alias("cutoff"))


@query("placement_count", "F15", sql("""
    , e AS (SELECT id1, id2, gap, a.len AS l1, b.len AS l2 FROM links JOIN nodes a ON a.node = id1 JOIN nodes b ON b.node = id2)
    SELECT id1, id2, gap, l1, l2, cast(least(least(greatest(0, 400 - greatest(gap, 0) - 100 + 1), greatest(0, least(l1, l2) + 50 + 1)),
      greatest(0, l1 + l2 + gap - 400 + 1)) as bigint) AS ways FROM e""", "links", "nodes"))
def placement_count(spark, d):
    n = fx.nodes(spark, d).select("node", "len")
    e = (fx.links(spark, d).select("id1", "id2", "gap")
         .join(n.select(F.col("node").alias("id1"), F.col("len").alias("l1")), "id1")
         .join(n.select(F.col("node").alias("id2"), F.col("len").alias("l2")), "id2"))
    return e.withColumn("ways", placements("l1", "l2", "gap", 400, 100))


# erf by the same series: terms t_n = t_(n-1) * 2 x^2 / (2n + 1), as a product over n
def _erf_sql(x: str) -> str:
    series = (f"list_sum(list_transform(range(0, 161), lambda n: CASE WHEN {x} = 0 THEN 0.0 ELSE "
              f"sign({x}) * exp((2 * n + 1) * ln(abs({x})) + n * ln(2.0) - "
              f"list_sum(list_transform(range(0, n + 1), lambda j: ln(2.0 * j + 1)))) END))")
    return f"CASE WHEN abs({x}) > 6 THEN sign({x}) ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {series} END"


@query("error_function", "F9", sql(f"""
    , v AS (SELECT DISTINCT (cov % 130 - 65) / 20.0::double AS x FROM nodes)
    SELECT x, round({_erf_sql('x')}, 9) AS y FROM v""", "nodes"))
def error_function_query(spark, d):
    v = fx.nodes(spark, d).select(((F.col("cov") % 130 - 65) / 20.0).alias("x")).distinct()
    return v.select("x", F.round(error_function("x"), 9).alias("y"))


_U = {"a": "l1 + gap - 350 + l2", "b": "100 + gap - 350 + l2", "c": "l1 + gap - 350 + 100", "d": "100 + gap - 350 + 100"}


def _f_sql(u: str) -> str:
    s = "(sqrt(2.0) * 40)"
    return f"({u}) * e_{u} + {s} / sqrt(pi()) * exp(-power({u} / {s}, 2))"


@query("expected_link_count", "F9 F10", sql("""
    , e AS (SELECT DISTINCT id1, id2, gap, a.len AS l1, b.len AS l2 FROM links JOIN nodes a ON a.node = id1 JOIN nodes b ON b.node = id2),
    u AS (SELECT *, """ + ", ".join(f"cast({v} as double) AS {k}" for k, v in _U.items()) + " FROM e), w AS (SELECT *, "
    + ", ".join(_erf_sql(f"({k} / (sqrt(2.0) * 40))") + f" AS e_{k}" for k in _U) + " FROM u) SELECT id1, id2, gap, round((30 / 400.0) * ("
    + f"{_f_sql('a')} - ({_f_sql('b')}) - ({_f_sql('c')}) + {_f_sql('d')}" + "), 5) + 0.0 AS expected FROM w", "links", "nodes"))
def expected_link_count(spark, d):
    n = fx.nodes(spark, d).select("node", "len")
    e = (fx.links(spark, d).select("id1", "id2", "gap").distinct()
         .join(n.select(F.col("node").alias("id1"), F.col("len").alias("l1")), "id1")
         .join(n.select(F.col("node").alias("id2"), F.col("len").alias("l2")), "id2"))
    x = expected_links(F.lit(30.0), F.col("l1"), F.col("l2"), F.col("gap"), F.lit(350), F.lit(40.0), F.lit(100))
    return e.select("id1", "id2", "gap", (F.round(x, 5) + 0.0).alias("expected"))      # no negative zero
