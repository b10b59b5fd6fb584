"""Queries with resampling, on the tables of q_loci and q_intervals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from helixmill.operators import loci as O
from helixmill.operators import resample as R
from helixmill.plans.q_kmers import rounded, unif
from helixmill.plans.q_loci import BASE, STRATA, by_nation, loci, strata
from helixmill.plans.q_scores import P, probs
from helixmill.plans.registry import query, table

CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def weight(key: str, seed: str) -> str:
    """A keyed Poisson(1) weight of `key` in replicate b, as SQL."""
    return "(" + " + ".join(f"({unif(key, 'b::VARCHAR', repr(seed))} >= {c!r}::DOUBLE)::INT" for c in CDF) + ")"


def drawn(keys: str) -> str:
    """Keyed Poisson counts k of the rows of d (the keys, mean, uniform numbers u and v), as the CTE k."""
    return f"""cdf AS (SELECT mean, j, sum(exp(-mean) * pow(mean, j) / gamma(j + 1)) OVER (PARTITION BY mean ORDER BY j) AS f FROM (SELECT DISTINCT mean FROM d WHERE mean <= 30), unnest(range(90)) t(j)),
k AS (SELECT {keys}, count(f)::DOUBLE AS k FROM d LEFT JOIN cdf ON cdf.mean = d.mean AND f <= u WHERE d.mean <= 30 GROUP BY ALL UNION ALL SELECT {keys}, greatest(0, round(mean + sqrt(mean) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v))) FROM d WHERE mean > 30)"""


def uv(*key: str) -> str:
    return f"{unif(*key)} AS u, {unif(*key, repr('n'))} AS v"


WIDE = f"{BASE}, w AS (SELECT locus, p_size, reference, max(value) FILTER (WHERE method = 'A') AS a, max(value) FILTER (WHERE method = 'R') AS r FROM g GROUP BY ALL)"


def wide(spark, d):
    return O.wide(loci(spark, d), ["locus", "p_size", "reference"], "method", "value", ["A", "R"])


def r2(x, y):
    return f"pow(sum(k) * sum(k * {x} * {y}) - sum(k * {x}) * sum(k * {y}), 2) / nullif((sum(k) * sum(k * {x} * {x}) - pow(sum(k * {x}), 2)) * (sum(k) * sum(k * {y} * {y}) - pow(sum(k * {y}), 2)), 0)"


@query(f"""WITH {WIDE}, m AS (SELECT * FROM w WHERE a IS NOT NULL AND r IS NOT NULL), b AS (SELECT m.*, b, {weight('locus::VARCHAR', '1')} AS k FROM m, unnest(range(50)) t(b)), dr AS (SELECT b, {r2('reference', 'a')} - {r2('reference', 'r')} AS d FROM b WHERE k > 0 GROUP BY b)
SELECT (SELECT count(*) FROM m) AS n, round((SELECT pow(corr(reference, a), 2) - pow(corr(reference, r), 2) FROM m), 6) AS delta_r2, round(quantile_cont(d, 0.025), 6) AS ci_lo, round(quantile_cont(d, 0.975), 6) AS ci_hi, round(avg((d <= 0)::INT), 6) AS p_le_zero, count(d) AS n_boot FROM dr""")
def r09_delta_r2(spark, d):
    return rounded(R.delta_r2(wide(spark, d), "locus", "reference", "A", "R", 50, "1"), "delta_r2", "ci_lo", "ci_hi", "p_le_zero")


@query(f"""WITH c AS (SELECT l_partkey AS key, count(*)::DOUBLE AS mean FROM lineitem GROUP BY 1), d AS (SELECT key, b, mean, {uv('key::VARCHAR', 'b::VARCHAR', "'0'")} FROM c, unnest(range(40)) t(b)), {drawn('key, b')},
h AS (SELECT b, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM k WHERE k > 0 GROUP BY b), e AS (SELECT log2(sum(mean)) - sum(mean * log2(mean)) / sum(mean) AS e FROM c)
SELECT round(e, 6) AS h, round(quantile_cont(h, 0.025) + e - avg(h), 6) AS low, round(quantile_cont(h, 0.975) + e - avg(h), 6) AS high FROM h, e GROUP BY e""")
def r11_entropy_interval(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c"))
    return rounded(R.entropy_interval(x, "l_partkey", "c", 40), "h", "low", "high")


@query("WITH c AS (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER () AS n FROM lineitem GROUP BY l_partkey), x AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e, sum(c / n * pow(log2(c / n), 2)) AS s, sum(c) AS t FROM c) SELECT round(e, 6) AS h, round(e - 1.959963984540054 * sqrt((s - e * e) / t), 6) AS low, round(e + 1.959963984540054 * sqrt((s - e * e) / t), 6) AS high FROM x")
def r11_entropy_interval_normal(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c"))
    return rounded(R.entropy_interval_normal(x, "c"), "h", "low", "high")


@query()
def r11_estimator_intervals(spark, d):
    """Plain, Miller-Madow and Chao-Shen entropy of the parts sold by each supplier, with their intervals."""
    from helixmill.operators.kmers import count_steps

    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("c"))
    return R.estimator_intervals(count_steps(x, ["l_suppkey"], "c"), ["l_suppkey"], 7, ["entropy", "miller_madow", "chao_shen"], 100)


@query(f"""WITH {P}, n AS (SELECT label, count(*) AS n FROM t GROUP BY label), x AS (SELECT r, label, n, -ln(1 - {unif('r::VARCHAR', 'label::VARCHAR', "'0m'")}) AS e FROM n, unnest(range(10)) u(r)), m AS (SELECT r, label, e / sum(e) OVER (PARTITION BY r) * 500 / n AS mean FROM x),
d AS (SELECT vec_id, label, p, r, mean, {uv('vec_id::VARCHAR', 'r::VARCHAR', "'0'")} FROM t JOIN m USING (label)), {drawn('vec_id, label, p, r')}, est AS (SELECT r, class, sum(k * p[class + 1]) AS s, sum(CASE WHEN label = class THEN k ELSE 0 END) AS w FROM k, unnest(range(10)) u(class) WHERE k > 0 GROUP BY ALL),
y AS (SELECT class, w / sum(w) OVER (PARTITION BY r) AS truth, s / sum(s) OVER (PARTITION BY r) AS estimate FROM est)
SELECT class::INT AS class, round(corr(truth, estimate), 6) AS pearson, round(2 * covar_pop(truth, estimate) / nullif(var_pop(truth) + var_pop(estimate) + pow(avg(truth) - avg(estimate), 2), 0), 6) AS ccc, round(avg(abs(estimate - truth)), 6) AS mae, round(avg(estimate - truth), 6) AS bias FROM y GROUP BY class""")
def r12_composition_bootstrap(spark, d):
    from helixmill.operators.scores import recovery

    x = R.composition_bootstrap(probs(spark, d), "vec_id", "label", "p", 10, 10, 500)
    return rounded(recovery(x, ["class"], "truth", "estimate"), "pearson", "ccc", "mae", "bias")


@query("""WITH t AS (SELECT o_orderpriority AS domain, count(*) FILTER (WHERE o_totalprice > 300000) AS a, count(*) AS inside FROM orders GROUP BY 1), x AS (SELECT *, sum(a) OVER () AS top, sum(inside) OVER () AS n FROM t)
SELECT domain, a, inside, top::BIGINT AS top, n::BIGINT AS n, round((a / top) / (inside / n), 6) AS enrichment, round(a * (n - inside - top + a) / nullif((inside - a) * (top - a), 0), 6) AS odds_ratio FROM x""")
def r13_domain_counts(spark, d):
    x = R.enrichment(R.domain_counts(table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 300_000))
    return rounded(x.select("domain", "a", "inside", "top", "n", "enrichment", "odds_ratio"), "enrichment", "odds_ratio")


@query("""WITH t AS (SELECT o_orderpriority AS domain, count(*) FILTER (WHERE o_totalprice > 300000) AS a, count(*) AS inside FROM orders GROUP BY 1), x AS (SELECT *, (sum(a) OVER ())::BIGINT AS top, (sum(inside) OVER ())::BIGINT AS n FROM t),
h AS (SELECT domain, a, j, exp(lgamma(top + 1) - lgamma(j + 1) - lgamma(top - j + 1) + lgamma(n - top + 1) - lgamma(inside - j + 1) - lgamma(n - top - inside + j + 1) - lgamma(n + 1) + lgamma(inside + 1) + lgamma(n - inside + 1)) AS p FROM x, unnest(range(greatest(0, inside + top - n), least(inside, top) + 1)) u(j)),
own AS (SELECT domain, p AS own FROM h WHERE j = a), q AS (SELECT domain, sum(p) FILTER (WHERE j >= a) AS p1, sum(p) FILTER (WHERE p <= own * (1 + 1e-7)) AS p2 FROM h JOIN own USING (domain) GROUP BY domain),
o AS (SELECT *, a * (n - inside - top + a) / nullif((inside - a) * (top - a), 0) AS r, 1.96 * sqrt(1 / nullif(a, 0) + 1 / nullif(inside - a, 0) + 1 / nullif(top - a, 0) + 1 / nullif(n - inside - top + a, 0)) AS w FROM x JOIN q USING (domain))
SELECT domain, a, inside, top, n, round((a / top) / (inside / n), 6) AS enrichment, round(r, 6) AS odds_ratio, round(exp(ln(nullif(r, 0)) - w), 6) AS or_lo, round(exp(ln(nullif(r, 0)) + w), 6) AS or_hi, round(p1, 6) AS p_enriched, round(least(p2, 1), 6) AS p_two_sided, CASE WHEN p1 < 1e-4 THEN '***' WHEN p1 < 1e-2 THEN '**' WHEN p1 < 0.05 THEN '*' ELSE 'ns' END AS sig FROM o""")
def r13_p26_enrichment(spark, d):
    x = R.enrichment(R.domain_counts(table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 300_000))
    return rounded(x, "enrichment", "odds_ratio", "or_lo", "or_hi", "p_enriched", "p_two_sided")


def lines(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("read"), (F.col("l_returnflag") == "R").alias("inside"), (F.col("l_quantity") > 40).alias("top"), F.col("l_extendedprice").alias("v"), "l_partkey", "l_returnflag")


ORDERS = "l AS (SELECT l_orderkey AS read, l_returnflag = 'R' AS i, l_quantity > 40 AS t FROM lineitem)"
#: The two-sided normal p of z by the approximation of functions.stats.normal_p, as SQL.
P_OF_Z = "least(1, x * exp(-z * z / 2 - 1.26551223 + x * (1.00002368 + x * (0.37409196 + x * (0.09678418 + x * (-0.18628806 + x * (0.27886807 + x * (-1.13520398 + x * (1.48851587 + x * (-0.82215223 + x * 0.17087277))))))))))"


def orders_as_reads(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), (F.col("l_returnflag") == "R").alias("inside"), (F.col("l_quantity") > 40).alias("top"))


@query(f"""WITH {ORDERS}, p AS (SELECT read, count(*) FILTER (WHERE i AND t) AS a, count(*) FILTER (WHERE i AND NOT t) AS b_, count(*) FILTER (WHERE NOT i AND t) AS c, count(*) FILTER (WHERE NOT i AND NOT t) AS d FROM l GROUP BY read),
k AS (SELECT p.*, b, {weight('read::VARCHAR', '2')} AS k FROM p, unnest(range(40)) t(b)), s AS (SELECT b, sum(k * a) AS a, sum(k * b_) AS b_, sum(k * c) AS c, sum(k * d) AS d FROM k GROUP BY b UNION ALL SELECT -1, sum(a), sum(b_), sum(c), sum(d) FROM p),
o AS (SELECT *, CASE WHEN least(a, b_, c, d) > 0 THEN a * d / (b_ * c) END AS o, CASE WHEN least(a, b_, c, d) > 0 THEN (a / (a + c)) / ((a + b_) / (a + b_ + c + d)) END AS e FROM s),
q AS (SELECT quantile_cont(o, 0.025) AS o1, quantile_cont(o, 0.975) AS o2, quantile_cont(e, 0.025) AS e1, quantile_cont(e, 0.975) AS e2, stddev_pop(ln(o)) AS sc FROM o WHERE b >= 0),
w AS (SELECT (a + b_ > 0) AS i, (a + c) / (a + b_ + c + d) AS x FROM p WHERE a + b_ = 0 OR c + d = 0), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM w), tt AS (SELECT sum(pow(t, 3) - t) AS t FROM (SELECT count(*) AS t FROM w GROUP BY x)),
u AS (SELECT count(*) FILTER (WHERE i) AS n1, count(*) FILTER (WHERE NOT i) AS n2, count(*) AS m, sum(r) FILTER (WHERE i) AS rs, avg(x) FILTER (WHERE i) AS m1, avg(x) FILTER (WHERE NOT i) AS m2 FROM r),
z AS (SELECT *, (rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((m + 1) - t / (m * (m - 1)))) AS z FROM u, tt), zp AS (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS x FROM z), pp AS (SELECT *, {P_OF_Z} AS p2 FROM zp),
n AS (SELECT sqrt(1 / greatest(a, 1) + 1 / greatest(b_, 1) + 1 / greatest(c, 1) + 1 / greatest(d, 1)) AS sn, a + b_ + c + d AS n_rows, o, e FROM o WHERE b = -1)
SELECT n_rows::BIGINT AS n_rows, (SELECT count(*) FROM p) AS n_reads, round(n_rows / (SELECT count(*) FROM p), 6) AS rows_per_read, round(o, 6) AS odds_ratio, round(o1, 6) AS or_lo, round(o2, 6) AS or_hi, round(e, 6) AS enrichment, round(e1, 6) AS enrichment_lo, round(e2, 6) AS enrichment_hi, round(sn, 6) AS se_naive, round(sc, 6) AS se_clustered, round(sc / sn, 6) AS design_effect,
  round(n_rows / pow(sc / sn, 2), 3) AS effective_n, n1 AS n_inside, n2 AS n_outside, round(m1, 6) AS mean_inside, round(m2, 6) AS mean_outside, round(m1 / m2, 6) AS read_ratio, round(CASE WHEN z > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END, 6) AS p_read FROM n, q, pp""")
def r14_clustered_enrichment(spark, d):
    x = R.clustered_enrichment(orders_as_reads(spark, d), "read", F.col("inside"), F.col("top"), 40, "2")
    return rounded(x.withColumn("effective_n", F.round("effective_n", 3)), *(c for c in x.columns if c not in ("n_rows", "n_reads", "n_inside", "n_outside", "effective_n")))


@query(f"""WITH l AS (SELECT l_orderkey % 500 AS read, (l_returnflag = 'R')::INT AS i, (l_quantity > 40)::INT AS t FROM lineitem), p AS (SELECT read, count(*) AS n, sum(i) AS k, sum(t) AS t, sum(i * t) AS x FROM l GROUP BY read HAVING sum(i) > 0 AND sum(i) < count(*)),
h AS (SELECT n, k, t, j, sum(exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(n - k + 1) - lgamma(t - j + 1) - lgamma(n - k - t + j + 1) - lgamma(n + 1) + lgamma(t + 1) + lgamma(n - t + 1))) OVER (PARTITION BY n, k, t ORDER BY j) AS f FROM (SELECT DISTINCT n, k, t FROM p), unnest(range(greatest(0, k + t - n)::BIGINT, least(k, t)::BIGINT)) u(j)),
d AS (SELECT read, n, k, t, b, {unif('read::VARCHAR', 'b::VARCHAR', "'5'")} AS u FROM p, unnest(range(100)) v(b)), g AS (SELECT b, greatest(0, d.k + d.t - d.n) + count(f) AS w FROM d LEFT JOIN h ON h.n = d.n AND h.k = d.k AND h.t = d.t AND f <= u GROUP BY b, read, d.n, d.k, d.t), nul AS (SELECT b, sum(w) AS w FROM g GROUP BY b),
s AS (SELECT count(*) AS n_straddling, sum(x)::BIGINT AS observed, sum(k * t / n) AS m, sum(CASE WHEN n > 1 THEN k * t / n * (1 - k / n) * (n - t) / (n - 1) ELSE 0 END) AS v FROM p)
SELECT n_straddling, observed, round(m, 6) AS expected, round(sqrt(v), 6) AS sd, round(avg(w), 6) AS null_mean, round((1 + count(*) FILTER (WHERE w >= observed)) / 101, 6) AS p FROM s, nul GROUP BY ALL""")
def r14_within_read_permutation(spark, d):
    x = R.within_read_permutation(lines(spark, d), "read", F.col("inside"), F.col("top"), 100, "5")
    return rounded(x, "expected", "sd", "null_mean", "p")


@query(f"""WITH {STRATA}, c AS (SELECT 'reference' AS family, '1-URGENT' AS a, method AS b FROM s WHERE method <> '1-URGENT' UNION SELECT 'within_quantifier', '2-HIGH', '5-LOW'), d AS (SELECT family, a || '-' || b AS contrast, x.stratum::VARCHAR AS stratum, x.v - y.v AS d FROM c JOIN s x ON x.method = a JOIN s y ON y.method = b AND x.stratum = y.stratum), w AS (SELECT d.*, b, {weight('stratum', '3')} AS k FROM d, unnest(range(50)) t(b)),
m AS (SELECT family, contrast, b, sum(k * d) / sum(k) AS m FROM w WHERE k > 0 GROUP BY ALL), q AS (SELECT family, contrast, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL)
SELECT family, contrast, count(*) AS n_strata, count(*) FILTER (WHERE d > 0) AS n_won, coalesce(string_agg(stratum, ',' ORDER BY stratum) FILTER (WHERE d <= 0), '') AS strata_lost, round(avg(d), 4) AS mean_delta, round(min(d), 4) AS min_delta, CASE WHEN count(*) >= 3 THEN round(any_value(lo), 4) END AS ci_lo, CASE WHEN count(*) >= 3 THEN round(any_value(hi), 4) END AS ci_hi, round(2 / pow(2, count(*)), 6) AS p_floor FROM d JOIN q USING (family, contrast) GROUP BY family, contrast""")
def r15_stratum_contrasts(spark, d):
    x = R.stratum_contrasts(strata(spark, d), "stratum", "method", "v", "1-URGENT", 50, "3", [("2-HIGH", "5-LOW"), ("2-HIGH", "absent")]).drop("wilcoxon_p")
    return x.withColumns({c: F.round(c, 4) for c in ("mean_delta", "min_delta", "ci_lo", "ci_hi")} | {"p_floor": F.round("p_floor", 6)})


@query()
def r15_wilcoxon(spark, d):
    return rounded(R.stratum_contrasts(strata(spark, d), "stratum", "method", "v", "1-URGENT", 20, "3").select("contrast", "wilcoxon_p"), "wilcoxon_p")


@query(f"""WITH {BASE}, w AS (SELECT locus, coalesce(max(n) FILTER (WHERE method = 'A'), 0) AS a, coalesce(max(n) FILTER (WHERE method = 'R'), 0) AS r FROM g GROUP BY locus), m AS (SELECT floor, locus, a, r FROM w, unnest([0, 5, 20]) t(floor) WHERE a + r >= floor), s AS (SELECT sum(a) AS na, sum(r) AS nr FROM w),
x AS (SELECT *, rank() OVER (PARTITION BY floor ORDER BY a) + (count(*) OVER (PARTITION BY floor, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY floor ORDER BY r) + (count(*) OVER (PARTITION BY floor, r) - 1) / 2 AS rr, log10(1 + a) AS la, log10(1 + r) AS lr FROM m),
own AS (SELECT floor, count(*) AS n_loci, count(*) FILTER (WHERE a > 0 AND r > 0) AS detected_both, corr(ra, rr) AS rho, pow(corr(la, lr), 2) AS r2, 2 * covar_samp(la, lr) / nullif(var_pop(la) + var_pop(lr) + pow(avg(la) - avg(lr), 2), 0) AS ccc FROM x GROUP BY floor),
d AS (SELECT floor, b, locus, 'a' AS side, (a + r) / (na + nr) * na AS mean, {uv('locus::VARCHAR', 'b::VARCHAR', "'0a'")} FROM m, s, unnest(range(5)) t(b) UNION ALL SELECT floor, b, locus, 'b', (a + r) / (na + nr) * nr, {uv('locus::VARCHAR', 'b::VARCHAR', "'0b'")} FROM m, s, unnest(range(5)) t(b)), {drawn('floor, b, locus, side')},
y AS (SELECT floor, b, locus, max(k) FILTER (WHERE side = 'a') AS a, max(k) FILTER (WHERE side = 'b') AS r FROM k GROUP BY ALL), z AS (SELECT floor, b, rank() OVER (PARTITION BY floor, b ORDER BY a) + (count(*) OVER (PARTITION BY floor, b, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY floor, b ORDER BY r) + (count(*) OVER (PARTITION BY floor, b, r) - 1) / 2 AS rr FROM y),
c AS (SELECT floor, b, corr(ra, rr) AS c FROM z GROUP BY ALL), q AS (SELECT floor, avg(c) AS c, quantile_cont(c, 0.05) AS lo, quantile_cont(c, 0.95) AS hi FROM c GROUP BY floor)
SELECT floor, n_loci, detected_both, round(rho, 6) AS rho, round(r2, 6) AS r2_log10, round(ccc, 6) AS ccc_log10, round(c, 6) AS ceiling, round(lo, 6) AS ceiling_p05, round(hi, 6) AS ceiling_p95, round(100 * rho / nullif(c, 0), 6) AS pct_of_ceiling FROM own LEFT JOIN q USING (floor)""")
def r16_noise_ceiling(spark, d):
    w = O.wide(loci(spark, d), ["locus"], "method", "n", ["A", "R"])
    x = R.noise_ceiling(w, "locus", "A", "R", [0, 5, 20], 5)
    return rounded(x, *x.columns[3:])


@query(f"""WITH {WIDE}, m AS (SELECT locus, coalesce(a, 0) AS c, p_size <= 10 AS f FROM w), b AS (SELECT m.*, b, {weight('locus::VARCHAR', '4')} AS k FROM m, unnest(range(50)) t(b)), s AS (SELECT b, 100 * sum(CASE WHEN f THEN k * c ELSE 0 END) / sum(k * c) AS s FROM b WHERE k > 0 GROUP BY b), o AS (SELECT 100 * sum(c) FILTER (WHERE f) / sum(c) AS p, sum(c) AS r FROM m)
SELECT round(p, 6) AS point, round(100 * sqrt(p / 100 * (1 - p / 100) / r), 6) AS binomial_se, round(quantile_cont(s, 0.025), 6) AS ci_lo, round(quantile_cont(s, 0.975), 6) AS ci_hi, round(stddev_samp(s), 6) AS boot_se, r AS reads FROM s, o GROUP BY p, r""")
def r17_share_reliability(spark, d):
    x = R.share_reliability(wide(spark, d).na.fill(0, ["A"]), "locus", "A", F.col("p_size") <= 10, 50, "4")
    return rounded(x, "point", "binomial_se", "ci_lo", "ci_hi", "boot_se")


@query()
def r03_partial_p(spark, d):
    x = O.partial_correlation(by_nation(spark, d), [], "x", "y", "n")
    return rounded(O.with_p(x), "r", "p")


@query("SELECT l_partkey AS kmer, round(avg(l_extendedprice), 8) AS mean, count(*) AS n, arg_max(l_returnflag, l_extendedprice) AS domain FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def a33_kmer_ranks(spark, d):
    x = lines(spark, d).withColumnRenamed("l_partkey", "kmer")
    return R.kmer_rank_table(x, "kmer", "v", "l_returnflag").withColumn("mean", F.round("mean", 8))


@query("SELECT l_partkey // 50 AS bin, round(avg(l_extendedprice), 8) AS mean, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def a34_binned_profile(spark, d):
    return R.binned_profile(lines(spark, d), "l_partkey", "v").withColumn("mean", F.round("mean", 8))


@query("WITH k AS (SELECT l_partkey AS kmer, round(avg(l_extendedprice), 8) AS mean FROM lineitem GROUP BY 1 HAVING count(*) >= 2) SELECT *, 'low' AS side FROM (SELECT * FROM k ORDER BY mean, kmer LIMIT 12) UNION ALL SELECT *, 'high' FROM (SELECT * FROM k ORDER BY mean DESC, kmer LIMIT 12)")
def t04_both_ends(spark, d):
    k = R.kmer_rank_table(lines(spark, d).withColumnRenamed("l_partkey", "kmer"), "kmer", "v", "l_returnflag").select("kmer", F.round("mean", 8).alias("mean"))
    return R.both_ends(k)
