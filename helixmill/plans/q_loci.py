"""Queries per locus. Parts stand for loci, return flags for methods (summed quantities for values), the retail price for the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import loci as O
from helixmill.plans.q_kmers import rounded
from helixmill.plans.registry import query, table

M = ["A", "N", "R"]
BASE = """v AS (SELECT l_partkey AS locus, l_returnflag AS method, sum(l_quantity) AS value, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 OR l_returnflag <> 'R' GROUP BY ALL),
r AS (SELECT p_partkey AS locus, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_retailprice END AS raw, p_brand AS family, p_size FROM part), r2 AS (SELECT *, 100 * raw / sum(raw) OVER () AS reference FROM r),
g AS (SELECT locus, family, p_size, reference, method, value, n, 100 * value / sum(value) OVER (PARTITION BY method) AS pct, count(value) OVER (PARTITION BY locus) = 3 AS common FROM r2 CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS method) LEFT JOIN v USING (locus, method))"""


def values(spark, d):
    x = table(spark, d, "lineitem").where("l_partkey % 3 <> 0 or l_returnflag <> 'R'")
    return x.groupBy(F.col("l_partkey").alias("locus"), F.col("l_returnflag").alias("method")).agg(F.sum("l_quantity").alias("value"), F.count("*").alias("n"))


def reference(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("locus"), F.col("p_brand").alias("family"), "p_size", F.when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("raw"))
    return r.crossJoin(F.broadcast(r.agg(F.sum("raw").alias("s")))).select("locus", "family", "p_size", (100 * F.col("raw") / F.col("s")).alias("reference"))


def loci(spark, d):
    from pyspark.sql import Window

    names = spark.createDataFrame([(m,) for m in M], ["method"])
    g = reference(spark, d).crossJoin(F.broadcast(names)).join(values(spark, d), ["locus", "method"], "left")
    g = O.percent_of_total(g, ["method"], "value")
    return g.withColumn("common", F.count("value").over(Window.partitionBy("locus")) == 3).withColumn("unit", F.when(F.col("method") == "R", "TPM").otherwise("RPM"))


@query(f"WITH {BASE} SELECT locus, reference IS NOT NULL AS in_reference, max(value) FILTER (WHERE method = 'A') AS A, max(value) FILTER (WHERE method = 'N') AS N, max(value) FILTER (WHERE method = 'R') AS R FROM g GROUP BY ALL")
def j11_a21_joined_methods(spark, d):
    v = values(spark, d)
    out = O.joined_methods(reference(spark, d), {m: v.where(F.col("method") == m) for m in M}, "locus")
    return out.select("locus", F.col("reference").isNotNull().alias("in_reference"), *M)


@query(f"WITH {BASE} SELECT locus, method, round(pct, 6) AS pct FROM g WHERE value IS NOT NULL")
def a20_a22_percent(spark, d):
    w = O.wide(loci(spark, d), ["locus"], "method", "pct", M)
    return rounded(O.long(w, ["locus"], M, "method", "pct").where("pct is not null"), "pct")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS orders, coalesce(b.n, 1) AS lines FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def j12_with_defaults(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("lines"))
    return O.with_defaults(a, b, "k", {"orders": 0, "lines": 1})


@query("SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey")
def j13_one_to_one(spark, d):
    return O.one_to_one(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), "k")


@query("SELECT p_partkey AS k, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def j14_truth_default(spark, d):
    t = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return O.truth_of(table(spark, d, "part").select(F.col("p_partkey").alias("k")), t, "k", "n")


@query(f"""WITH {BASE}, e AS (SELECT * FROM g WHERE value IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY value DESC) AS i FROM e)
SELECT method, sum(value) AS total, count(*) FILTER (WHERE value > 0) AS detected, count(*) FILTER (WHERE pct > 1) AS over_1pct, count(*) FILTER (WHERE value >= 10) AS tens, round(sum(pct) FILTER (WHERE i <= 1), 6) AS top1, round(sum(pct) FILTER (WHERE i <= 3), 6) AS top3, round(sum(pct) FILTER (WHERE i <= 10), 6) AS top10,
round(coalesce(sum(pct) FILTER (WHERE p_size <= 10), 0), 6) AS young, round(quantile_cont(pct, 0.5), 6) AS median_pct, round(quantile_cont(pct, 0.9), 6) AS p90_pct, round(quantile_cont(pct, 0.99), 6) AS p99_pct FROM i GROUP BY method""")
def a29_profile(spark, d):
    e = loci(spark, d).where("value is not null")
    p = O.profile(e, ["method"], "value", {"young": F.col("p_size") <= 10})
    return rounded(p, "top1", "top3", "top10", "young", "median_pct", "p90_pct", "p99_pct")


@query(f"WITH {BASE} SELECT method, sum(value) AS total, count(*) FILTER (WHERE pct > 1) AS loci_over, count(*) FILTER (WHERE pct > 1 AND value >= 10) AS loci_deep, min(value) FILTER (WHERE pct > 1) AS fewest_reads, sum(value) >= 1000 AND count(*) FILTER (WHERE pct > 1) > 0 AND coalesce(bool_and(value >= 10) FILTER (WHERE pct > 1), false) AS passes FROM g WHERE value IS NOT NULL GROUP BY method")
def a30_depth_gate(spark, d):
    return O.depth_gate(loci(spark, d).where("value is not null"), ["method"], "value")


@query("SELECT o_orderpriority, round(100 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY 1")
def a31_assignment_rate(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "Assigned").otherwise("x").alias("s")).agg(F.count("*").alias("n"))
    return rounded(O.assignment_rate(x, "o_orderpriority", "s", "n"), "rate")


@query(f"WITH {BASE} SELECT locus, method, round(value * sum(reference) OVER (PARTITION BY method) / sum(value) OVER (PARTITION BY method), 8) AS value FROM g WHERE value IS NOT NULL")
def a35_rescaled(spark, d):
    return O.rescaled(loci(spark, d).where("value is not null"), "method", "reference", "value").select("locus", "method", F.round("value", 8).alias("value"))


@query("SELECT metric, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS low, max(x) AS high FROM (SELECT 'quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY metric")
def a37_stability(spark, d):
    x = table(spark, d, "lineitem").withColumnsRenamed({"l_quantity": "quantity", "l_tax": "tax"})
    return rounded(O.stability(x, "l_orderkey", ["quantity", "tax"]), "mean", "sd")


@query(f"""WITH {BASE}, w AS (SELECT locus, p_size, reference, max(value) FILTER (WHERE method = 'A') AS A, max(value) FILTER (WHERE method = 'N') AS N, max(value) FILTER (WHERE method = 'R') AS R FROM g GROUP BY ALL), x AS (SELECT 'all' AS restriction, * FROM w UNION ALL SELECT 'small', * FROM w WHERE p_size <= 10)
SELECT restriction, count(*) AS n, count(*) FILTER (WHERE reference > 0) AS detected, count(*) FILTER (WHERE reference > 1) AS over_1pct, count(*) FILTER (WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL) AS common, count(A) AS "n_A", count(N) AS "n_N", count(R) AS "n_R" FROM x GROUP BY restriction""")
def a41_restriction_counts(spark, d):
    w = O.wide(loci(spark, d), ["locus", "p_size", "reference"], "method", "value", M)
    return O.restriction_counts(w, {"all": F.lit(True), "small": F.col("p_size") <= 10}, "reference", M)


@query(f"WITH {BASE} SELECT method, count(*) AS n, round(count(*) / 1000, 6) AS share, count(*) FILTER (WHERE pct >= 0.1) AS kept, max(value) AS most, median(value) AS median FROM g WHERE value IS NOT NULL GROUP BY method")
def a42_dynamic_range(spark, d):
    return rounded(O.dynamic_range(loci(spark, d), "method", "value", 1000, F.col("pct") >= 0.1), "share")


@query(f"WITH {BASE}, c AS (SELECT method, row_number() OVER (PARTITION BY method ORDER BY reference DESC, locus) AS i, sum(reference) OVER (PARTITION BY method ORDER BY reference DESC, locus ROWS UNBOUNDED PRECEDING) / sum(reference) OVER (PARTITION BY method) AS c FROM g) SELECT method, min(i) FILTER (WHERE c >= 0.5) AS n_50, min(i) FILTER (WHERE c >= 0.9) AS n_90 FROM c GROUP BY method")
def w01_concentration(spark, d):
    return O.concentration(loci(spark, d), ["method"], "reference", [0.5, 0.9])


@query(f"WITH {BASE} SELECT method, arg_max(locus, value * 10000000 + locus) AS dominant, max(value) AS value FROM g WHERE value IS NOT NULL GROUP BY method")
def w02_dominant(spark, d):
    return O.dominant(loci(spark, d).where("value is not null"), ["method"], "locus", "value")


@query("""WITH w AS (SELECT doc_id // 50 AS shard, doc_id, i, length(string_split(text, ' ')[i]) AS id FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) t(i)), o AS (SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY doc_id, i) - 1 AS p FROM w)
SELECT shard, p // 512 AS block, sum(id)::BIGINT AS total, min(id)::BIGINT AS low, count(*) AS n FROM o GROUP BY ALL HAVING count(*) = 512""")
def w04_packed_blocks(spark, d):
    x = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("shard"), "doc_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"))
    b = O.packed_blocks(x, "shard", "doc_id", "ids", 512)
    return b.select("shard", "block", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, y: a + y).alias("total"), F.array_min("ids").alias("low"), F.size("ids").cast("bigint").alias("n"))


FIT = "CASE WHEN count(*) >= 3 THEN pow(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 2) END"
GRIDQ = f"""{BASE}, e AS (SELECT * FROM g WHERE value IS NOT NULL), s AS (SELECT 'F0_all' AS filter_def, * FROM e UNION ALL SELECT 'F1_common', * FROM e WHERE common UNION ALL SELECT 'F2_published', * FROM e WHERE reference > 1 OR value < 1 UNION ALL SELECT 'F3_scalefree', * FROM e WHERE reference > 1 OR pct < 1
UNION ALL SELECT 'F4_support', * FROM e WHERE pct >= 0.1 UNION ALL SELECT 'F5_common_detected', * FROM e WHERE common AND reference > 0 UNION ALL SELECT 'F6_unit_aware', * FROM e WHERE reference > 1 OR (method <> 'R' AND value < 1)), k AS (SELECT *, rank() OVER (PARTITION BY filter_def, method ORDER BY reference) + (count(*) OVER (PARTITION BY filter_def, method, reference) - 1) / 2 AS rx, rank() OVER (PARTITION BY filter_def, method ORDER BY value) + (count(*) OVER (PARTITION BY filter_def, method, value) - 1) / 2 AS ry FROM s),
al AS (SELECT method, count(*) AS al FROM e GROUP BY method), dg AS (SELECT filter_def, method, count(*) AS n, {FIT.format(x='reference', y='value')} AS r2, CASE WHEN count(*) >= 3 THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS rho FROM k GROUP BY ALL)"""


@query(f"WITH {GRIDQ} SELECT filter_def, method, n, round(r2, 6) AS pearson_r2, round(rho, 6) AS spearman_rho, al - n AS n_removed, round(1 - n / al, 6) AS frac_removed FROM dg JOIN al USING (method)")
def r01_r02_r06_w06_definition_grid(spark, d):
    return rounded(O.definition_grid(loci(spark, d)), "pearson_r2", "spearman_rho", "frac_removed")


@query(f"WITH {GRIDQ}, p AS (SELECT a.filter_def, a.r2 AS ra, b.r2 AS rb FROM dg a JOIN dg b ON a.filter_def = b.filter_def AND a.method = 'A' AND b.method = 'R') SELECT 'A-R' AS contrast, count(*) AS n_definitions, count(*) FILTER (WHERE ra > rb) AS n_won, coalesce(string_agg(filter_def, ',' ORDER BY filter_def) FILTER (WHERE ra <= rb), '') AS lost FROM p")
def r07_paired_wins(spark, d):
    return O.paired_wins(O.definition_grid(loci(spark, d)), [("A", "R")])


@query(f"WITH {BASE}, t AS (SELECT 'full' AS variant, * FROM g WHERE common UNION ALL SELECT 'drop', * FROM g WHERE common AND locus NOT IN (1, 2, 3, 4)) SELECT variant, method, count(*) AS n, round({FIT.format(x='reference', y='value')}, 6) AS pearson_r2 FROM t GROUP BY ALL")
def r08_leave_out(spark, d):
    x = loci(spark, d).where("common").withColumn("name", F.col("locus").cast("string"))
    return rounded(O.leave_out(x, {"full": [], "drop": ["1", "2", "3", "4"]}, "name", "reference", "value", ["method"]).drop("spearman_rho"), "pearson_r2")


@query(f"WITH {BASE} SELECT p_size <= 25 AS small, method, count(*) AS n, round({FIT.format(x='reference', y='value')}, 6) AS pearson_r2 FROM g WHERE common GROUP BY ALL")
def r10_restricted_fits(spark, d):
    x = loci(spark, d).where("common").withColumn("small", F.col("p_size") <= 25)
    return rounded(O.correlations(x, ["small", "method"], "reference", "value").drop("spearman_rho"), "pearson_r2")


NAT = "x AS (SELECT c_nationkey AS chrom, sum(c_acctbal) AS x, count(*) AS n, sum(c_acctbal * (c_custkey % 7)) AS y FROM customer GROUP BY 1)"


def by_nation(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("chrom")).agg(F.sum("c_acctbal").alias("x"), F.count("*").alias("n"), F.sum(F.col("c_acctbal") * (F.col("c_custkey") % 7)).alias("y"))


@query(f"""WITH {NAT}, j AS (SELECT a.chrom, (SELECT corr(x, y) FROM x) AS f, (SELECT corr(b.x, b.y) FROM x b WHERE b.chrom <> a.chrom) AS p FROM x a) SELECT round(max(f), 6) AS pearson_r, round(min(p), 6) AS low, round(max(p), 6) AS high, round(max(p) - min(p), 6) AS range, arg_max(chrom, abs(p - f)) AS most_influential, min(p) * max(p) < 0 AS swings_sign FROM j""")
def r04_jackknife(spark, d):
    return rounded(O.jackknife(by_nation(spark, d), [], "chrom", "x", "y"), "pearson_r", "low", "high", "range")


@query(f"WITH {NAT}, c AS (SELECT corr(x, y) AS a, corr(x, n) AS b, corr(y, n) AS c, count(*) AS n FROM x) SELECT n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS r FROM c")
def r03_partial_correlation(spark, d):
    return rounded(O.partial_correlation(by_nation(spark, d), [], "x", "y", "n"), "r")


RANKS = "k AS (SELECT (rank() OVER (ORDER BY x) + rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, (2 * rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y, (2 * rank() OVER (ORDER BY n) + count(*) OVER (PARTITION BY n) - 1) / 2.0 AS n FROM x)"


@query(f"WITH {NAT}, {RANKS}, c AS (SELECT corr(x, y) AS a, corr(x, n) AS b, corr(y, n) AS c, count(*) AS n FROM k) SELECT n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS r FROM c")
def r03_partial_spearman(spark, d):
    return rounded(O.partial_correlation(by_nation(spark, d), [], "x", "y", "n", ranked=True), "r")


@query(f"WITH {NAT}, {RANKS}, c AS (SELECT corr(x, y) AS a, corr(x, n) AS b, corr(y, n) AS c, count(*) AS n FROM x) SELECT 'x' AS own, 'y' AS other, n, round(a, 6) AS pearson_r, round((SELECT corr(x, y) FROM k), 6) AS spearman_rho, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial_r_size, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)) - a, 6) AS delta_r_size, abs((a - b * c) / sqrt((1 - b * b) * (1 - c * c))) < 0.3 * abs(a) AS explains FROM c")
def r03_adjusted_correlations(spark, d):
    out = O.adjusted_correlations(by_nation(spark, d), ["x"], ["y"], {"size": "n"}, "size")
    return rounded(out.drop("pearson_p", "spearman_p", "partial_p_size"), "pearson_r", "spearman_rho", "partial_r_size", "delta_r_size")


@query(f"WITH {NAT} SELECT round(corr(x / (x + n), y / (x + n)), 6) AS r FROM x")
def r05_composition(spark, d):
    x = by_nation(spark, d).select((F.col("x") / (F.col("x") + F.col("n"))).alias("a"), (F.col("y") / (F.col("x") + F.col("n"))).alias("b"))
    return rounded(x.agg(O.pearson("a", "b").alias("r")), "r")


@query(f"""WITH {BASE}, w AS (SELECT locus, coalesce(max(n) FILTER (WHERE method = 'A'), 0) AS a, coalesce(max(n) FILTER (WHERE method = 'R'), 0) AS b FROM g GROUP BY locus), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM w)
SELECT round(count(*) FILTER (WHERE a > 0 AND b > 0) / count(*) FILTER (WHERE a > 0 OR b > 0), 6) AS jaccard, round(corr(ra, rb), 6) AS spearman, round(corr(log10(1 + a), log10(1 + b)), 6) AS pearson_log FROM k""")
def r18_agreement(spark, d):
    w = O.wide(loci(spark, d), ["locus"], "method", "n", ["A", "R"]).na.fill(0).withColumn("one", F.lit(1))
    return rounded(O.agreement(w, ["one"], "A", "R").drop("one"), "jaccard", "spearman", "pearson_log")


@query(f"""WITH {BASE}, w AS (SELECT locus, coalesce(max(value) FILTER (WHERE method = 'A'), 0) AS a, coalesce(max(value) FILTER (WHERE method = 'R'), 0) AS b FROM g GROUP BY locus), k AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN abs(a - b) / greatest(a, b) END AS d FROM w)
SELECT count(d) AS n_both, count(*) FILTER (WHERE a > 0 AND b = 0) AS only_a, count(*) FILTER (WHERE b > 0 AND a = 0) AS only_b, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS most FROM k""")
def r19_version_difference(spark, d):
    w = O.wide(loci(spark, d), ["locus"], "method", "value", ["A", "R"])
    return rounded(O.version_difference(w, "A", "R"), "median", "p95", "most")


@query(f"WITH {BASE}, w AS (SELECT locus, coalesce(max(value) FILTER (WHERE method = 'A'), 0) AS a, coalesce(max(value) FILTER (WHERE method = 'R'), 0) AS b FROM g GROUP BY locus) SELECT locus, round(abs(a - b) / greatest(a, b), 6) AS d FROM w WHERE greatest(a, b) > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def t02_t03_largest_differences(spark, d):
    w = O.wide(loci(spark, d), ["locus"], "method", "value", ["A", "R"]).na.fill(0)
    return w.select("locus", F.round(O.relative_difference("A", "R"), 6).alias("d")).where("d is not null").orderBy(F.desc("d"), "locus").limit(10)


@query("""WITH f AS (SELECT o_orderpriority AS panel, regr_slope(o_totalprice, o_custkey) AS slope, regr_intercept(o_totalprice, o_custkey) AS intercept, regr_r2(o_totalprice, o_custkey) AS r2 FROM orders GROUP BY 1), e AS (SELECT f.*, o_orderkey, round(abs(o_totalprice - slope * o_custkey - intercept), 6) AS e FROM orders JOIN f ON panel = o_orderpriority)
SELECT panel, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, arg_max(o_orderkey, e) AS outlier FROM e GROUP BY ALL""")
def r20_linear_fit(spark, d):
    x = O.linear_fit(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "panel"), ["panel"], "o_orderkey", "o_custkey", "o_totalprice")
    return x.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6)})


@query(f"WITH {BASE}, x AS (SELECT c, method, reference, CASE WHEN p_size <= 10 THEN value * f ELSE value END AS v FROM g, (VALUES ('recall', 1 / 0.8), ('both', 0.5 / 0.8), ('none', 1.0)) t(c, f) WHERE value IS NOT NULL), k AS (SELECT c AS correction, method, pow(corr(reference, v), 2) AS r2 FROM x GROUP BY ALL) SELECT a.correction, method, round(a.r2, 6) AS r2, round(a.r2 - b.r2, 6) AS delta FROM k a JOIN k b USING (method) WHERE b.correction = 'none'")
def r21_correction_sensitivity(spark, d):
    x = loci(spark, d).where("value is not null")
    return rounded(O.correction_sensitivity(x, [("recall", 1 / 0.8), ("both", 0.5 / 0.8)], F.col("p_size") <= 10, "reference", "value", ["method"]), "r2", "delta")


@query("WITH g AS (SELECT l_suppkey AS k, round(avg(l_extendedprice), 4) AS ours FROM lineitem WHERE l_discount > 0 GROUP BY 1), s AS (SELECT s_suppkey AS k, round(avg(l_extendedprice) / 2) * 2 AS v FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_discount > 0 GROUP BY 1) SELECT k, v, ours, coalesce(abs(ours - v) <= 1e-8 + 1e-5 * abs(v), false) AS ok FROM s LEFT JOIN g USING (k)")
def r22_verified(spark, d):
    """Means against the same ones rounded to even units, as a report would print them: some are within the tolerance, some are not."""
    x = table(spark, d, "lineitem").where("l_discount > 0")
    ours = x.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
    printed = table(spark, d, "supplier").join(x, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy(F.col("s_suppkey").alias("k")).agg((F.round(F.avg("l_extendedprice") / 2, 0) * 2).alias("v"))
    return O.verified(ours, printed, ["k"], "v")


@query("WITH m AS (SELECT 'quantity' AS parameter, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'tax', l_tax, l_extendedprice FROM lineitem), k AS (SELECT parameter, rank() OVER (PARTITION BY parameter ORDER BY x) + (count(*) OVER (PARTITION BY parameter, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY parameter ORDER BY y) + (count(*) OVER (PARTITION BY parameter, y) - 1) / 2 AS ry FROM m) SELECT parameter, round(abs(corr(rx, ry)), 6) AS importance FROM k GROUP BY 1")
def r23_parameter_importance(spark, d):
    x = table(spark, d, "lineitem").withColumnsRenamed({"l_quantity": "quantity", "l_tax": "tax"})
    return rounded(O.parameter_importance(x, ["quantity", "tax"], "l_extendedprice"), "importance")


@query(f"WITH {BASE}, y AS (SELECT method, sum(pct) FILTER (WHERE p_size <= 10) AS s FROM g WHERE value IS NOT NULL GROUP BY method) SELECT round(a.s, 6) AS treated, round(b.s, 6) AS control, round(a.s / b.s, 6) AS ratio, a.s / b.s > 1 AS rises FROM y a, y b WHERE a.method = 'A' AND b.method = 'R'")
def r24_protocol_contrast(spark, d):
    p = O.profile(loci(spark, d).where("value is not null"), ["method"], "value", {"young": F.col("p_size") <= 10})
    return rounded(O.protocol_contrast(p, "method", "A", "R", "young"), "treated", "control", "ratio")


STRATA = "s AS (SELECT month(o_orderdate)::INT AS stratum, o_orderpriority AS method, avg(o_totalprice) AS v FROM orders GROUP BY ALL)"


def strata(spark, d):
    return table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("stratum"), F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("v"))


@query(f'WITH {STRATA} SELECT method, round(arg_min(v, stratum) - arg_max(v, stratum), 4) AS "drop", round(max(v) - min(v), 4) AS spread FROM s GROUP BY method')
def w07_gradients(spark, d):
    return O.gradients(strata(spark, d), ["method"], "stratum", "v").withColumns({"drop": F.round("drop", 4), "spread": F.round("spread", 4)})


@query(f"WITH {STRATA}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY v DESC, method) AS i FROM s) SELECT method, count(*) AS n_strata, count(*) FILTER (WHERE i = 1) AS n_top, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(min(v), 4) AS low, round(max(v), 4) AS high FROM k GROUP BY method")
def w08_winners(spark, d):
    return O.winners(strata(spark, d), ["stratum"], "method", "v").withColumns({c: F.round(c, 4) for c in ("mean", "sd", "low", "high")})


@query(f"WITH {STRATA} SELECT stratum, method, round((v - min(v) OVER (PARTITION BY method)) / (max(v) OVER (PARTITION BY method) - min(v) OVER (PARTITION BY method)), 6) AS x FROM s")
def w09_min_max(spark, d):
    return O.min_max(strata(spark, d), ["method"], "v", "x").select("stratum", "method", F.round("x", 6).alias("x"))


@query("SELECT o_orderpriority AS lib, round(1e6 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 4) AS rpm, count(*) FILTER (WHERE o_orderstatus = 'F') >= 0.75 * count(*) AS mostly FROM orders GROUP BY 1")
def p20_unit_scaling(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("lib")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("p"), F.count("*").alias("t"))
    return g.select("lib", F.round(1e6 * F.col("p") / F.nullif("t", F.lit(0)), 4).alias("rpm"), (F.col("p") >= 0.75 * F.col("t")).alias("mostly"))
