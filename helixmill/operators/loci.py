"""Comparison of methods per locus and per chromosome. Long tables: locus, method, value (null: not estimated), reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.stats import r_p_value
from helixmill.operators.ranks import quantiles, running_sums, with_mid_ranks, with_totals
from helixmill.operators.scores import pearson


def correlations(rows: DataFrame, by: list[str], x: str, y: str, extra: list[Column] = []) -> DataFrame:
    """by, n, pearson_r2, spearman_rho over rows where both are there; null for fewer than 3 rows or a constant side."""
    good = with_mid_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, {"_rx": x, "_ry": y})
    out = good.groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("_r"), pearson("_rx", "_ry").alias("_s"), *extra)
    enough = F.col("n") >= 3
    return out.withColumns({"pearson_r2": F.when(enough, F.col("_r") ** 2), "spearman_rho": F.when(enough, F.col("_s"))}).drop("_r", "_s")


def percent_of_total(rows: DataFrame, by: list[str], value: str, out: str = "pct") -> DataFrame:
    return with_totals(rows, by, _sum=F.sum(value)).withColumn(out, 100 * F.col(value) / F.nullif("_sum", F.lit(0))).drop("_sum")


def joined_methods(reference: DataFrame, methods: dict[str, DataFrame], key: str) -> DataFrame:
    """Every locus of the reference or any method, with a value column for each; null where one has none."""
    out = reference
    for name, m in methods.items():
        out = out.join(m.select(key, F.col("value").alias(name)), key, "full_outer")
    return out


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, float], how: str = "outer") -> DataFrame:
    return left.join(right, key, how).fillna(defaults)


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join, or an error that names the first key that either side has twice."""
    for side in (left, right):
        if bad := side.groupBy(key).count().where("count > 1").limit(3).collect():
            raise ValueError(f"{key} comes more than once: {[r[key] for r in bad]}")
    return left.join(right, key, how)


def truth_of(elements: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    return elements.join(truth.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def wide(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return rows.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def long(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(keys, columns, name, value)


def profile(rows: DataFrame, by: list[str], count: str, flags: dict[str, Column] = {}) -> DataFrame:
    """Total, loci detected, over 1 % and with ten or more, shares of the top 1, 3 and 10, quantiles of the percentages, shares of flagged loci."""
    p = percent_of_total(rows, by, count, "_pct")
    c = F.col(count)
    share = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("_pct"))), F.lit(0.0))
    q = quantiles(p.where(c > 0), by, "_pct", [0.5, 0.9, 0.99], "_q").select(*(F.col(b).alias(f"_q_{i}") for i, b in enumerate(by)), "_q")
    out = p.groupBy(*by).agg(F.sum(count).alias("total"), F.count_if(c > 0).alias("detected"), F.count_if(F.col("_pct") > 1).alias("over_1pct"), F.count_if(c >= 10).alias("tens"), *(share(ok).alias(name) for name, ok in flags.items()))
    # the limit on row_number lets each task keep ten rows a group before the shuffle
    keys = [f"_k{i}" for i in range(len(by))]
    top = p.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), count, "_pct").withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(count)))).where("_i <= 10")
    top = top.groupBy(*keys).agg(*(share(F.col("_i") <= k).alias(f"top{k}") for k in (1, 3, 10)))
    out = out.join(top, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]).drop(*keys)
    out = out.join(q, [F.col(b).eqNullSafe(F.col(f"_q_{i}")) for i, b in enumerate(by)] or F.lit(True), "left").drop(*(f"_q_{i}" for i in range(len(by))))
    return out.select("*", *(F.col("_q")[i].alias(n) for i, n in enumerate(("median_pct", "p90_pct", "p99_pct")))).drop("_q")


def depth_gate(rows: DataFrame, by: list[str], count: str, least: int = 1000, each: int = 10, share: float = 1.0) -> DataFrame:
    """Per group the total, the loci over `share` % of it, those of them with `each` reads, the fewest reads of one, and whether the group is deep enough.

    It passes if the total reaches `least`, some locus is over `share` %, and every such locus has `each` reads.
    """
    over = F.col("_pct") > share
    out = percent_of_total(rows, by, count, "_pct").groupBy(*by).agg(
        F.sum(count).alias("total"), F.count_if(over).alias("loci_over"), F.count_if(over & (F.col(count) >= each)).alias("loci_deep"), F.min(F.when(over, F.col(count))).alias("fewest_reads"),
    )
    return out.withColumn("passes", (F.col("total") >= least) & (F.col("loci_over") > 0) & (F.col("loci_over") == F.col("loci_deep")))


def assignment_rate(summary: DataFrame, by: str, status: str, count: str) -> DataFrame:
    return summary.groupBy(by).agg((100 * F.sum(F.when(F.col(status) == "Assigned", F.col(count)).otherwise(0)) / F.sum(count)).alias("rate"))


def rescaled(rows: DataFrame, method: str, truth: str, value: str) -> DataFrame:
    """Values times sum(truth) / sum(value) of their method."""
    return with_totals(rows, [method], _truth=F.sum(truth), _sum=F.sum(value)).withColumn(value, F.col(value) * F.col("_truth") / F.nullif("_sum", F.lit(0))).drop("_truth", "_sum")


def stability(runs: DataFrame, run: str, metrics: list[str]) -> DataFrame:
    """n, mean, sample sd, min, max of each metric over runs."""
    m = runs.unpivot([run], metrics, "metric", "x")
    return m.groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))


def restriction_counts(wide_rows: DataFrame, restrictions: dict[str, Column], reference: str, methods: list[str]) -> DataFrame:
    """For each named restriction: loci, detected and over 1 % in the reference, common to all methods, estimated by each. One pass over loci x restrictions."""
    marked = wide_rows.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), ok.alias("on")) for n, ok in restrictions.items()))).alias("_on")).where("_on.on")
    common = reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in methods))
    r = F.col(reference)
    return marked.groupBy(F.col("_on.name").alias("restriction")).agg(F.count("*").alias("n"), F.count_if(r > 0).alias("detected"), F.count_if(r > 1).alias("over_1pct"), F.count_if(common).alias("common"), *(F.count(m).alias(f"n_{m}") for m in methods))


def dynamic_range(rows: DataFrame, method: str, value: str, benchmark: int, keep: Column) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(method).agg(F.count("*").alias("n"), (F.count("*") / benchmark).alias("share"), F.count_if(keep).alias("kept"), F.max(value).alias("most"), F.median(value).alias("median"))


def concentration(rows: DataFrame, by: list[str], value: str, shares: list[float] = [0.5, 0.9, 0.99]) -> DataFrame:
    """Loci that it takes, largest first, to reach each share of a group's sum."""
    steps = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    c = running_sums(steps, by, "_v", {"_i": "_n", "_c": "_s"}, descending=True)
    # inside a step all values are the same: of its _n loci, the first ones that reach the share
    need = lambda s: F.col("_i") - F.col("_n") + F.greatest(F.ceil((s * F.col("total__c") - (F.col("_c") - F.col("_s"))) / F.nullif("_v", F.lit(0)) - 1e-9), F.lit(1))
    reached = lambda s: F.col("_c") / F.col("total__c") >= s
    return c.groupBy(*by).agg(*(F.min(F.when(reached(s), need(s))).alias(f"n_{round(100 * s)}") for s in shares))


def dominant(rows: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(name, F.struct(value, name)).alias("dominant"), F.max(value).alias("value"))


def gradients(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Drop from the first to the last stratum, and the spread."""
    return rows.groupBy(*by).agg((F.min_by(value, order) - F.max_by(value, order)).alias("drop"), (F.max(value) - F.min(value)).alias("spread"))


def winners(rows: DataFrame, stratum: list[str], method: str, value: str) -> DataFrame:
    """How many strata each method leads; the first by name on ties."""
    w = Window.partitionBy(*stratum).orderBy(F.desc(value), method)
    return rows.withColumn("_i", F.row_number().over(w)).groupBy(method).agg(F.count("*").alias("n_strata"), F.count_if(F.col("_i") == 1).alias("n_top"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def min_max(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """To 0..1 in each group; 0.5 if constant."""
    return with_totals(rows, by, _lo=F.min(value), _hi=F.max(value)).withColumn(out, F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)), F.lit(0.5))).drop("_lo", "_hi")


#: Named sets of loci; each is a predicate on value, unit, pct (of the method's own total), reference and common.
LOCUS_SETS = {
    "F0_all": lambda: F.lit(True),
    "F1_common": lambda: F.col("common"),
    "F2_published": lambda: (F.col("reference") > 1) | (F.col("value") < 1),
    "F3_scalefree": lambda: (F.col("reference") > 1) | (F.col("pct") < 1),
    "F4_support": lambda: F.col("pct") >= 0.1,
    "F5_common_detected": lambda: F.col("common") & (F.col("reference") > 0),
    "F6_unit_aware": lambda: F.when(F.col("unit") == "TPM", F.col("reference") > 1).otherwise((F.col("reference") > 1) | (F.col("value") < 1)),
}


def definition_grid(rows: DataFrame, sets: dict = LOCUS_SETS) -> DataFrame:
    """Each method's fit in each set of loci, with the number and share of loci that the set removes. rows: locus, method, unit, value, pct, reference, common."""
    est = rows.where(F.col("value").isNotNull())
    every = est.groupBy("method").agg(F.count("*").alias("_all"))
    marked = est.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), f().alias("on")) for n, f in sets.items()))).alias("s")).where("s.on").withColumn("filter_def", F.col("s.name")).drop("s")
    out = correlations(marked, ["filter_def", "method"], "reference", "value").join(every, "method")
    return out.select("filter_def", "method", "n", "pearson_r2", "spearman_rho", (F.col("_all") - F.col("n")).alias("n_removed"), (1 - F.col("n") / F.col("_all")).alias("frac_removed"))


def paired_wins(grid: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Of each pair of methods: definitions, those where the first fits better, and the others' names."""
    spark = grid.sparkSession
    p = spark.createDataFrame(pairs, "a string, b string")
    x, y = (grid.select("filter_def", F.col("method").alias(c), F.col("pearson_r2").alias(f"r_{c}")) for c in ("a", "b"))
    both = p.join(x, "a").join(y, ["b", "filter_def"])
    lost = F.coalesce(F.col("r_a") <= F.col("r_b"), F.lit(False))
    return both.groupBy(F.concat_ws("-", "a", "b").alias("contrast")).agg(F.count("*").alias("n_definitions"), F.count_if(F.col("r_a") > F.col("r_b")).alias("n_won"), F.array_join(F.array_sort(F.collect_list(F.when(lost, F.col("filter_def")))), ",").alias("lost"))


def leave_out(rows: DataFrame, variants: dict[str, list[str]], locus: str, x: str, y: str, by: list[str]) -> DataFrame:
    """Fits after dropping each variant's loci."""
    grid = rows.sparkSession.createDataFrame([(n, d) for n, d in variants.items()], "variant string, _drop array<string>")
    kept = rows.crossJoin(F.broadcast(grid)).where(~F.array_contains("_drop", F.col(locus)))
    return correlations(kept, ["variant", *by], x, y)


def jackknife(rows: DataFrame, by: list[str], group: str, x: str, y: str) -> DataFrame:
    """Leave-one-group-out correlations from moments: the total's less each group's, no second scan. The full r, range, the most influential group and whether the sign can change."""
    a, b = F.col(x), F.col(y)
    m = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    m = m.withColumns({f"t_{c}": F.sum(c).over(w) for c in names})

    def r(c):
        n, sx, sy, sxx, syy, sxy = (c(k) for k in names)
        return (n * sxy - sx * sy) / F.nullif(F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0))), F.lit(0.0))

    m = m.withColumns({"full": r(lambda k: F.col(f"t_{k}")), "part": r(lambda k: F.col(f"t_{k}") - F.col(k))})
    return m.groupBy(*by).agg(F.first("full").alias("pearson_r"), F.min("part").alias("low"), F.max("part").alias("high"), (F.max("part") - F.min("part")).alias("range"), F.max_by(group, F.struct(F.round(F.abs(F.col("part") - F.col("full")), 9), group)).alias("most_influential"), (F.min("part") * F.max("part") < 0).alias("swings_sign"))


def partial_correlation(rows: DataFrame, by: list[str], x: str, y: str, z: str, ranked: bool = False) -> DataFrame:
    """n and r of x and y less what z explains (the correlation of the two residuals), from three correlations; null on a constant side. ranked: of average ranks."""
    if ranked:
        rows = with_mid_ranks(rows, by, {"_rx": x, "_ry": y, "_rz": z})
        x, y, z = "_rx", "_ry", "_rz"
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("xy"), pearson(x, z).alias("xz"), pearson(y, z).alias("yz"))
    r = (F.col("xy") - F.col("xz") * F.col("yz")) / F.nullif(F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)), F.lit(0.0))
    return out.withColumn("r", r).drop("xy", "xz", "yz")


def with_p(correlations: DataFrame, r: str = "r", n: str = "n", out: str = "p") -> DataFrame:
    """Adds the two-sided p of a correlation of n rows, or of n residuals, from t with n - 2 degrees of freedom."""
    return correlations.withColumn(out, r_p_value(r, F.col(n) - 2))


def adjusted_correlations(rows: DataFrame, own: list[str], other: list[str], covariates: dict[str, str], explained: str | None = None, share: float = 0.3) -> DataFrame:
    """A row a pair of an `own` and an `other` column: Pearson and Spearman with p, and for each covariate (name: column) the partial r with p and its difference from Pearson's r.

    explained: a covariate's name; `explains` is true where its partial r is under `share` of Pearson's r. The pairs are cells of
    one pass over the rows, each row once a pair.
    """
    z = [F.col(c).cast("double").alias(f"z_{n}") for n, c in covariates.items()]
    cells = F.array(*(F.struct(F.lit(a).alias("own"), F.lit(b).alias("other"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in own for b in other))
    long = rows.select(F.explode(cells).alias("_c"), *z).select("_c.*", *(f"z_{n}" for n in covariates))
    by = ["own", "other"]
    ranks = with_mid_ranks(long, by, {"_rx": "x", "_ry": "y"})
    out = with_p(with_p(ranks.groupBy(*by).agg(F.count("*").alias("n"), pearson("x", "y").alias("pearson_r"), pearson("_rx", "_ry").alias("spearman_rho")), "pearson_r", "n", "pearson_p"), "spearman_rho", "n", "spearman_p")
    for n in covariates:
        part = with_p(partial_correlation(long, by, "x", "y", f"z_{n}")).select(*by, F.col("r").alias(f"partial_r_{n}"), F.col("p").alias(f"partial_p_{n}"))
        out = out.join(part, by).withColumn(f"delta_r_{n}", F.col(f"partial_r_{n}") - F.col("pearson_r"))
    return out.withColumn("explains", F.abs(f"partial_r_{explained}") < share * F.abs("pearson_r")) if explained else out


def agreement(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Jaccard of detection, Spearman of values and Pearson of log10(1 + x)."""
    rows = with_mid_ranks(rows, by, {"_ra": a, "_rb": b}).withColumns({"_la": F.log10(1 + F.col(a)), "_lb": F.log10(1 + F.col(b))})
    on, off = F.col(a) > 0, F.col(b) > 0
    return rows.groupBy(*by).agg((F.count_if(on & off) / F.nullif(F.count_if(on | off), F.lit(0))).alias("jaccard"), pearson("_ra", "_rb").alias("spearman"), pearson("_la", "_lb").alias("pearson_log"))


def relative_difference(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) / F.nullif(F.greatest(a, b), F.lit(0))


def version_difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Of two versions' values (null as 0): loci in both, in one only, and quantiles of the relative difference where both have some."""
    r = rows.fillna(0, [a, b]).withColumn("_d", F.when((F.col(a) > 0) & (F.col(b) > 0), relative_difference(a, b)))
    q = r.agg(F.count("_d").alias("n_both"), F.count_if((F.col(a) > 0) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(b) > 0) & (F.col(a) == 0)).alias("only_b"), F.max("_d").alias("most"))
    q = q.join(quantiles(r, [], "_d", [0.5, 0.95], "_q"), how="left")
    return q.select("n_both", "only_a", "only_b", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p95"), "most")


def linear_fit(rows: DataFrame, by: list[str], name: str, x: str, y: str) -> DataFrame:
    """slope, intercept, r2 and the row of the largest residual, per panel."""
    fit = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    res = rows.join(fit, by).withColumn("_e", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")))
    return fit.join(res.groupBy(*by).agg(F.max_by(name, F.struct(F.round("_e", 6), name)).alias("outlier")), by)


def correction_sensitivity(rows: DataFrame, factors: list[tuple[str, float]], minority: Column, x: str, y: str, by: list[str]) -> DataFrame:
    """Fits with the minority loci's values times each factor, and their change against the factor `none`."""
    grid = rows.sparkSession.createDataFrame([*factors, ("none", 1.0)], "correction string, _f double")
    r = rows.crossJoin(F.broadcast(grid)).withColumn("_v", F.when(minority, F.col(y) * F.col("_f")).otherwise(F.col(y)))
    fits = r.groupBy("correction", *by).agg((pearson(x, "_v") ** 2).alias("r2"))
    base = fits.where("correction = 'none'").select(*by, F.col("r2").alias("_base"))
    return fits.join(base, by).withColumn("delta", F.col("r2") - F.col("_base")).drop("_base")


def verified(got: DataFrame, published: DataFrame, key: list[str], value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Published values with ours and whether they are close; false where we have none."""
    ours = got.select(*key, F.col(value).alias("_ours"))
    return published.join(ours, key, "left").select(*key, value, F.col("_ours").alias("ours"), F.coalesce(F.abs(F.col("_ours") - F.col(value)) <= atol + rtol * F.abs(value), F.lit(False)).alias("ok"))


def parameter_importance(rows: DataFrame, parameters: list[str], score: str) -> DataFrame:
    """abs(Spearman) of each parameter with the score."""
    m = rows.unpivot([score], parameters, "parameter", "x")
    m = with_mid_ranks(m, ["parameter"], {"_rx": "x", "_ry": score})
    return m.groupBy("parameter").agg(F.abs(pearson("_rx", "_ry")).alias("importance")).orderBy(F.desc("importance"))


def protocol_contrast(profiles: DataFrame, arm: str, treated: str, control: str, share: str) -> DataFrame:
    """Ratio of a share in the treated to that in the control arm, and whether it rose."""
    t, c = (profiles.where(F.col(arm) == a).select(F.col(share).alias(n)) for a, n in ((treated, "_t"), (control, "_c")))
    return t.crossJoin(c).select(F.col("_t").alias("treated"), F.col("_c").alias("control"), (F.col("_t") / F.nullif("_c", F.lit(0))).alias("ratio")).withColumn("rises", F.col("ratio") > 1)


def packed_blocks(rows: DataFrame, shard: str, order: str, ids: str, size: int) -> DataFrame:
    """(shard, block, ids): a shard's arrays joined end to end in order and cut into blocks of `size`; the rest of a shard goes.

    A shard is a bounded batch of rows; offsets are running sums of sizes inside it.
    """
    w = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = rows.select(shard, F.col(ids).alias("_ids"), (F.sum(F.size(ids)).over(w) - F.size(ids)).alias("_from"))
    one = at.select(shard, "_from", F.posexplode("_ids").alias("_i", "_id")).withColumn("_at", F.col("_from") + F.col("_i"))
    blocks = one.groupBy(shard, F.floor(F.col("_at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", "_id"))).alias("_x"))
    return blocks.where(F.size("_x") == size).select(shard, "block", F.transform("_x", lambda x: x["_id"]).alias(ids))
