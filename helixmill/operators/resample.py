"""Bootstraps with keyed Poisson weights, enrichment and noise ceilings. A replicate is a number; a row's weight in it depends on the row's key, the replicate and a seed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.stats import fisher_greater, fisher_two, normal_p, wilcoxon_p
from helixmill.operators.moments import HELD, keyed_uniforms, poisson_counts, replicate_sums
from helixmill.operators.ranks import running_sums, with_mid_ranks
from helixmill.operators.scores import pearson


def r2_terms(x: str, y: str, name: str) -> dict[str, Column]:
    """Terms of replicate_sums from which r2_of has the squared correlation of x and y."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return {f"{name}_x": a, f"{name}_y": b, f"{name}_xx": a * a, f"{name}_yy": b * b, f"{name}_xy": a * b}


def r2_of(name: str) -> Column:
    """Squared correlation under the weights, from their sums; null on a constant side."""
    n, x, y, xx, yy, xy = (F.col(c) for c in ("w", *(f"{name}_{k}" for k in ("x", "y", "xx", "yy", "xy"))))
    top = n * xy - x * y
    return top * top / F.nullif((n * xx - x**2) * (n * yy - y**2), F.lit(0.0))


def percentiles(column: str, *shares: float) -> Column:
    return F.percentile(column, F.array(*map(F.lit, shares)))


def delta_r2(rows: DataFrame, key: str, reference: str, a: str, b: str, n: int = 200, seed: str = "0") -> DataFrame:
    """Observed difference of the two methods' r2 on the same loci, 95 % interval of the paired bootstrap and the share of replicates at or below 0."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = replicate_sums(rows, key, r2_terms(reference, a, "a") | r2_terms(reference, b, "b"), n, seed)
    draws = sums.select((r2_of("a") - r2_of("b")).alias("d"))
    ci = draws.agg(percentiles("d", 0.025, 0.975).alias("q"), F.avg((F.col("d") <= 0).cast("double")).alias("p_le_zero"), F.count("d").alias("n_boot"))
    own = rows.agg(F.count("*").alias("n"), (pearson(reference, a) ** 2 - pearson(reference, b) ** 2).alias("delta_r2"))
    return own.crossJoin(ci).select("n", "delta_r2", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "p_le_zero", "n_boot")


def _k_log_k(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (k * np.log2(np.maximum(k, 1)))[:, :, None]


def entropy_interval(counts: DataFrame, key: str, count: str, n: int = 100, alpha: float = 0.05, seed: str = "0") -> DataFrame:
    """Entropy with an interval: replicates of Poisson counts keyed by type, shifted so that their mean is the estimate; h twice for at most one type. Poisson counts are exact up to a mean of 30 and normal beyond (`estimator_intervals` draws them exactly)."""
    base = _plug_in(counts, count)
    drawn = replicate_sums(counts, key, {"c": F.col(count).cast("double")}, n, seed, draw=lambda u, v, x: poisson_counts(x[:, :1], u, v), made=_k_log_k, names=["klogk"])
    hs = drawn.where("w > 0").select((F.log2("w") - F.col("klogk") / F.col("w")).alias("b"))
    q = hs.agg(percentiles("b", alpha / 2, 1 - alpha / 2).alias("q"), F.avg("b").alias("m"))
    bound = lambda i: F.when(F.col("types") > 1, F.col("q")[i] - F.col("m") + F.col("h")).otherwise(F.col("h"))
    return base.crossJoin(q).select("h", bound(0).alias("low"), bound(1).alias("high"))


def entropy_interval_normal(counts: DataFrame, count: str, alpha: float = 0.05) -> DataFrame:
    """Entropy with the normal interval of the plug-in variance, for well-sampled counts: one pass, no draws."""
    from statistics import NormalDist

    lg, h = F.log2("N"), F.col("h")
    second = F.col("s2") / F.col("N") - 2 * lg * F.col("s1") / F.col("N") + lg * lg
    half = F.when(F.col("types") > 1, NormalDist().inv_cdf(1 - alpha / 2) * F.sqrt(F.greatest(F.lit(0.0), (second - h**2) / F.col("N")))).otherwise(0.0)
    return _plug_in(counts, count).select("h", F.greatest(F.lit(0.0), h - half).alias("low"), (h + half).alias("high"))


def _plug_in(counts: DataFrame, count: str) -> DataFrame:
    """One row: types, N, the sums of c log2 c and c (log2 c)^2, and the entropy h."""
    c = F.col(count).cast("double")
    base = counts.agg(F.count("*").alias("types"), F.sum(c).alias("N"), F.sum(c * F.log2(c)).alias("s1"), F.sum(c * F.log2(c) ** 2).alias("s2"))
    return base.withColumn("h", F.log2("N") - F.col("s1") / F.col("N"))


def _poisson_range(mean: float) -> tuple[int, np.ndarray]:
    """The first value and the probabilities of a Poisson distribution where they add up to 1 within a double's precision."""
    reach = 12 * math.sqrt(mean) + 40
    lo, hi = max(0, int(mean - reach)), int(mean + reach)
    j = np.arange(lo, hi + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(j[1:]))])  # against the first value
    p = np.exp(logs - logs.max())
    return lo, p / p.sum()


def resampled_steps(steps: DataFrame, by: list[str], n: int, seed: str = "0") -> DataFrame:
    """(by, replicate, _c, _m): how many types have each count in n replicates, in which a type's count is Poisson around its own.

    Types of one count are drawn together: how many of them get 0, 1, 2 ... is a multinomial draw, taken by conditional
    binomials over the values that can come up (about 24 sqrt(c)), or a Poisson draw a type where there are fewer types. So
    work and rows depend on the number of different counts, not on that of types. Draws are keyed by group, count, replicates
    and seed. Types that get 0 are not in a replicate.
    """
    types = [steps.schema[b] for b in by]
    schema = T.StructType([*types, T.StructField("replicate", T.IntegerType()), T.StructField("_c", T.LongType()), T.StructField("_m", T.LongType())])
    frame = steps.select(*by, (F.to_json(F.struct(*by)) if by else F.lit("")).alias("_g"), F.col("_c").cast("long").alias("_c"), F.col("_m").cast("long").alias("_m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, cs, ms = (batch.column(x).to_pylist() for x in ("_g", "_c", "_m"))
            row, rep, val, num = [], [], [], []
            held = 0

            def flush() -> pa.RecordBatch:
                at = pa.array(np.concatenate(row))
                out = [batch.column(b).take(at) for b in by] + [pa.array(np.concatenate(rep), pa.int32()), pa.array(np.concatenate(val), pa.int64()), pa.array(np.concatenate(num), pa.int64())]
                for x in (row, rep, val, num):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, [*by, "replicate", "_c", "_m"])

            for i, (g, c, m) in enumerate(zip(groups, cs, ms)):
                rng = np.random.Generator(np.random.Philox(key=int.from_bytes(md5(f"{g}|{c}|{n}|{seed}".encode()).digest(), "big")))
                lo, p = _poisson_range(c) if m > 24 * math.sqrt(c) + 80 else (0, None)
                width = m if p is None else len(p)
                for first in range(0, n, max(1, HELD // width)):
                    reps = np.arange(first, min(n, first + max(1, HELD // width)))
                    got = rng.poisson(c, (len(reps), m)) if p is None else rng.multinomial(m, p, len(reps))
                    r, j = np.nonzero(got)
                    row.append(np.full(len(r), i))
                    rep.append(reps[r])
                    val.append(got[r, j] if p is None else lo + j)
                    num.append(np.ones(len(r), np.int64) if p is None else got[r, j])
                    held += len(r)
                    if held > HELD:
                        yield flush()
                        held = 0
            if row:
                yield flush()

    return frame.mapInArrow(run, schema).where("_c > 0").groupBy(*by, "replicate", "_c").agg(F.sum("_m").alias("_m"))


def estimator_intervals(steps: DataFrame, by: list[str], k: Column | int, estimators: list[str], n: int = 100, alpha: float = 0.05, seed: str = "0") -> DataFrame:
    """(by, estimator, value, low, high) for any columns of kmers.entropy_summary, from (by, _c, _m) of kmers.count_steps.

    The interval is that of the estimator's values in n replicates (`resampled_steps`), shifted so that their mean is the value.
    A group of a single type has no variability: low and high are the value. Groups of null keys are groups as others are; an
    empty table gives no rows.
    """
    from helixmill.operators.kmers import summary_of_steps

    def long(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*by, *more, F.inline(F.array(*(F.struct(F.lit(e).alias("estimator"), F.col(e).cast("double").alias("value")) for e in estimators))))

    drawn = long(summary_of_steps(resampled_steps(steps, by, n, seed), [*by, "replicate"], k))
    q = drawn.groupBy(*by, "estimator").agg(percentiles("value", alpha / 2, 1 - alpha / 2).alias("_q"), F.avg("value").alias("_mean"))
    own = long(summary_of_steps(steps, by, k), "n_types")
    same = [F.col(f"o.{b}").eqNullSafe(F.col(f"q.{b}")) for b in [*by, "estimator"]]
    bound = lambda i: F.when(F.col("n_types") > 1, F.coalesce(F.col("_q")[i] - F.col("_mean") + F.col("o.value"), F.col("o.value"))).otherwise(F.col("o.value"))
    return own.alias("o").join(q.alias("q"), same, "left").select(*(F.col(f"o.{b}") for b in by), "o.estimator", "o.value", bound(0).alias("low"), bound(1).alias("high"))


def composition_bootstrap(rows: DataFrame, key: str, label: str, p: str, classes: int, n: int = 20, size: int = 2000, soft: bool = True, seed: str = "0") -> DataFrame:
    """(replicate, class, truth, estimate): reads drawn to random class mixes, and the mix that their scores give.

    A mix is a row of keyed exponential numbers over their sum (a flat Dirichlet), so there are n x classes of them; a read's
    weight is Poisson with the mean that its class needs.
    """
    from helixmill.functions.seq import keyed_uniform
    from helixmill.operators.scores import argmax

    spark = rows.sparkSession
    mix = spark.range(n).select(F.col("id").cast("int").alias("replicate")).crossJoin(rows.select(label).distinct())
    mix = mix.withColumn("_e", -F.ln(1 - keyed_uniform(F.col("replicate").cast("string"), F.col(label).cast("string"), F.lit(f"{seed}m"))))
    mix = mix.withColumn("share", F.col("_e") / F.sum("_e").over(Window.partitionBy("replicate"))).drop("_e")
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    plan = mix.join(sizes, label).withColumn("_mean", F.col("share") * size / F.col("_n"))
    means = np.zeros((classes, n))
    for r in plan.select("replicate", label, "_mean").collect():  # replicates x classes numbers, whatever the rows
        means[int(r[label]), r.replicate] = r["_mean"]
    scores = [F.get(p, F.lit(i)) if soft else (argmax(F.col(p)) == i).cast("double") for i in range(classes)]
    terms = {"label": F.col(label)} | {f"s{i}": x for i, x in enumerate(scores)} | {f"t{i}": (F.col(label) == i).cast("double") for i in range(classes)}
    sums = replicate_sums(rows, key, terms, n, seed, draw=lambda u, v, x: poisson_counts(means[x[:, 0].astype(int)], u, v))
    cells = F.array(*(F.struct(F.lit(i).alias("class"), F.col(f"t{i}").alias("_t"), F.col(f"s{i}").alias("_s")) for i in range(classes)))
    est = sums.select("replicate", F.explode(cells).alias("_c")).select("replicate", "_c.*")
    w = Window.partitionBy("replicate")
    return est.select("replicate", "class", (F.col("_t") / F.nullif(F.sum("_t").over(w), F.lit(0.0))).alias("truth"), (F.col("_s") / F.nullif(F.sum("_s").over(w), F.lit(0.0))).alias("estimate"))


def domain_counts(rows: DataFrame, domain: str, top: Column) -> DataFrame:
    """domain, a (top inside), inside, top, n of the universe."""
    g = rows.groupBy(F.col(domain).alias("domain")).agg(F.count_if(top).alias("a"), F.count("*").alias("inside"))
    whole = rows.agg(F.count_if(top).alias("top"), F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(whole))


def enrichment(counts: DataFrame) -> DataFrame:
    """Share of the top inside over the share of all, odds ratio with its normal interval on the log scale, one- and two-sided p."""
    from helixmill.functions.seq import significance

    a, b = F.col("a"), F.col("inside") - F.col("a")
    c, d = F.col("top") - F.col("a"), F.col("n") - F.col("inside") - F.col("top") + F.col("a")
    ratio = a * d / F.nullif(b * c, F.lit(0))
    se = F.sqrt(1 / F.nullif(a, F.lit(0)) + 1 / F.nullif(b, F.lit(0)) + 1 / F.nullif(c, F.lit(0)) + 1 / F.nullif(d, F.lit(0)))
    out = counts.withColumns({"enrichment": (a / F.nullif("top", F.lit(0))) / F.nullif(F.col("inside") / F.col("n"), F.lit(0.0)), "odds_ratio": ratio, "or_lo": F.exp(F.ln(F.nullif(ratio, F.lit(0.0))) - 1.96 * se), "or_hi": F.exp(F.ln(F.nullif(ratio, F.lit(0.0))) + 1.96 * se)})
    out = out.withColumns({"p_enriched": fisher_greater("a", "inside", "top", "n"), "p_two_sided": fisher_two("a", "inside", "top", "n")})
    return out.withColumn("sig", significance(F.col("p_enriched")))


def clustered_enrichment(rows: DataFrame, read: str, inside: Column, top: Column, n: int = 2000, seed: str = "0") -> DataFrame:
    """Enrichment of top rows inside with the read as the unit, in one row.

    odds_ratio and enrichment (share of the top that is inside over the share of all) with 95 % intervals of a bootstrap over
    reads, null where a cell of the table is 0; se_naive of the log odds ratio from the cells (each 1 at least), se_clustered
    from the bootstrap, design_effect their ratio, effective_n = n_rows / design_effect^2. Then reads that lie wholly inside
    against those wholly outside, by their own shares of top rows: numbers, means, ratio, and the one-sided rank test's p
    (inside greater; normal, with ties and continuity).
    """
    per = rows.groupBy(read).agg(F.count_if(inside & top).alias("a"), F.count_if(inside & ~top).alias("b"), F.count_if(~inside & top).alias("c"), F.count_if(~inside & ~top).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    some = F.least(a, b, c, d) > 0
    ratio, share = F.when(some, a * d / (b * c)), F.when(some, (a / (a + c)) / ((a + b) / (a + b + c + d)))
    boots = replicate_sums(per, read, {x: F.col(x) for x in "abcd"}, n, seed).select(ratio.alias("o"), share.alias("e"))
    boots = boots.agg(percentiles("o", 0.025, 0.975).alias("qo"), percentiles("e", 0.025, 0.975).alias("qe"), F.stddev_pop(F.ln("o")).alias("se_clustered"))
    cells = sum((1 / F.greatest(x, F.lit(1)) for x in (b, c, d)), 1 / F.greatest(a, F.lit(1)))
    own = per.agg(F.count("*").alias("n_reads"), *(F.sum(x).alias(x) for x in "abcd")).select("n_reads", (a + b + c + d).alias("n_rows"), ratio.alias("odds_ratio"), share.alias("enrichment"), F.sqrt(cells).alias("se_naive"))
    n_in, n_all = a + b, a + b + c + d
    whole = per.where((n_in == n_all) | (n_in == 0)).select((n_in > 0).cast("int").alias("in"), ((a + c) / n_all).alias("x"))
    return own.crossJoin(boots).crossJoin(_rank_test(whole)).withColumn("design_effect", F.col("se_clustered") / F.col("se_naive")).select(
        "n_rows", "n_reads", (F.col("n_rows") / F.col("n_reads")).alias("rows_per_read"), "odds_ratio", F.col("qo")[0].alias("or_lo"), F.col("qo")[1].alias("or_hi"), "enrichment", F.col("qe")[0].alias("enrichment_lo"), F.col("qe")[1].alias("enrichment_hi"),
        "se_naive", "se_clustered", "design_effect", (F.col("n_rows") / F.nullif(F.col("design_effect") ** 2, F.lit(0.0))).alias("effective_n"), "n_inside", "n_outside", "mean_inside", "mean_outside", (F.col("mean_inside") / F.nullif("mean_outside", F.lit(0.0))).alias("read_ratio"), "p_read",
    )


def _rank_test(marked: DataFrame) -> DataFrame:
    """Rows (in: 1 or 0, x): numbers and means of both sides, and the one-sided p that x is greater inside. Null p if a side is empty or all x are equal."""
    ties = marked.groupBy("x").agg(F.count("*").alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    ranks = with_mid_ranks(marked, [], {"_r": "x"})
    one = F.col("in") == 1
    out = ranks.agg(F.sum(F.when(one, F.col("_r"))).alias("rs"), F.count_if(one).alias("n_inside"), F.count_if(~one).alias("n_outside"), F.avg(F.when(one, F.col("x"))).alias("mean_inside"), F.avg(F.when(~one, F.col("x"))).alias("mean_outside")).crossJoin(ties)
    n1, n2, m = F.col("n_inside"), F.col("n_outside"), F.col("n_inside") + F.col("n_outside")
    sd = F.sqrt(n1 * n2 / 12 * ((m + 1) - F.col("ties") / F.nullif(m * (m - 1), F.lit(0))))
    z = (F.col("rs") - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    return out.withColumn("p_read", F.when(z > 0, normal_p(z) / 2).otherwise(1 - normal_p(z) / 2)).drop("rs", "ties")


def _hypergeometric_draws(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For rows (n, k, t) how many of t drawn of n are among k, by cumulative probabilities against the uniform numbers."""
    size = int(x[:, 0].max(initial=0)) + 1
    log_fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, size + 1)))))
    choose = lambda n, j: log_fact[n] - log_fact[j] - log_fact[n - j]
    out, known = np.empty(u.shape), {}
    for i, row in enumerate(map(tuple, x[:, :3].astype(int).tolist())):
        if row not in known:
            n, k, t = row
            j = np.arange(max(0, k + t - n), min(k, t) + 1)
            known[row] = j[0], np.cumsum(np.exp(choose(k, j) + choose(n - k, t - j) - choose(n, t)))[:-1]
        low, cdf = known[row]
        out[i] = low + np.searchsorted(cdf, u[i], side="right")
    return out


def within_read_permutation(rows: DataFrame, read: str, inside: Column, top: Column, n: int = 10_000, seed: str = "0") -> DataFrame:
    """Top rows inside, of reads that straddle the border, against n shuffles of the marks within each read; in one row.

    A shuffle's count in a read is hypergeometric, so it is drawn as one number a read and replicate and summed over reads. p is
    one-sided: the share of shuffles, and the observed order itself, with as many or more. expected and sd are exact.
    """
    per = rows.groupBy(read).agg(F.count("*").alias("n"), F.count_if(inside).alias("k"), F.count_if(top).alias("t"), F.count_if(inside & top).alias("x")).where((F.col("k") > 0) & (F.col("k") < F.col("n")))
    m, k, t = F.col("n"), F.col("k"), F.col("t")
    mean = k * t / m
    var = F.when(m > 1, mean * (1 - k / m) * (m - t) / F.nullif(m - 1, F.lit(0))).otherwise(0.0)
    own = per.agg(F.count("*").alias("n_straddling"), F.coalesce(F.sum("x"), F.lit(0)).alias("observed"), F.sum(mean).alias("expected"), F.sqrt(F.sum(var)).alias("sd"))
    null = replicate_sums(per, read, {"n": m, "k": k, "t": t}, n, seed, draw=lambda u, v, x: _hypergeometric_draws(u, x)).select(F.col("w").alias("null"))
    return own.crossJoin(null).groupBy(*own.columns).agg(F.avg("null").alias("null_mean"), ((1 + F.count_if(F.col("null") >= F.col("observed"))) / F.lit(n + 1)).alias("p"))


def stratum_contrasts(rows: DataFrame, stratum: str, method: str, value: str, reference: str, n: int = 200, seed: str = "0", paired: list[tuple[str, str]] = []) -> DataFrame:
    """Contrasts of methods over strata, a row each: family, contrast, n_strata, n_won, strata_lost, mean_delta, min_delta, ci_lo, ci_hi, wilcoxon_p, p_floor.

    Families: `reference` (the reference method less each other one) and `within_quantifier` (the first less the second of each
    pair whose methods both occur). Lost: a difference of 0 or less; their names in order, joined by commas. The interval of the
    mean is a bootstrap over strata, null for fewer than three. p_floor is the smallest p that so many strata can give.
    """
    pairs = rows.select(F.col(method).alias("_m")).where(F.col("_m") != reference).distinct().select(F.lit("reference").alias("family"), F.lit(reference).alias("_a"), F.col("_m").alias("_b"))
    if paired:
        pairs = pairs.unionByName(rows.sparkSession.createDataFrame([("within_quantifier", *p) for p in paired], "family string, _a string, _b string"))
    side = lambda c, v: rows.select(F.col(stratum).alias("_s"), F.col(method).alias(c), F.col(value).alias(v))
    d = pairs.join(side("_a", "_va"), "_a").join(side("_b", "_vb"), ["_b", "_s"]).select("family", F.concat_ws("-", "_a", "_b").alias("contrast"), F.col("_s").cast("string").alias("_s"), (F.col("_va") - F.col("_vb")).alias("d"))
    by = ["family", "contrast"]
    lost = F.array_join(F.array_sort(F.collect_list(F.when(F.col("d") <= 0, F.col("_s")))), ",")
    base = d.groupBy(*by).agg(F.count("*").alias("n_strata"), F.count_if(F.col("d") > 0).alias("n_won"), lost.alias("strata_lost"), F.avg("d").alias("mean_delta"), F.min("d").alias("min_delta"))
    boots = replicate_sums(d, "_s", {"d": F.col("d")}, n, seed, by).where("w > 0").select(*by, (F.col("d") / F.col("w")).alias("m")).groupBy(*by).agg(percentiles("m", 0.025, 0.975).alias("q"))
    sized = d.where("d <> 0").withColumn("_size", F.abs("d"))
    ties = sized.groupBy(*by, "_size").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    plus = with_mid_ranks(sized, by, {"_r": "_size"}).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)).alias("plus"))
    test = plus.join(ties, by).select(*by, wilcoxon_p("n", "plus", "ties").alias("wilcoxon_p"))
    out, three = base.join(boots, by, "left").join(test, by, "left"), F.col("n_strata") >= 3
    return out.select(*by, "n_strata", "n_won", "strata_lost", "mean_delta", "min_delta", F.when(three, F.col("q")[0]).alias("ci_lo"), F.when(three, F.col("q")[1]).alias("ci_hi"), "wilcoxon_p", (2 / F.pow(F.lit(2.0), "n_strata")).alias("p_floor"))


def pooled_draws(pool: DataFrame, n: int, seed: str) -> DataFrame:
    """(_p, replicate, sa, sb): n keyed Poisson counts around a row's means _ma and _mb, those of poisson_count(mean, _key, replicate, seed + side)."""
    schema = T.StructType([pool.schema["_p"], T.StructField("replicate", T.IntegerType()), T.StructField("sa", T.DoubleType()), T.StructField("sb", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // (4 * n))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys, sides = part.column("_key").to_pylist(), []
                for side, mean in (("a", "_ma"), ("b", "_mb")):
                    m = np.asarray(part.column(mean).fill_null(0.0))[:, None]
                    v = np.zeros((len(keys), n))
                    wide = np.flatnonzero(m[:, 0] > 30)  # only these take a second number
                    if len(wide):
                        v[wide] = keyed_uniforms([keys[i] for i in wide], [f"{r}|{seed}{side}|n".encode() for r in range(n)])
                    sides.append(poisson_counts(m, keyed_uniforms(keys, [f"{r}|{seed}{side}".encode() for r in range(n)]), v).ravel())
                own = pa.array(np.repeat(np.arange(len(keys)), n))
                yield pa.RecordBatch.from_arrays([part.column("_p").take(own), pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), *map(pa.array, sides)], schema.names)

    return pool.mapInArrow(run, schema)


def noise_ceiling(rows: DataFrame, key: str, a: str, b: str, floors: list[int], n: int = 20, seed: str = "0") -> DataFrame:
    """For each floor of the pooled count: loci, observed agreement (rank, log10 and concordance with sample covariance), and the rank correlation that two draws from the pooled profile reach."""
    marked = rows.fillna(0, [a, b]).withColumn("_p", F.col(a) + F.col(b)).select("*", F.explode(F.array(*map(F.lit, floors))).alias("floor")).where(F.col("_p") >= F.greatest("floor", F.when(F.col("floor") > 0, 1).otherwise(0)))
    x = with_mid_ranks(marked, ["floor"], {"_ra": a, "_rb": b}).withColumns({"_la": F.log10(1 + F.col(a)), "_lb": F.log10(1 + F.col(b))})
    down = F.var_pop("_la") + F.var_pop("_lb") + F.pow(F.avg("_la") - F.avg("_lb"), 2)
    own = x.groupBy("floor").agg(F.count("*").alias("n_loci"), F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias("detected_both"), pearson("_ra", "_rb").alias("rho"), (pearson("_la", "_lb") ** 2).alias("r2_log10"), (2 * F.covar_samp("_la", "_lb") / F.nullif(down, F.lit(0.0))).alias("ccc_log10"))
    totals = rows.agg(F.sum(a).alias("_na"), F.sum(b).alias("_nb"))
    # a locus is drawn once a replicate for all floors; loci of the same two counts are then one row with a number for each floor
    pool = rows.fillna(0, [a, b]).withColumn("_p", F.col(a) + F.col(b)).crossJoin(F.broadcast(totals))
    share, least = F.col("_p") / (F.col("_na") + F.col("_nb")), [F.col("_p") >= max(f, 1 if f > 0 else 0) for f in floors]
    drawn = pooled_draws(pool.select(F.col(key).cast("string").alias("_key"), (share * F.col("_na")).alias("_ma"), (share * F.col("_nb")).alias("_mb"), "_p"), n, seed)
    cells = drawn.groupBy("replicate", "sa", "sb").agg(*(F.count_if(on).alias(f"_w{i}") for i, on in enumerate(least)))
    each = F.array(*(F.struct(F.lit(f).alias("floor"), F.col(f"_w{i}").alias("_w")) for i, f in enumerate(floors)))
    cells = cells.select("replicate", "sa", "sb", F.inline(each)).where("_w > 0")
    by = ["floor", "replicate"]
    for x in ("sa", "sb"):
        ranks = running_sums(cells.groupBy(*by, x).agg(F.sum("_w").alias("_n")), by, x, {"_upto": "_n"})
        # ranks with ties at their mean, less the mean of all
        cells = cells.join(ranks.select(*by, x, (F.col("_upto") - (F.col("_n") - 1) / 2 - (F.col("total__upto") + 1) / 2).alias(f"_r{x}")), [*by, x])
    ra, rb, w = F.col("_rsa"), F.col("_rsb"), F.col("_w")
    sim = cells.groupBy(*by).agg((F.sum(w * ra * rb) / F.nullif(F.sqrt(F.sum(w * ra * ra)) * F.sqrt(F.sum(w * rb * rb)), F.lit(0.0))).alias("r"))
    top = sim.groupBy("floor").agg(F.avg("r").alias("ceiling"), percentiles("r", 0.05, 0.95).alias("q"))
    return own.join(top, "floor", "left").select("floor", "n_loci", "detected_both", "rho", "r2_log10", "ccc_log10", "ceiling", F.col("q")[0].alias("ceiling_p05"), F.col("q")[1].alias("ceiling_p95"), (100 * F.col("rho") / F.nullif("ceiling", F.lit(0.0))).alias("pct_of_ceiling"))


def share_reliability(rows: DataFrame, key: str, count: str, flag: Column, n: int = 200, seed: str = "0") -> DataFrame:
    """A flagged share of all counts: binomial error, and a bootstrap over loci."""
    r = rows.select(key, F.col(count).alias("c"), flag.alias("f"))
    flagged, share = F.when(F.col("f"), F.col("c")).otherwise(0), 100 * F.col("part") / F.nullif(F.col("c"), F.lit(0))
    boots = replicate_sums(r, key, {"part": flagged, "c": F.col("c")}, n, seed).select(share.alias("s")).agg(percentiles("s", 0.025, 0.975).alias("q"), F.stddev_samp("s").alias("boot_se"))
    own = r.agg(F.sum(flagged).alias("part"), F.sum("c").alias("c")).select(share.alias("point"), F.col("c").alias("reads"))
    s = F.col("point") / 100
    return own.crossJoin(boots).select("point", (100 * F.sqrt(s * (1 - s) / F.col("reads"))).alias("binomial_se"), F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "boot_se", "reads")


def kmer_rank_table(rows: DataFrame, kmer: str, value: str, domain: str, least: int = 2) -> DataFrame:
    return rows.groupBy(kmer).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.max_by(domain, F.struct(F.abs(F.col(value)), domain)).alias("domain")).where(F.col("n") >= least)


def binned_profile(rows: DataFrame, pos: str, value: str, width: int = 50, least: int = 5) -> DataFrame:
    return rows.groupBy(F.floor(F.col(pos) / width).alias("bin")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def both_ends(ranks: DataFrame, n: int = 12, value: str = "mean", tie: str = "kmer") -> DataFrame:
    """The n lowest and the n highest rows, marked."""
    low = ranks.orderBy(value, tie).limit(n).withColumn("side", F.lit("low"))
    return low.unionByName(ranks.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("high")))
