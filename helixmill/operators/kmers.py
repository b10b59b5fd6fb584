"""k-mer counts, entropy, rarefaction and the choice of k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.seq import base_code, code_of_digits, explode_codes, explode_kmers, keyed_uniform


def count_kmers(reads: DataFrame, k: int, by: list[str] = [], canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(by, code, count) of distinct k-mers. K-mers are numbers before the shuffle, and counts are combined before it."""
    rows = explode_codes(reads.select(*by, seq), [k], seq, canonical).groupBy(*by, "code").agg(F.count("*").alias("count"))
    return rows.withColumn("code", code_of_digits(F.col("code"), [k]))


def entropy_summary(counts: DataFrame, by: list[str], k: Column | int, count: str = "count", replicates: int = 0, alpha: float = 0.05, seed: str = "0") -> DataFrame:
    """Entropies, redundancies and coverage of a table of counts, from how many types have each count: that table has at most about sqrt(2 n) rows a group, and counts are read once.

    An empty group or a single type has entropy 0. Where all types are singletons the coverage-adjusted entropy is the plain one.
    With replicates, entropy_low and entropy_high bound the plain entropy (see resample.estimator_intervals; 0 for single types).
    """
    steps = count_steps(counts, by, count)
    out = summary_of_steps(steps, by, k)
    if not replicates:
        return out
    from helixmill.operators.resample import estimator_intervals

    bounds = estimator_intervals(steps, by, k, ["entropy"], replicates, alpha, seed).drop("estimator", "value")
    bounds = bounds.withColumnsRenamed({"low": "entropy_low", "high": "entropy_high"})
    if not by:
        return out.crossJoin(bounds)  # one row each
    same = [F.col(f"o.{b}").eqNullSafe(F.col(f"i.{b}")) for b in by]
    return out.alias("o").join(bounds.alias("i"), same).select("o.*", "i.entropy_low", "i.entropy_high")


def count_steps(counts: DataFrame, by: list[str], count: str = "count") -> DataFrame:
    """(by, _c, _m): how many types have each count; types without a positive count are left out."""
    return counts.where(F.col(count) > 0).groupBy(*by, F.col(count).cast("bigint").alias("_c")).agg(F.count("*").alias("_m"))


def summary_of_steps(steps: DataFrame, by: list[str], k: Column | int) -> DataFrame:
    """The columns of entropy_summary from (by, _c, _m). Every estimator is a sum over these rows, so it serves observed and resampled counts alike."""
    k = F.lit(k) if isinstance(k, int) else k
    c, m, n, types = F.col("_c").cast("double"), F.col("_m"), F.col("n_kmers"), F.col("n_types")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    steps = steps.withColumn("_n", F.sum(F.col("_c") * m).over(whole)).withColumn("_cov", 1 - F.sum(F.when(F.col("_c") == 1, m).otherwise(0)).over(whole) / F.col("_n"))
    pa = c / F.col("_n") * F.col("_cov")
    seen = 1 - F.pow(1 - pa, F.col("_n"))
    adjusted = F.when(F.col("_cov") > 0, -m * pa * F.log2(pa) / F.when(seen > 0, seen).otherwise(1.0))
    out = steps.groupBy(*by).agg(
        F.sum(F.col("_c") * m).alias("n_kmers"), F.sum("_m").alias("n_types"), F.coalesce(F.sum(F.when(F.col("_c") == 1, m)), F.lit(0)).alias("singletons"),
        F.sum(m * c * F.log2(c)).alias("_clogc"), F.first("_cov").alias("coverage"), F.sum(adjusted).alias("_cs"),
    )
    h = F.col("entropy")
    out = out.withColumn("entropy", F.when(types <= 1, 0.0).otherwise(F.log2(n) - F.col("_clogc") / n)).drop("_clogc")
    return out.withColumns({
        "miller_madow": F.when(types <= 1, 0.0).otherwise(h + (types - 1) / (2 * n * F.log(F.lit(2.0)))),
        "chao_shen": F.when(types <= 1, 0.0).otherwise(F.coalesce("_cs", h)),
        "kl_observed": F.when(types <= 1, 0.0).otherwise(F.greatest(F.log2(types) - h, F.lit(0.0))),
        "kl_full": F.greatest(2.0 * k - h, F.lit(0.0)),
        "redundancy_shannon": 1 - h / (2.0 * k),
        "redundancy_observed": F.when(types <= 1, 1.0).otherwise(1 - h / F.log2(F.nullif(types, F.lit(1)))),
        "redundancy_duplication": 1 - types / n,
    }).drop("_cs")


def nested_sample(df: DataFrame, key: str, fractions: list[float], replicates: int = 1, seed: str = "0") -> DataFrame:
    """Rows of each (fraction, replicate): the round(fraction * N) smallest keyed numbers, so smaller fractions lie inside larger ones.

    The ranks come from counts in 4096 ranges of the keyed number, so no task sorts the whole table.
    """
    grid = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    grid = grid.withColumn("_u", keyed_uniform(F.col(key).cast("string"), F.col("replicate").cast("string"), F.lit(seed)))
    ranked = exact_rank(grid, ["replicate"], "_u", key)
    out = ranked.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    return out.where(F.col("_rank") <= F.bround(F.col("fraction") * F.col("_total"))).drop("_u", "_rank", "_total")


def exact_rank(df: DataFrame, by: list[str], u: str, tie: str, ranges: int = 4096) -> DataFrame:
    """Adds _rank (from 1, by u in [0, 1) and tie) and _total in each group, from ranks in ranges of u plus the ranges' counts."""
    df = df.withColumn("_range", F.floor(F.col(u) * ranges).cast("int"))
    sizes = df.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_size").over(w)).drop("_size")
    ranked = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(u, tie)))
    return ranked.join(sizes, [*by, "_range"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def spectrum(reads: DataFrame, key: str, corpus: str, ks: list[int], fractions: list[float], replicates: int = 1, seed: str = "0", canonical: bool = True) -> DataFrame:
    """Entropy summary for each corpus, k, fraction and replicate, over nested subsamples of reads. The key must be unique.

    A read is cut into k-mers once, whatever the number of samples, and is not shuffled: it carries a 0 or 1 for each sample, from the
    sample's last keyed number (one row for all samples), and a k-mer's counts are the sums of these.
    """
    samples = [(r, f) for r in range(replicates) for f in fractions]
    drawn = lambda r: F.struct(keyed_uniform(F.col(key).cast("string"), F.lit(str(r)), F.lit(seed)).alias("u"), F.col(key).alias("key"))
    grid = reads.select(key, F.explode(F.array(*(F.struct(F.lit(r).alias("replicate"), drawn(r).alias("d")) for r in range(replicates)))).alias("g")).select(key, "g.replicate", "g.d", "g.d.u")
    ranked = exact_rank(grid, ["replicate"], "u", key)
    last = [F.max(F.when((F.col("replicate") == r) & (F.col("_rank") <= F.bround(F.lit(f) * F.col("_total"))), F.col("d"))).alias(f"_s{i}") for i, (r, f) in enumerate(samples)]
    taken = reads.select(key, corpus, "seq", *(drawn(r).alias(f"_d{r}") for r in range(replicates))).crossJoin(F.broadcast(ranked.agg(*last)))
    taken = taken.select(corpus, "seq", *(F.coalesce(F.col(f"_d{r}") <= F.col(f"_s{i}"), F.lit(False)).cast("int").alias(f"_s{i}") for i, (r, f) in enumerate(samples)))
    codes = explode_codes(taken, ks, "seq", canonical)
    counts = codes.groupBy(corpus, "k", "code").agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(samples))))
    each = F.array(*(F.struct(F.lit(r).alias("replicate"), F.lit(f).alias("fraction"), F.col(f"_s{i}").alias("count")) for i, (r, f) in enumerate(samples)))
    return entropy_summary(counts.select(corpus, "k", F.inline(each)), [corpus, "fraction", "replicate", "k"], F.col("k"))


def mean_spectrum(table: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Replicates averaged, estimators' gaps to the plain entropy, and the gain over k - 1 at the same fraction (0 at the first)."""
    out = table.groupBy(corpus, "fraction", "k").agg(*(F.avg(c).alias(c) for c in ("entropy", "miller_madow", "chao_shen", "coverage", "redundancy_duplication")))
    w = Window.partitionBy(corpus, "fraction").orderBy("k")
    return out.withColumns({"gap_mm": F.col("miller_madow") - F.col("entropy"), "gap_cs": F.col("chao_shen") - F.col("entropy"), "gain": F.coalesce(F.col("miller_madow") - F.lag("miller_madow").over(w), F.lit(0.0))})


def k_gates(mean: DataFrame, corpus: str = "corpus", epsilon: float = 0.01, tau: float = 0.05) -> DataFrame:
    """Per corpus and k of the full sample: entropy h, gain over the k before, relative drift against the smaller sample, saturated, below_tau.

    The smaller sample is the one whose fraction is nearest to 0.5 (the smaller of two as near). Saturated: drift under epsilon; not
    where the entropy is 0 or the smaller sample lacks the k; always where a corpus has no smaller sample. below_tau: a gain under
    tau, not at the smallest k.
    """
    h = F.col("miller_madow")
    full = mean.where("fraction = 1.0").select(corpus, "k", h.alias("h"), "gain")
    less = mean.where("fraction < 1.0")
    nearest = less.groupBy(corpus).agg(F.min_by("fraction", F.struct(F.abs(F.col("fraction") - 0.5), "fraction")).alias("fraction"))
    half = less.join(nearest, [corpus, "fraction"]).select(corpus, "k", h.alias("h_half"))
    least = full.groupBy(corpus).agg(F.min("k").alias("_least"))
    rows = full.join(least, corpus).join(nearest, corpus, "left").join(half, [corpus, "k"], "left")
    rows = rows.withColumn("drift", F.abs(F.col("h") - F.col("h_half")) / F.nullif("h", F.lit(0.0)))
    saturated = F.col("fraction").isNull() | F.coalesce(F.col("drift") < epsilon, F.lit(False))
    return rows.select(corpus, "k", "h", "gain", "drift", saturated.alias("saturated"), ((F.col("gain") < tau) & (F.col("k") > F.col("_least"))).alias("below_tau"))


def task_plateau(ablation: DataFrame, score: str = "macro_f1_mean", sd: str = "macro_f1_std") -> DataFrame:
    """One row task_k: the smallest k whose score is within one standard deviation (the best one's) of the best; null for an empty table."""
    best = ablation.agg(F.max_by(F.struct(F.col(score).alias("m"), F.col(sd).alias("s")), F.struct(F.col(score), -F.col("k"))).alias("_b"))
    return ablation.crossJoin(F.broadcast(best)).agg(F.min(F.when(F.col(score) >= F.col("_b.m") - F.col("_b.s"), F.col("k"))).alias("task_k"))


def choose_k(mean: DataFrame, ablation: DataFrame | None = None, corpus: str = "corpus", epsilon: float = 0.01, tau: float = 0.05) -> DataFrame:
    """For each corpus: saturated_k (the largest saturated k), plateau_k (the smallest k below tau), task_k (from the ablation, the same for all), within_reliable, recommended_k.

    A plateau no larger than the saturated k is real (within_reliable) and recommended; else the larger of saturated and task k, or
    the plateau if there is neither.
    """
    out = k_gates(mean, corpus, epsilon, tau).groupBy(corpus).agg(F.max(F.when(F.col("saturated"), F.col("k"))).alias("saturated_k"), F.min(F.when(F.col("below_tau"), F.col("k"))).alias("plateau_k"))
    out = out.withColumn("task_k", F.lit(None).cast("int")) if ablation is None else out.crossJoin(F.broadcast(task_plateau(ablation)))
    within = F.coalesce(F.col("plateau_k") <= F.col("saturated_k"), F.lit(False))
    return out.withColumn("within_reliable", within).withColumn("recommended_k", F.when(F.col("within_reliable"), F.col("plateau_k")).otherwise(F.coalesce(F.greatest("saturated_k", "task_k"), "plateau_k")))


def pinned_kmers(counts: DataFrame, min_count: int, most: int, kmer: str = "kmer", count: str = "count") -> DataFrame:
    """The `most` most frequent k-mers of at least min_count, by count and then k-mer, as distinct canonical codes."""
    from helixmill.functions.seq import canonical_kmer

    top = counts.where(F.col(count) >= min_count).orderBy(F.desc(count), kmer).limit(most)
    return top.select(base_code(canonical_kmer(F.col(kmer))).alias("code")).distinct()


def common_codes(counts: DataFrame, code: str = "code", count: str = "count") -> DataFrame:
    """Codes that come more often than the average code."""
    whole = counts.agg(F.sum(count).alias("_sum"), F.count("*").alias("_types"))
    return counts.crossJoin(F.broadcast(whole)).where(F.col(count) * F.col("_types") > F.col("_sum")).select(code)


def token_ids(rows: DataFrame, index: DataFrame, k: int, code: str = "code", first: int = 5, shared: int = 32, out: str = "token") -> DataFrame:
    """Adds the token id of each code: its rank in the index from `first` on, or one of the `shared` ids after these. Ranks come from counts per range of codes."""
    ranked = exact_rank(index.select(code).distinct().withColumn("_u", F.col(code) / F.lit(4.0**k)), [], "_u", code).select(code, "_rank")
    size = index.agg(F.count_distinct(code).alias("_size"))
    met = rows.join(ranked, code, "left").crossJoin(F.broadcast(size))  # one row
    token = F.coalesce(first - 1 + F.col("_rank"), first + F.col("_size") + F.col(code) % shared)
    return met.withColumn(out, token.cast("bigint")).drop("_rank", "_size")


def read_index_overlap(reads: DataFrame, index: DataFrame, key: str, group: str, k: int, threshold: int) -> DataFrame:
    """For each group: reads, and the mean share of a read's k-mers whose index count is at least 1 and at least threshold."""
    rows = explode_kmers(reads.select(key, group, "seq"), k, canonical=True).withColumn("code", base_code(F.col("kmer")))
    hit = rows.join(index.select("code", F.col("count").alias("c")), "code", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per = hit.groupBy(key, group).agg(F.avg((F.col("c") >= 1).cast("double")).alias("any"), F.avg((F.col("c") >= threshold).cast("double")).alias("often"))
    return per.groupBy(group).agg(F.count("*").alias("n_reads"), F.avg("any").alias("share_any"), F.avg("often").alias("share_often"))


def stripped_density(raw: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Characters that standardizing removes, per group, and whether they are over a thousandth."""
    from helixmill.functions.seq import standardize

    out = raw.groupBy(*by).agg(F.sum(F.length(text) - F.length(standardize(F.col(text)))).alias("stripped"), F.sum(F.length(text)).alias("total"))
    return out.withColumn("density", F.col("stripped") / F.nullif("total", F.lit(0))).withColumn("warn", F.col("density") > 0.001)
