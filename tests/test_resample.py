"""Bootstraps and enrichment tests on planted rows, against plain versions that repeat the same draws."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from helixmill.functions.seq import keyed_uniform
from helixmill.functions.stats import poisson_count
from helixmill.operators import kmers as K
from helixmill.operators import moments as M
from helixmill.operators import resample as R


def uniform(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16**13


def test_uniforms_are_those_of_the_column(spark):
    keys = ["", "1", "a|b", "ä"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    want = [[r[k] for r in df.select("k", keyed_uniform("k", F.lit("3"), F.lit("s")).alias("u")).toPandas().to_dict("records")] for k in ("u",)][0]
    assert M.keyed_uniforms(keys, [b"3|s"])[:, 0].tolist() == want == [uniform(k, 3, "s") for k in keys]


def test_sums_are_the_plain_ones(spark):
    rows = [(f"k{i % 40}", i % 3 if i % 7 else None, float(i), None if i % 5 == 0 else i * 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, g int, x double, y double").repartition(5)
    got = {(r.g, r.replicate): (r.w, r.x, r.y) for r in M.replicate_sums(df, "key", {"x": F.col("x"), "y": F.col("y")}, 30, "9", ["g"]).collect()}
    for g in (0, 1, 2, None):
        for b in (0, 17, 29):
            w = [(sum(uniform(k, b, 9) >= c for c in M.POISSON_ONE), x, y or 0.0) for k, h, x, y in rows if h == g]
            assert np.allclose(got[g, b], [sum(a for a, _, _ in w), sum(a * x for a, x, _ in w), sum(a * y for a, _, y in w)])
    assert len(got) == 4 * 30


def test_sums_are_sent_in_parts(spark, monkeypatch):
    """The same sums when a task may hold few of them, and few draws, at once."""
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), (F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("x"))
    sums = lambda: sorted((r.g, r.replicate, r.w, round(r.x, 6)) for r in M.replicate_sums(df, "key", {"x": F.col("x")}, 8, "1", ["g"]).collect())
    want = sums()
    monkeypatch.setattr(M, "SUMS", 20)
    monkeypatch.setattr(M, "HELD", 16)
    assert sums() == want


def reads(spark):
    """Reads wholly inside (top shares 1, 1/2), wholly outside (0, 1/4, 0) and straddling."""
    rows = [("a", True, t) for t in (1, 1, 1)] + [("b", True, t) for t in (1, 0)] + [("c", False, t) for t in (0, 0)] + [("d", False, t) for t in (1, 0, 0, 0)] + [("e", False, 0)]
    rows += [("f", i < 3, t) for i, t in enumerate((1, 1, 0, 0, 1, 0))] + [("g", i < 1, t) for i, t in enumerate((1, 0, 0))]
    return rows, spark.createDataFrame([(r, i, bool(t)) for r, i, t in rows], "read string, inside boolean, top boolean")


def test_clustered_enrichment_by_hand(spark):
    rows, df = reads(spark)
    r = R.clustered_enrichment(df, "read", F.col("inside"), F.col("top"), 300, "4").first()
    cell = lambda i, t: sum(1 for _, x, y in rows if x == i and y == t)
    a, b, c, d = cell(True, 1), cell(True, 0), cell(False, 1), cell(False, 0)
    assert (a, b, c, d) == (7, 2, 2, 10)
    boots, own = [], {}
    for read, i, t in rows:
        own.setdefault(read, [0, 0, 0, 0])[(0 if i else 2) + (0 if t else 1)] += 1
    for n in range(300):
        s = [sum(sum(uniform(k, n, 4) >= x for x in M.POISSON_ONE) * v[j] for k, v in own.items()) for j in range(4)]
        boots.append(s[0] * s[3] / (s[1] * s[2]) if min(s) else math.nan)
    se = np.nanstd(np.log(boots))
    naive = math.sqrt(1 / 7 + 1 / 2 + 1 / 2 + 1 / 10)
    assert r.odds_ratio == 70 / 4 and abs(r.enrichment - (7 / 9) / (9 / 21)) < 1e-12 and abs(r.se_naive - naive) < 1e-12
    assert abs(r.se_clustered - se) < 1e-9 and abs(r.design_effect - se / naive) < 1e-9 and abs(r.effective_n - 21 / (se / naive) ** 2) < 1e-6
    lo, hi = np.nanpercentile(boots, [2.5, 97.5])
    assert abs(r.or_lo - lo) < 1e-9 and abs(r.or_hi - hi) < 1e-9
    # inside 1, 1/2 against outside 0, 1/4, 0: ranks 5, 4 and 1.5, 3, 1.5; U = 6 of 6, one tie of two
    z = (6 - 3 - 0.5) / math.sqrt(6 / 12 * (6 - 6 / 20))
    assert (r.n_inside, r.n_outside, r.mean_inside) == (2, 3, 0.75) and abs(r.read_ratio - 9) < 1e-12 and abs(r.p_read - math.erfc(z / math.sqrt(2)) / 2) < 1e-6


def test_within_read_permutation(spark):
    """Two straddling reads: (6 rows, 3 inside, 3 top) and (3, 1, 1); the draws follow their exact distribution."""
    _, df = reads(spark)
    r = R.within_read_permutation(df, "read", F.col("inside"), F.col("top"), 4_000, "1").first()
    assert (r.n_straddling, r.observed) == (2, 3) and abs(r.expected - (1.5 + 1 / 3)) < 1e-12
    first = [math.comb(3, j) * math.comb(3, 3 - j) / 20 for j in range(4)]
    exact = first[3] + first[2] / 3
    assert abs(r.p - exact) < 5 * math.sqrt(exact / 4_000) and abs(r.null_mean - r.expected) < 0.06


def test_stratum_contrasts_by_hand(spark):
    values = {"A": [5.0, 4.0, 3.0, 2.0], "B": [1.0, 5.0, 3.0, 1.0], "C": [4.0, 3.0, 2.0, 1.0]}
    rows = [(f"s{i}", m, v) for m, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "stratum string, method string, v double")
    got = {(r.family, r.contrast): r for r in R.stratum_contrasts(df, "stratum", "method", "v", "A", 100, "2", [("C", "B"), ("C", "none")]).collect()}
    assert set(got) == {("reference", "A-B"), ("reference", "A-C"), ("within_quantifier", "C-B")}
    r = got["reference", "A-B"]  # 4, -1, 0, 1
    assert (r.n_strata, r.n_won, r.strata_lost, r.mean_delta, r.min_delta, r.p_floor) == (4, 2, "s1,s2", 1.0, -1.0, 0.125)
    assert got["reference", "A-C"].wilcoxon_p < r.wilcoxon_p and got["within_quantifier", "C-B"].strata_lost == "s1,s2,s3"
    two = R.stratum_contrasts(df.where("stratum < 's2'"), "stratum", "method", "v", "A", 100).where("contrast = 'A-B'").first()
    assert two.ci_lo is None and two.ci_hi is None and two.n_strata == 2


def by_count(spark, groups):
    """(g, _c, _m) of groups {name: counts}."""
    return K.count_steps(spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "g string, count long"), ["g"])


def test_resampled_steps_follow_poisson_counts(spark):
    """Types drawn together (100,000 of count 3) and one by one (2 of count 400) have the numbers that single draws would have."""
    steps = spark.createDataFrame([("a", 3, 100_000), ("a", 400, 2), (None, 1, 1)], "g string, _c long, _m long")
    got = R.resampled_steps(steps, ["g"], 200, "1").toPandas()
    assert sorted(map(tuple, R.resampled_steps(steps.repartition(3), ["g"], 200, "1").collect()), key=str) == sorted(map(tuple, got.astype(object).where(got.notna(), None).values), key=str)
    low = got[(got.g == "a") & (got._c < 100)]
    for j in range(1, 9):
        p = math.exp(-3) * 3**j / math.factorial(j)
        m = low[low._c == j].groupby("replicate")._m.sum()
        assert len(m) == 200 and abs(m.mean() - 1e5 * p) < 6 * math.sqrt(1e5 * p * (1 - p) / 200) and 0.7 < m.std() / math.sqrt(1e5 * p * (1 - p)) < 1.35
    high = got[got._c >= 100]
    assert high._m.sum() == 400 and abs((high._c * high._m).sum() / 400 - 400) < 6 and 15 < np.repeat(high._c, high._m).std() < 25
    null = got[got.g.isna()]  # one type of count 1: it has none in e^-1 of the replicates
    assert 100 < null.replicate.nunique() < 150 and set(null.replicate) <= set(range(200))


def test_estimator_intervals_against_single_draws(spark):
    """Each estimator's interval is that of a plain bootstrap of all types; a single type has none; no row without counts."""
    rng = np.random.default_rng(5)
    counts = rng.geometric(0.08, 300).tolist() + [1] * 40
    got = {(r.g, r.estimator): r for r in R.estimator_intervals(by_count(spark, {"a": counts, "one": [42], "zero": [0]}), ["g"], 5, ["entropy", "miller_madow", "chao_shen"], 2_000).collect()}
    assert {g for g, _ in got} == {"a", "one"} and all(r.value == r.low == r.high for (g, _), r in got.items() if g == "one")

    def values(c):
        c = c[c > 0].astype(float)
        n, cov = c.sum(), 1 - (c == 1).sum() / c.sum()
        h = math.log2(n) - (c * np.log2(c)).sum() / n
        pa = cov * c / n
        return h, h + (len(c) - 1) / (2 * n * math.log(2)), -(pa * np.log2(pa) / (1 - (1 - pa) ** n)).sum()

    own = values(np.array(counts))
    drawn = np.array([values(x) for x in rng.poisson(counts, (2_000, len(counts)))])
    for i, e in enumerate(("entropy", "miller_madow", "chao_shen")):
        r, spread = got["a", e], drawn[:, i].std()
        assert abs(r.value - own[i]) < 1e-9 and r.low < r.value < r.high
        for bound, q in ((r.low, 2.5), (r.high, 97.5)):
            assert abs(bound - (np.percentile(drawn[:, i], q) - drawn[:, i].mean() + own[i])) < 0.25 * spread


def test_summary_rows_with_intervals(spark):
    df = spark.createDataFrame([("a", c) for c in (10, 20, 30, 40, 5, 5)] + [(None, 7)], "g string, count long")
    rows = {r.g: r for r in K.entropy_summary(df, ["g"], 3, replicates=100, seed="7").collect()}
    assert rows["a"].entropy_low < rows["a"].entropy < rows["a"].entropy_high
    assert rows[None].entropy_low == rows[None].entropy == rows[None].entropy_high == 0
    plain = {r.g: r for r in K.entropy_summary(df, ["g"], 3).collect()}
    assert all(plain[g][c] == rows[g][c] for g in plain for c in plain[g].asDict())
    whole = K.entropy_summary(df, [], 3, replicates=100).first()
    assert whole.entropy_low < whole.entropy < whole.entropy_high and whole.n_types == 7
    assert R.entropy_interval(df.where("g is null"), "count", "count").first() == R.entropy_interval_normal(df.where("g is null"), "count").first()


def test_noise_ceiling_draws_once_for_all_floors(spark):
    """Against pandas' ranks of poisson_count's own numbers, with small and large means and a null key; draws are no chain of columns and are counted before they are ranked."""
    import pandas as pd

    rng = random.Random(9)
    rows = [(f"k{i}", None if i % 9 == 0 else rng.randrange(0, 12), rng.choice([0, 3, 8, 90])) for i in range(120)] + [(None, 4, 5)]
    df = spark.createDataFrame(rows, "k string, x long, y long")
    got = R.noise_ceiling(df, "k", "x", "y", [0, 5, 20], 4, "s")
    na, nb = sum(r[1] or 0 for r in rows), sum(r[2] for r in rows)
    p = F.coalesce("x", F.lit(0)) + F.col("y")
    side = lambda total, name: poisson_count(p / (na + nb) * total, F.col("k"), F.col("r").cast("string"), F.lit(f"s{name}"))
    sim = df.crossJoin(spark.range(4).withColumnRenamed("id", "r")).select(p.alias("p"), "r", side(na, "a").alias("a"), side(nb, "b").alias("b")).toPandas()
    for x in got.collect():
        own = sim[sim.p >= x.floor]
        r = [g.a.rank().corr(g.b.rank()) for _, g in own.groupby("r")]
        assert abs(x.ceiling - pd.Series(r).mean()) < 1e-9 and abs(x.ceiling_p05 - pd.Series(r).quantile(0.05)) < 1e-9
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
