"""Rules with thresholds, on planted tables worked by hand from each rule's own text."""

import math

import pytest
from pyspark.sql import functions as F

from helixmill.operators import kmers as K
from helixmill.operators import loci as O


def spectrum(spark, per_k, corpus="c", fraction=0.5):
    """Mean entropies of the full and of one smaller sample by k, gains against the k before."""
    rows, last = [], {}
    for k, pair in per_k.items():
        for f, h in zip((1.0, fraction), pair):
            if h is not None:
                rows.append((corpus, k, f, h, h - last.get(f, h)))
                last[f] = h
    return spark.createDataFrame(rows, "corpus string, k int, fraction double, miller_madow double, gain double")


def ablation(spark, per_k):
    return spark.createDataFrame([(k, *x) for k, x in per_k.items()], "k int, macro_f1_mean double, macro_f1_std double")


def test_plateau_in_the_reliable_range(spark):
    mean = spectrum(spark, {2: (2.0, 2.0), 3: (3.0, 3.0), 4: (3.90, 3.90), 5: (3.92, 3.92), 6: (3.93, 3.93)})
    r = K.choose_k(mean, ablation(spark, {2: (0.6, 0.02), 3: (0.8, 0.02), 4: (0.9, 0.02), 5: (0.92, 0.02), 6: (0.92, 0.02)}), epsilon=0.05, tau=0.05).first()
    assert tuple(r) == ("c", 6, 5, 4, True, 5)


def test_plateau_of_thin_samples_defers(spark):
    mean = spectrum(spark, {2: (2.0, 2.0), 3: (3.0, 3.0), 4: (4.0, 4.0), 5: (4.04, 3.0), 6: (4.07, 2.9)})
    r = K.choose_k(mean, ablation(spark, {2: (0.6, 0.02), 3: (0.7, 0.02), 4: (0.8, 0.02), 5: (0.85, 0.02), 6: (0.9, 0.02)}), epsilon=0.05, tau=0.05).first()
    assert tuple(r) == ("c", 4, 5, 6, False, 6)
    assert tuple(K.choose_k(mean, epsilon=0.05, tau=0.05).first()) == ("c", 4, 5, None, False, 4)


def test_edges_of_the_gates(spark):
    """Thresholds are strict, the smallest k never is a plateau, no entropy is not saturated, the nearest fraction counts, none passes all."""
    r = K.choose_k(spectrum(spark, {2: (1.0, 1.0), 3: (2.0, 2.0), 4: (2.03, 2.03), 5: (2.05, 2.05)})).first()  # gains 0, 1, 0.03, 0.02
    assert (r.plateau_k, r.recommended_k) == (4, 4)
    g = {x.k: x for x in K.k_gates(spectrum(spark, {2: (1.0, 0.75), 3: (1.25, 1.25), 4: (0.0, 0.0), 5: (2.0, None)}), epsilon=0.25, tau=0.25).collect()}
    assert not g[2].saturated and not g[2].below_tau and g[3].saturated and not g[3].below_tau and not g[4].saturated and not g[5].saturated
    both = spectrum(spark, {2: (2.0, 1.0)}, fraction=0.4).unionByName(spectrum(spark, {2: (2.0, 2.0)}, fraction=0.55)).distinct()
    assert K.k_gates(both).first().drift == 0.0
    assert K.k_gates(spectrum(spark, {2: (2.0, None), 3: (3.0, None)})).where("saturated").count() == 2


def test_depth_gate(spark):
    """200 loci of 10 reads: none is over 1 %, so the gate does not pass."""
    rows = [("even", 10)] * 200 + [("good", 500), ("good", 495), ("good", 5)] + [("shallow", 995), ("shallow", 5)] + [("thin", 100)] + [("weak", 400), ("weak", 9)] * 2 + [("weak", 200)]
    got = {r.m: tuple(r)[1:] for r in O.depth_gate(spark.createDataFrame(rows, "m string, n long"), ["m"], "n", least=1000, each=10).collect()}
    assert got == {"even": (2000, 0, 0, None, False), "good": (1000, 2, 2, 495, True), "shallow": (1000, 1, 1, 995, True), "thin": (100, 1, 1, 100, False), "weak": (1018, 3, 3, 200, True)}
    low = spark.createDataFrame([("x", 300)] * 3 + [("x", 15)] * 7, "m string, n long")
    assert not O.depth_gate(low, ["m"], "n", each=20).first().passes


def residuals(x, z):
    n, mx, mz = len(x), sum(x) / len(x), sum(z) / len(z)
    slope = sum((a - mx) * (b - mz) for a, b in zip(x, z)) / sum((b - mz) ** 2 for b in z)
    return [a - mx - slope * (b - mz) for a, b in zip(x, z)]


def corr(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def mid_ranks(v):
    return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]


@pytest.mark.parametrize("ranked", [False, True])
def test_partial_correlation_is_that_of_residuals(spark, ranked):
    x, y, z = (list(map(float, v)) for v in ("1428577", "2339486", "1224935"))
    rows = spark.createDataFrame(list(zip(x, y, z)), "x double, y double, z double")
    f = mid_ranks if ranked else list
    want = corr(residuals(f(x), f(z)), residuals(f(y), f(z)))
    got = O.with_p(O.partial_correlation(rows, [], "x", "y", "z", ranked)).first()
    assert abs(got.r - want) < 1e-12 and got.n == 7
    t = want * math.sqrt(5 / (1 - want**2))  # 5 = n - 2 degrees of freedom: the distribution has a closed form
    a = math.atan(abs(t) / math.sqrt(5))
    inside = 2 / math.pi * (a + math.sin(a) * (math.cos(a) + 2 / 3 * math.cos(a) ** 3))
    assert abs(got.p - (1 - inside)) < 1e-10


def test_adjusted_correlations(spark):
    """A covariate that makes both columns: the raw r is high, the partial one is not."""
    z = list(range(30))
    rows = [(float(10 * i + (i * 7) % 5), float(20 * i + (i * 11) % 7), float((i * 13) % 17), float(i)) for i in z]
    df = spark.createDataFrame(rows, "a double, b double, c double, z double")
    got = {(r.own, r.other): r for r in O.adjusted_correlations(df, ["a"], ["b", "c"], {"z": "z"}, "z").collect()}
    r = got["a", "b"]
    a, b, zz = ([x[i] for x in rows] for i in (0, 1, 3))
    assert abs(r.pearson_r - corr(a, b)) < 1e-12 and abs(r.partial_r_z - corr(residuals(a, zz), residuals(b, zz))) < 1e-9
    assert r.explains and r.pearson_p < 1e-20 and abs(r.delta_r_z - (r.partial_r_z - r.pearson_r)) < 1e-15 and abs(r.spearman_rho - corr(mid_ranks(a), mid_ranks(b))) < 1e-12
    assert set(got) == {("a", "b"), ("a", "c")}
