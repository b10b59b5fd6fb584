"""Thinned counts: sums, distribution, draws of any size."""

import math
import time

import numpy as np
import pytest

from helixmill.operators import thinning as T


@pytest.mark.parametrize("n,k,t", [(10, 4, 5), (30, 30, 7), (30, 0, 7), (100, 60, 70), (400, 13, 390), (5_000, 2_500, 100)])
def test_draws_follow_the_distribution_function(n, k, t):
    lo, hi = max(0, k + t - n), min(k, t)
    cdf, total = [], 0.0
    for j in range(lo, hi + 1):
        total += math.comb(k, j) * math.comb(n - k, t - j) / math.comb(n, t)
        cdf.append(total)
    for u in np.random.default_rng(1).random(300):
        assert T.hypergeometric(n, k, t, u) == lo + int(np.searchsorted(cdf[:-1], u, side="right"))


def test_chunks_do_not_matter(monkeypatch):
    draws = lambda: [T.hypergeometric(10**6, 300_000, 500_000, u) for u in (1e-12, 1e-9, 0.2, 0.5, 0.9, 1 - 1e-12)]
    want = draws()
    monkeypatch.setattr(T, "CHUNK", 97)
    assert draws() == want and want == sorted(want)


def test_large_counts(spark):
    """Loci of 10^10 reads in seconds, without a row a read; sums are exact and shares near the target's."""
    rows = [(f"l{i}", n) for i, n in enumerate([10**10, 3 * 10**9, 10**6, 5, 0, 1] + [10**5] * 500)] + [("none", None)]
    df = spark.createDataFrame(rows, "locus string, n long").repartition(3)
    began, target = time.time(), 4 * 10**9
    got = {r.locus: r.n for r in T.thinned(df, "locus", "n", target).collect()}
    assert time.time() - began < 60
    total = sum(n or 0 for _, n in rows)
    assert sum(got.values()) == target and set(got) == {r[0] for r in rows} and got["none"] == got["l4"] == 0
    for locus, n in rows:
        if n and n > 10**5:
            share = target / total
            assert abs(got[locus] - n * share) < 6 * math.sqrt(n * share * (1 - share)) and got[locus] <= n


def test_distribution_over_seeds():
    """Three parts of 5, 3 and 2, four taken: every outcome as often as its multivariate hypergeometric probability says."""
    n, seen = 6_000, {}
    for s in range(n):
        x = T.split_target({0: 5, 1: 3, 4_000: 2}, 4, str(s))
        x = tuple(x.get(r, 0) for r in (0, 1, 4_000))
        seen[x] = seen.get(x, 0) + 1
    chi = 0.0
    outcomes = [(a, b, 4 - a - b) for a in range(5) for b in range(4) if 0 <= 4 - a - b <= 2]
    for a, b, c in outcomes:
        want = n * math.comb(5, a) * math.comb(3, b) * math.comb(2, c) / math.comb(10, 4)
        chi += (seen.get((a, b, c), 0) - want) ** 2 / want
    assert sum(seen.get(x, 0) for x in outcomes) == n and chi < 3 * len(outcomes)


def test_keys_of_one_range_and_clashing_columns(spark):
    rows = [(i, 10, i, "r") for i in range(20_000)]  # about five keys a range
    df = spark.createDataFrame(rows, "key long, n long, range int, row string")
    out = T.thinned(df, "key", "n", 70_000, "3")
    got = out.collect()
    assert out.columns == df.columns and sum(r.n for r in got) == 70_000 and all(r.range == r.key and 0 <= r.n <= 10 for r in got)
    counts = np.bincount([r.n for r in got], minlength=11)
    want = [20_000 * math.comb(10, j) * 0.35**j * 0.65 ** (10 - j) for j in range(11)]
    assert sum((a - b) ** 2 / b for a, b in zip(counts, want) if b > 5) < 40
    assert sum(r.n for r in T.thinned(df, "key", "n", 10**9).collect()) == 200_000 and T.thinned(df.limit(0), "key", "n", 5).count() == 0
