"""p-values on small result tables, and keyed random weights."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.seq import keyed_uniform


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _hypergeometric(k: int, inside: int, top: int, n: int) -> float:
    """P(k of the `inside` drawn are among the `top` of n)."""
    return math.exp(_log_choose(top, k) + _log_choose(n - top, inside - k) - _log_choose(n, inside))


def _sum_from(k: int, step: int, inside: int, top: int, n: int) -> float:
    """The sum of the probabilities from k on, away from the mode: each from the one before, until they no longer count."""
    lo, hi = max(0, inside + top - n), min(inside, top)
    p = total = _hypergeometric(k, inside, top, n) if lo <= k <= hi else 0.0
    while lo <= k + step <= hi and p > total * 1e-17:
        up, down = (top - k) * (inside - k), k * (n - top - inside + k)
        p *= up / ((k + 1) * (n - top - inside + k + 1)) if step > 0 else down / ((top - k + 1) * (inside - k + 1))
        total, k = total + p, k + step
    return total


def hypergeometric_tail(a: int, inside: int, top: int, n: int) -> float:
    """P(at least a of the `inside` drawn are among the `top` of n), in constant memory."""
    lo, hi = max(0, inside + top - n), min(inside, top)
    if a <= lo or a > hi:
        return float(a <= lo)
    mode = (inside + 1) * (top + 1) // (n + 2)
    return min(1.0, _sum_from(a, 1, inside, top, n)) if a > mode else max(0.0, 1.0 - _sum_from(a - 1, -1, inside, top, n))


def fisher_two_sided(a: int, inside: int, top: int, n: int) -> float:
    """Sum of the probabilities of all tables that are no likelier than this one: those from a on, and those beyond the place on the other side of the mode, found by halving."""
    lo, hi = max(0, inside + top - n), min(inside, top)
    mode = min(hi, max(lo, (inside + 1) * (top + 1) // (n + 2)))
    most = _hypergeometric(a, inside, top, n) * (1 + 1e-7)
    if _hypergeometric(mode, inside, top, n) <= most:
        return 1.0
    step = 1 if a > mode else -1
    near, far = mode, (lo if step > 0 else hi)  # at near a table is likelier than this one
    if _hypergeometric(far, inside, top, n) > most:
        return min(1.0, _sum_from(a, step, inside, top, n))
    while abs(far - near) > 1:
        mid = (near + far) // 2
        near, far = (mid, far) if _hypergeometric(mid, inside, top, n) > most else (near, mid)
    return min(1.0, _sum_from(a, step, inside, top, n) + _sum_from(far, -step, inside, top, n))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / (c or tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def correlation_p(r: float, df: int) -> float:
    """Two-sided, from t with df degrees of freedom."""
    if r is None or df < 1 or abs(r) >= 1:
        return 0.0 if r is not None and abs(r) >= 1 and df >= 1 else float("nan")
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def signed_rank_p(n: int, plus: float, ties: float) -> float:
    """Two-sided Wilcoxon p of n non-zero differences from their positive ranks' sum and sum(t^3 - t) over ties: exact by counting rank sums up to 50 untied ones, else the normal approximation."""
    if n == 0:
        return float("nan")
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and ties == 0:
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if s >= r else 0) for s in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(low - n * (n + 1) / 4) / sd / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, inside: pd.Series, top: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(*map(int, x)) for x in zip(a, inside, top, n)])


@F.pandas_udf(T.DoubleType())
def fisher_two(a: pd.Series, inside: pd.Series, top: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, inside, top, n)])


@F.pandas_udf(T.DoubleType())
def r_p_value(r: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(x, int(k)) for x, k in zip(r, df)])


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(n: pd.Series, plus: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b), float(c)) for a, b, c in zip(n, plus, ties)])


def normal_p(z: Column) -> Column:
    """Two-sided, by an approximation of the error function good to 1.2e-7 (there is none in SQL)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    #: Coefficients of the approximation, lowest power first.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = k + t * poly
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def poisson_weight(*key: Column | str) -> Column:
    """A Poisson(1) number that depends on the key only: how many cumulative probabilities its keyed uniform reaches."""
    u, total, out = keyed_uniform(*key), 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= total, 1).otherwise(0)
    return out


def poisson_count(mean: Column, *key: Column | str) -> Column:
    """A Poisson(mean) number by the key: by its cumulative probabilities up to a mean of 30, by the normal one beyond."""
    u = keyed_uniform(*key)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c")), lambda s, i: F.when(s["c"] <= u, F.struct(i.alias("k"), (s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"))).otherwise(s))
    v = keyed_uniform(*key, F.lit("n"))
    normal = F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)
    return F.when(mean <= 30, steps["k"].cast("double")).otherwise(F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * normal)))
