"""Operating points over a grid, and exact quantiles, against plain versions."""

import random

import numpy as np
import pytest

from helixmill.operators import ranks as R
from helixmill.operators import scores as C
from helixmill.operators.surfaces import f1_surface


def plain_f1(p, label, n, a, b, u, v):
    w = np.ones(n)
    w[a], w[b] = u, v
    said = (p * w).argmax(axis=1)
    f = []
    for c in range(n):
        down = (label == c).sum() + (said == c).sum()
        f.append(2 * ((label == c) & (said == c)).sum() / down if down else 0.0)
    return float(np.mean(f))


@pytest.mark.parametrize("n,a,b,ties", [(3, 1, 2, False), (3, 2, 0, False), (4, 0, 3, True), (3, 1, 2, True), (2, 1, 0, True)])
def test_surface_is_the_plain_one(spark, n, a, b, ties):
    rng = np.random.default_rng(n + a)
    p = rng.integers(0, 4, (300, n)) / 4.0 if ties else rng.dirichlet(np.ones(n), 300)
    label = rng.integers(0, n, 300)
    wa, wb = C.geometric(0.25, 4.0, 9), C.geometric(0.5, 2.0, 7)
    df = spark.createDataFrame([(int(y), [float(v) for v in x]) for y, x in zip(label, p)], "y long, p array<double>").repartition(3)
    got = f1_surface(df, "y", "p", n, a, b, wa, wb)
    assert [(u, v) for u, v, _ in got] == [(u, v) for u in wa for v in wb]
    if ties:  # weights that are powers of two, so that equal products are equal
        wa = wb = [0.25, 0.5, 1.0, 2.0]
        got = f1_surface(df, "y", "p", n, a, b, wa, wb)
    assert [f for *_, f in got] == pytest.approx([plain_f1(p, label, n, a, b, u, v) for u in wa for v in wb], abs=1e-12)


def test_search_finds_the_best_of_both_grids(spark):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 3, 400)
    p = rng.dirichlet(np.ones(3), 400) * 0.6 + 0.4 * np.eye(3)[label] * np.array([1.0, 0.5, 1.6])
    df = spark.createDataFrame([(int(y), [float(v) for v in x]) for y, x in zip(label, p)], "y long, p array<double>")
    best = C.weight_search(df, "y", "p", 3, 0, (1, 2))
    wide = [(plain_f1(p, label, 3, 1, 2, u, v), -u, -v) for u in C.geometric(0.25, 4.0, 25) for v in C.geometric(0.25, 4.0, 25)]
    f, u, v = max(wide)
    fine = [(plain_f1(p, label, 3, 1, 2, x, y), -x, -y) for x in C.geometric(-u / 1.6, -u * 1.6, 17) for y in C.geometric(-v / 1.6, -v * 1.6, 17)]
    want = max(fine) if max(fine)[0] >= f else (f, u, v)
    assert (best["macro_f1"], best["wa"], best["wb"]) == pytest.approx((want[0], -want[1], -want[2]), abs=1e-12)


def test_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -3.5, 1e9, float(rng.randrange(50)), rng.gauss(0, 1e-3)])) for _ in range(800)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in R.quantiles(df, ["g"], "x", shares).collect()}
    for g in ("a", "b", None, "one"):
        assert got[g] == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], shares).tolist(), rel=1e-12)
    assert "none" not in got and R.quantiles(df.where("g = 'none'"), [], "x", [0.5]).first().q == [None]
