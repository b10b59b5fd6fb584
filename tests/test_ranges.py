"""Ranks, running sums, merges and exact tests that work in ranges, against plain versions."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from helixmill.functions import stats
from helixmill.operators.thinning import thinned
from helixmill.operators import intervals as I
from helixmill.operators import kmers as K
from helixmill.operators import loci as O
from helixmill.operators import ranks as R
from helixmill.operators import scores as C


def test_mid_ranks_are_average_ranks(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1e-300, -1e-300, 1e300, -5.5, 1.0, 1.0, 2.0, math.inf, -math.inf] + [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), float(rng.randrange(-3, 3))]) for _ in range(400)]
    rows = [(rng.choice(["a", "b", None]), i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    got = {r.i: r.r for r in R.with_mid_ranks(df, ["g"], {"r": "x"}).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "i", "x"]).fillna({"g": "none"})
    want = dict(zip(pdf.i, pdf.groupby("g").x.rank()))
    assert got == want
    assert {r.i: r.r for r in R.with_mid_ranks(df, [], {"r": "x"}).collect()} == dict(zip(pdf.i, pdf.x.rank()))
    assert R.with_mid_ranks(df.where("i < 0"), ["g"], {"r": "x"}).count() == 0


def test_running_sums_both_ways(spark):
    steps = [(g, float(x), x + 1) for g in "ab" for x in range(-5, 2000, 3)]
    df = spark.createDataFrame(steps, "g string, x double, n long")
    for down in (False, True):
        got = {(r.g, r.x): (r.c, r.total_c) for r in R.running_sums(df, ["g"], "x", {"c": "n"}, down).collect()}
        for g in "ab":
            own = [(x, n) for h, x, n in steps if h == g]
            for x, _ in own[::50]:
                assert got[g, x] == (sum(n for y, n in own if (y >= x if down else y <= x)), sum(n for _, n in own))


def test_merged_across_bins(spark):
    rng = random.Random(5)
    rows = []
    for c in ("c1", "c2", None):
        for _ in range(300):
            s = rng.randrange(-200, 3000)
            rows.append((c, s, s + rng.choice([0, 1, 3, 9, 9, 9, 400 if rng.random() < 0.05 else 2])))
    rows += [("c3", 0, 10), ("c3", 10, 20), ("c3", 21, 5000), ("c3", 100, 200), ("c3", 5000, 5001), ("c3", 5003, 5004)]
    want = set()
    for c in {r[0] for r in rows}:
        out = []
        for s, e in sorted((s, e) for h, s, e in rows if h == c):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want |= {(c, s, e) for s, e in out}
    df = spark.createDataFrame(rows, "contig string, start long, end long")
    for width in (16, 1 << 16):
        got = [tuple(r) for r in I.merged(df, width=width).select("contig", "start", "end").collect()]
        assert len(got) == len(want) and set(got) == want


def test_one_vs_rest_by_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), [round(rng.random(), 2) for _ in range(3)]) for _ in range(200)]
    got = {r["class"]: r for r in C.one_vs_rest(spark.createDataFrame(rows, "label int, p array<double>"), "label", "p").collect()}
    for c in range(3):
        pos, neg = ([p[c] for y, p in rows if (y == c) == side] for side in (True, False))
        assert math.isclose(got[c].auc, sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))


def test_concentration_with_ties(spark):
    values = [5.0] * 7 + [3.0, 2.0, 2.0, 2.0, 1.0] * 4 + [0.0, 0.0]
    got = O.concentration(spark.createDataFrame([("m", v) for v in values], "m string, v double"), ["m"], "v").first()
    run, need = 0.0, {}
    for i, v in enumerate(sorted(values, reverse=True), 1):
        run += v
        for s in (0.5, 0.9, 0.99):
            if run / sum(values) >= s:
                need.setdefault(f"n_{round(100 * s)}", i)
    assert {k: got[k] for k in need} == need


def test_exact_tests_walk_to_the_sum_of_all_tables():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randrange(1, 60)
        inside, top = rng.randrange(0, n + 1), rng.randrange(0, n + 1)
        lo, hi = max(0, inside + top - n), min(inside, top)
        a = rng.randrange(lo, hi + 1)
        p = {k: math.comb(top, k) * math.comb(n - top, inside - k) / math.comb(n, inside) for k in range(lo, hi + 1)}
        assert math.isclose(stats.fisher_two_sided(a, inside, top, n), sum(x for x in p.values() if x <= p[a] * (1 + 1e-7)), rel_tol=1e-7)
        assert math.isclose(stats.hypergeometric_tail(a, inside, top, n), sum(x for k, x in p.items() if k >= a), rel_tol=1e-7, abs_tol=1e-12)
    assert 0 < stats.fisher_two_sided(500_100_000, 10**9, 10**9, 2 * 10**9) < 1e-15


def test_spectrum_is_counts_of_the_sampled_reads(spark):
    rng = random.Random(13)
    reads = spark.createDataFrame([(i, "xy"[i % 2], "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 300)))) for i in range(40)], "id int, corpus string, seq string")
    got = {(r.corpus, r.fraction, r.replicate, r.k): (r.n_kmers, r.n_types) for r in K.spectrum(reads, "id", "corpus", [2, 5], [0.3, 1.0], 2, "s").collect()}
    chosen = K.nested_sample(reads, "id", [0.3, 1.0], 2, "s").collect()
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for c, f, r, k in got:
        seqs = [x.seq for x in chosen if (x.corpus, x.fraction, x.replicate) == (c, f, r)]
        kmers = [min(s[i : i + k], rc(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1)]
        assert got[c, f, r, k] == (len(kmers), len(set(kmers)))
    assert len(got) == 16


def test_long_sequences_are_tiled_without_loss(spark):
    from helixmill.functions import seq as S

    rng = random.Random(17)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 8, 9, 128, 137, 65536, 65545, 140000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    got = S.explode_kmers(df, 9).select("id", "offset", "kmer", F.col("offset").alias("o")).toPandas()
    assert len(got) == sum(max(0, len(t) - 8) for t in texts) == len(got.drop_duplicates(["id", "offset"]))
    assert all(texts[i][o : o + 9] == m for i, o, m in zip(got.id, got.offset, got.kmer))


def test_thinning_of_a_count_over_one_block(spark):

    rows = spark.createDataFrame([("a", 150_000), ("b", 65_536), ("c", 1), ("d", 0)], "locus string, n long")
    got = {r.locus: r.n for r in thinned(rows, "locus", "n", 100_000).collect()}
    assert sum(got.values()) == 100_000 and got["d"] == 0 and abs(got["a"] - 69_600) < 1500
    assert {r.locus: r.n for r in thinned(rows, "locus", "n", 10**6).collect()} == {"a": 150_000, "b": 65_536, "c": 1, "d": 0}
