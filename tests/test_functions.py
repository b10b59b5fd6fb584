import math
import random

import pytest
from pyspark.sql import functions as F

from helixmill.functions import seq as S
from helixmill.functions import stats as ST
from helixmill.operators import kmers as K
from helixmill.operators import labels as L


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_sequences(spark):
    r = one(spark, S.standardize(F.lit("acNtg-x")), S.reverse_complement(F.lit("ACGTacgtN")), S.kmers(F.lit("ACGTA"), 3), S.kmers(F.lit("AC"), 3), S.kmers(F.lit(""), 3), S.base_code(F.lit("CAT")), S.canonical_kmer(F.lit("TTG")))
    assert tuple(r) == ("ACTG", "NACGTACGT", ["ACG", "CGT", "GTA"], [], [], 19, "CAA")
    with pytest.raises(Exception, match="only A, C, G and T"):
        one(spark, S.packed(F.lit("ACN"), 2))
    assert len(one(spark, S.packed(F.lit("ACGTA"), 2)).c0) == 2


def test_long_sequences_are_tiled(spark):
    seq = "".join("ACGT"[i * i % 7 % 4] for i in range(1500))
    rows = S.explode_kmers(spark.createDataFrame([(1, seq), (2, "AC"), (3, "")], "id int, seq string"), 9).orderBy("offset").collect()
    assert [r.kmer for r in rows] == [seq[i : i + 9] for i in range(1492)]


def test_entropy(spark):
    uniform = spark.createDataFrame([("u", 5)] * 4 + [("one", 7)] + [("s", 1)] * 3, "g string, count long")
    got = {r.g: r for r in K.entropy_summary(uniform, ["g"], 2).collect()}
    assert got["u"].entropy == pytest.approx(2) and got["u"].miller_madow == pytest.approx(2 + 3 / (40 * math.log(2))) and got["u"].kl_full == pytest.approx(2)
    assert got["one"].entropy == 0 and got["one"].redundancy_observed == 1
    assert got["s"].coverage == 0 and got["s"].chao_shen == pytest.approx(math.log2(3))


def test_labels(spark):
    ids = [("T|x|L1HS-3", "L1HS"), ("NEGATIVE", "NEGATIVE"), ("a|L1PREC2", "L1PA"), ("a|L1M4", "OTHER")]
    df = spark.createDataFrame(ids, "id string, want string")
    assert df.where(S.task_label(F.col("id")) != F.col("want")).count() == 0
    r = one(spark, S.fragment_key(F.lit("T|f/1|L1HS")), S.mate_key(F.lit("T|f/2|L")), S.uid(F.lit("UID-107.x:1")))
    assert tuple(r) == ("T|f", "T|f|L", "UID107")
    with pytest.raises(Exception, match="bad region"):
        one(spark, S.parse_region(F.lit("x")))


def test_small_classes_are_split_train_first(spark):
    rows = [(f"{c}{t}", c, i) for c, n in (("a", 1), ("b", 2), ("c", 3), ("d", 40)) for t in range(n) for i in range(2)]
    df = spark.createDataFrame([(g, c, i) for i, (g, c, _) in enumerate(rows)], "tid string, label string, rec long")
    s = L.group_split(df, "tid", "label", "rec", 0.25, 0.25)
    assert L.leaks(s, "tid").count() == 0 and s.count() == df.count()
    got = {(r.label, r.split): r.n for r in s.groupBy("label", "split").agg(F.count_distinct("tid").alias("n")).collect()}
    assert got == {("a", "train"): 1, ("b", "train"): 1, ("b", "test"): 1, ("c", "train"): 1, ("c", "test"): 1, ("c", "eval"): 1, ("d", "train"): 20, ("d", "test"): 10, ("d", "eval"): 10}


def test_pair_encoding_is_the_loop(spark):
    cases = [(a, b, m) for a in (0, 3, 9, 20) for b in (0, 5, 11) for m in (8, 13, 40)]
    for a, b, m in cases:
        x, y = list(range(10, 10 + a)), list(range(100, 100 + b))
        while len(x) + len(y) > m - 3:
            (x if len(x) >= len(y) else y).pop()
        arr = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
        got = one(spark, S.pair_encoding(arr(range(10, 10 + a)), arr(range(100, 100 + b)), m)).c0
        assert got.input_ids == [0, *x, 2, *y, 2] and got.token_type_ids == [0] * (len(x) + 2) + [1] * (len(y) + 1)


def test_p_values():
    assert ST.fisher_two_sided(8, 10, 9, 16) == pytest.approx(0.034965, abs=1e-5)
    assert ST.hypergeometric_tail(8, 10, 9, 16) == pytest.approx(0.0244755, abs=1e-6)
    assert ST.signed_rank_p(9, 45.0, 0.0) == pytest.approx(2 / 512)
    assert ST.signed_rank_p(5, 9.0, 0.0) == pytest.approx(0.8125)
    assert ST.correlation_p(0.5, 8) == pytest.approx(0.141111, abs=1e-5)
    assert ST.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)


def test_poisson_weights(spark):
    df = spark.range(4000).select(ST.poisson_weight(F.col("id").cast("string"), F.lit("s")).alias("w"), ST.poisson_count(F.lit(7.5), F.col("id").cast("string")).alias("k"), ST.poisson_count(F.lit(80.0), F.col("id").cast("string")).alias("b"))
    r = df.agg(F.avg("w").alias("w"), F.var_pop("w").alias("v"), F.avg("k").alias("k"), F.var_pop("k").alias("kv"), F.avg("b").alias("b")).first()
    assert abs(r.w - 1) < 0.06 and abs(r.v - 1) < 0.12 and abs(r.k - 7.5) < 0.2 and abs(r.kv - 7.5) < 0.8 and abs(r.b - 80) < 0.6


def test_hits_and_labels(spark):
    h = lambda i, f, t: F.struct(F.lit(i).alias("identity"), F.lit(f).alias("aligned_frac"), F.lit(t).alias("target"))
    best = S.better_hit(h(0.9, 0.5, "L1PA3#LINE/L1"), h(0.5, 0.9, "x"))
    r = one(spark, best, S.sequence_label(best, 0.8, 0.4), S.sequence_label(best, 0.95, 0.4), S.kmer_position(F.lit(100.0), F.lit("-"), F.lit(0), 10, F.lit(50)), S.significance(F.lit(0.02)))
    assert r.c0.target == "L1PA3#LINE/L1" and tuple(r.c1) == ("L1PA", "L1PA3") and tuple(r.c2) == ("NEGATIVE", "NEGATIVE") and r.c3 == 120.0 and r.c4 == "*"


def test_packed_in_batches_is_python_of_each_row(spark):
    """More rows than one slice, empty and null ones, left-over bases, one to four bases a character; it is one function, not a chain of columns a base."""
    rng = random.Random(7)
    rows = [(i, None if i % 50 == 0 else "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40)))) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, s string").coalesce(1)
    for n in (1, 2, 4):
        want = {i: None if s is None else "".join(chr(0x4E00 + sum("ACGT".index(c) * 4 ** (n - 1 - j) for j, c in enumerate(s[p : p + n]))) for p in range(0, len(s) - n + 1, n)) for i, s in rows}
        got = df.select("i", S.packed(F.col("s"), n).alias("p"))
        assert {r.i: r.p for r in got.collect()} == want
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
