"""Classifiers on hashed k-mers: planted classes, features and scores by hand, folds by their counts."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helixmill.functions.seq import splitmix64
from helixmill.operators import classify as L

BUCKETS = 64


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(3)
    motifs = {"one": "AC", "two": "AG", "three": "AT"}
    rows = []
    for i, (label, m) in enumerate(motifs.items()):
        for j in range(9):
            seq = "".join(c if rng.random() < 0.9 else rng.choice("ACGT") for c in (m * 20))
            rows.append((i * 100 + j, label, seq))
    return spark.createDataFrame(rows, "id long, label string, seq string")


def by_hand(seq, k, norm, canonical):
    x = np.zeros(BUCKETS)
    for i in range(len(seq or "") - k + 1):
        part = seq[i : i + k]
        if canonical:
            part = min(part, part[::-1].translate(str.maketrans("ACGT", "TGCA")))
        code = 0
        for c in part:
            code = 4 * code + "ACGT".index(c)
        x[int(splitmix64(np.array([code], np.uint64))[0] % np.uint64(BUCKETS))] += 1
    size = np.abs(x).sum() if norm == 1 else np.sqrt((x * x).sum())
    return x / size if size else x


@pytest.mark.parametrize("norm,canonical", [(1, False), (2, True)])
def test_features_of_several_k(spark, norm, canonical):
    seqs = {1: "ACGTTGCAAC", 2: "AC", 3: "", 4: None, 5: "TTTTTTTT", 6: "ACGTTGCAAC"}
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    got = {(r.id, r.k): np.array(r.a) for r in L.hashed_features(df, "id", [2, 3], BUCKETS, norm, canonical).select("id", "k", vector_to_array("features").alias("a")).collect()}
    assert len(got) == 12
    for (i, k), a in got.items():
        assert np.allclose(a, by_hand(seqs[i], k, norm, canonical)), (i, k)
    assert L.hashed_features(df.limit(0), "id", [2], BUCKETS).count() == 0


def test_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(17)], "id long, label string")
    got = L.stratified_folds(df, "id", "label", 3, "1")
    sizes = {(r.label, r.fold): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    assert sorted(n for (c, _), n in sizes.items() if c == "a") == [3, 3, 4] and sorted(n for (c, _), n in sizes.items() if c == "b") == [2, 2, 3]
    assert sorted(map(tuple, L.stratified_folds(df.repartition(5), "id", "label", 3, "1").collect())) == sorted(map(tuple, got.collect()))


def test_ablation(spark, reads):
    """Separable classes score well at each k, folds are clamped to the smallest class, and a second run gives the same."""
    run = lambda df, **o: sorted(map(tuple, L.ablation(df, "id", "label", [2, 3], BUCKETS, folds=3, seed="5", iterations=20, **o).collect()))
    first = run(reads)
    assert [r[:6] for r in first] == [(2, 27, 3, BUCKETS, False, 3), (3, 27, 3, BUCKETS, False, 3)]
    assert all(r[6] > 0.8 and r[8] > 0.8 and 0 <= r[7] < 0.3 for r in first)
    assert np.allclose([r[6:] for r in run(reads.repartition(3), parallel=1)], [r[6:] for r in first])
    few = run(reads.where("label <> 'one' or id < 2").unionByName(reads.limit(1).withColumn("label", F.lit(None).cast("string"))), per_label=4)
    assert few[0][:6] == (2, 10, 3, BUCKETS, False, 2)
    with pytest.raises(ValueError, match="two classes"):
        run(reads.where("label = 'one'"))


def test_scores_of_any_model(spark, reads):
    """A linear model gives MLlib's probabilities and those by hand for each read, too short and null ones as well; a custom model is loaded once a task."""
    x = L.hashed_features(reads, "id", [3], BUCKETS, 2, True).join(reads.select("id", F.when(F.col("label") == "one", 0.0).when(F.col("label") == "two", 1.0).otherwise(2.0).alias("label")), "id")
    model = L.fit_linear(x, 27, iterations=20)
    w, b = L.linear_parts(model)
    more = reads.select("id", "seq").unionByName(spark.createDataFrame([(900, "AC"), (901, None), (902, "")], "id long, seq string"))
    got = {r.id: np.array(r.p) for r in L.score_rows(more, L.linear_scorer(w, b, 3, 2, True), ["id"]).collect()}
    ml = {r.id: np.array(r.p) for r in L.transformed(model, L.hashed_features(more, "id", [3], BUCKETS, 2, True), "id").collect()}
    assert set(got) == set(ml) and len(got) == 30
    for r in more.collect():
        z = w @ by_hand(r.seq, 3, 2, True) + b
        assert np.allclose(got[r.id], np.exp(z) / np.exp(z).sum()) and np.allclose(got[r.id], ml[r.id])

    def load():
        return lambda batch: np.array([[len(s or ""), 1.0] for s in batch.column("seq").to_pylist()])

    assert {r.id: list(r.q) for r in L.score_rows(more, load, ["id"], "q").collect()}[900] == [2.0, 1.0]
    assert L.score_rows(more.limit(0), load, ["id"]).collect() == []


def test_evaluation_by_hand(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 1), (None, 1)], "label int, pred int")
    got = {r["class"]: r for r in L.evaluation(df, "label", "pred").collect()}
    assert (got[0].support, got[0].precision, got[0].recall) == (4, 1.0, 0.75) and (got[1].precision, got[1].recall) == (0.5, 1.0)
    assert got[2].f1 == 0 and abs(got[0].accuracy - 5 / 7) < 1e-12 and abs(got[0].macro_f1 - (6 / 7 + 2 / 3 + 0) / 3) < 1e-12


def test_dense_features_are_the_hashed_ones(spark):
    """Short, empty and null reads, both norms, slices of one text and of many; no k-mer leaves its row, so nothing is shuffled."""
    import random

    from helixmill.operators.classify import bucket_shares, dense_features, hashed_features

    rng = random.Random(8)
    texts = ["", "ACG", None, "ACGTA"] + ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    for norm, canonical in ((1, False), (2, True)):
        want = {r.id: r.features.toArray() for r in hashed_features(df, "id", [5], 64, norm, canonical).collect()}
        made = dense_features(df, ["id"], 5, 64, norm, canonical)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.features.toArray() for r in made.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]).max() < 1e-12 for i in want)
        whole, cut = ({(f + a, b): x for f, at, bs, xs in bucket_shares(texts, 5, 64, norm, canonical, n) for a, b, x in zip(at.tolist(), bs.tolist(), xs.tolist())} for n in (1 << 20, 50))
        assert whole == cut and whole
