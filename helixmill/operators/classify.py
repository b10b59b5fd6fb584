"""Linear classifiers on hashed k-mers: features for several k at once, cross-validated ablation of k, evaluation, scoring of any number of reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.seq import code_of_digits, explode_codes, keyed_uniform, splitmix64, splitmix_bucket
from helixmill.operators.kmers import exact_rank
from helixmill.operators.labels import capped
from helixmill.operators.scores import per_class, sparse_vectors


def hashed_features(reads: DataFrame, key: str, ks: list[int], buckets: int, norm: int = 1, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """(key, k, features): each read's share of k-mers by splitmix bucket, for all k in one pass. A read shorter than k (or null) has an empty vector. Keys are unique, and sequences are standardized."""
    counts = explode_codes(reads.select(key, seq), ks, seq, canonical).groupBy(key, "k", "code").agg(F.count("*").alias("_n")).withColumn("code", code_of_digits(F.col("code"), ks))
    cells = counts.groupBy(F.struct(key, "k").alias("_id"), splitmix_bucket(F.col("code"), F.lit(buckets)).alias("bucket")).agg(F.sum("_n").alias("_n"))
    made = sparse_vectors(cells, "_id", "bucket", "_n", buckets, norm).select("_id.*", "features")
    none = reads.sparkSession.createDataFrame([(Vectors.sparse(buckets, [], []),)], T.StructType([T.StructField("_none", VectorUDT())]))
    wanted = reads.select(key, F.explode(F.array(*map(F.lit, ks))).alias("k")).crossJoin(F.broadcast(none))  # one row
    return wanted.join(made, [key, "k"], "left").select(key, "k", F.coalesce("features", "_none").alias("features"))


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: str = "0") -> DataFrame:
    """Adds fold (0 to folds - 1): each class is dealt out in keyed order, so its shares in two folds differ by one row at most."""
    ranked = exact_rank(rows.withColumn("_u", keyed_uniform(F.col(key).cast("string"), F.lit(f"{seed}f"))), [label], "_u", key)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_u", "_rank", "_total")


def fit_linear(rows: DataFrame, n: int, label: str = "label", iterations: int = 100, c: float = 1.0):
    """Multinomial logistic regression whose penalty is 1/c in all, whatever the number n of rows."""
    return LogisticRegression(labelCol=label, maxIter=iterations, regParam=1.0 / (c * max(1, n)), standardization=False, family="multinomial").fit(rows)


def ablation(reads: DataFrame, key: str, label: str, ks: list[int], buckets: int = 1 << 18, canonical: bool = False, per_label: int = 5000, folds: int = 5, seed: str = "0", iterations: int = 100, parallel: int = 4) -> DataFrame:
    """A row for each k: n_reads, n_classes, n_features, canonical, cv_folds, mean and standard deviation (over folds) of accuracy and macro F1.

    At most `per_label` reads of each class in keyed order are used (a parameter that balances the classes); folds are stratified, and
    as many as the smallest class has reads, 2 at least. All k share the reads, the folds and one table of features, which
    is written once to the checkpoint folder; `parallel` fits run at a time. Rows without a label are left out; fewer than
    two classes, or a class of a single read, raise a ValueError.
    """
    rows = capped(reads.where(F.col(label).isNotNull()), key, label, per_label, seed)
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row a class
    if len(sizes) < 2 or min(sizes.values()) < 2:
        raise ValueError(f"two classes of two reads are needed, there are {sizes}")
    folds, total = max(2, min(folds, *sizes.values())), sum(sizes.values())
    dealt = stratified_folds(rows, key, label, folds, seed)
    dealt = dealt.select(key, "seq", "fold", F.col(label).cast("string").alias("_l"))
    dealt = StringIndexer(inputCol="_l", outputCol="label", stringOrderType="alphabetAsc").fit(dealt).transform(dealt).drop("_l")
    table = hashed_features(dealt, key, ks, buckets, 1, canonical).join(dealt.select(key, "fold", "label"), key).select("k", "fold", "label", "features").checkpoint()

    def one(at: tuple[int, int]) -> list[tuple]:
        k, fold = at
        mine = table.where(F.col("k") == k)
        train = mine.where(F.col("fold") != fold)
        got = fit_linear(train, train.count(), iterations=iterations).transform(mine.where(F.col("fold") == fold))
        return [(k, fold, int(r.label), int(r.prediction), r.n) for r in got.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()]  # classes squared at most

    spark = reads.sparkSession
    with ThreadPool(max(1, parallel)) as pool:
        cells = [c for part in pool.map(inheritable_thread_target(spark)(one), [(k, f) for k in ks for f in range(folds)]) for c in part]
    grid = spark.createDataFrame(cells, "k int, fold int, label int, pred int, n long")
    right = grid.groupBy("k", "fold").agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    f1 = per_class(grid, "label", "pred", ["k", "fold"]).groupBy("k", "fold").agg(F.avg("f1").alias("macro_f1"))
    sides = [f(c).alias(f"{c}_{n}") for c in ("accuracy", "macro_f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    facts = {"n_reads": F.lit(total).cast("long"), "n_classes": F.lit(len(sizes)), "n_features": F.lit(buckets), "canonical": F.lit(canonical), "cv_folds": F.lit(folds)}
    return right.join(f1, ["k", "fold"]).groupBy("k").agg(*sides).select("k", *(v.alias(c) for c, v in facts.items()), "accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std")


def evaluation(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """class, support, precision, recall, f1 and, on each row, accuracy and macro_f1 of all. Rows with a null on either side are left out."""
    grid = scored.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    rows = per_class(grid, "label", "pred")
    whole = grid.agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return rows.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(rows.agg(F.avg("f1").alias("macro_f1"))))  # a row each


def score_rows(rows: DataFrame, load: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], keep: list[str], out: str = "p") -> DataFrame:
    """The columns of `keep` and `out`, each row's class probabilities as an array, by any model.

    `load` runs once a task and gives the model: a function from a batch (all columns of rows) to an array of rows x classes.
    Rows stream through in batches, all are scored, none is shuffled. What `load` refers to is sent with the task; a large model it reads from a
    broadcast or a shared file. An empty table gives an empty result.
    """
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            p = np.ascontiguousarray(model(batch), np.float64)
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [*keep, out])

    return rows.mapInArrow(run, schema)


_DIGIT = np.zeros(256, np.int64)
_DIGIT[[ord(c) for c in "ACGT"]] = range(4)


def bucket_shares(texts: list[str | None], k: int, buckets: int, norm: int = 1, canonical: bool = False, bases: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after it, bucket, value) of the vectors of hashed_features of standardized texts, k <= 31, for about `bases` characters at a time (a longer text alone)."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > bases:
            yield first, *_bucket_shares(texts[first:i], k, buckets, norm, canonical)
            first, size = i, 0
        size += n
    yield first, *_bucket_shares(texts[first:], k, buckets, norm, canonical)


def _bucket_shares(texts: list[str | None], k: int, buckets: int, norm: int, canonical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = [(x or "").encode() for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    d, row = _DIGIT[np.frombuffer(b"".join(texts), np.uint8)], np.repeat(np.arange(len(texts)), sizes)
    places = max(0, len(d) - k + 1)
    code, back = np.zeros(places, np.int64), np.zeros(places, np.int64)
    for j in range(k):
        code = code * 4 + d[j : j + places]
        back += (3 - d[j : j + places]) << (2 * j)
    inside = row[:places] == row[len(row) - places :]
    code = (np.minimum(code, back) if canonical else code)[inside]
    bucket = (splitmix64(code.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    cell, n = np.unique(row[:places][inside] * buckets + bucket, return_counts=True)
    at, b = cell // buckets, cell % buckets
    total = np.bincount(at, n if norm == 1 else n.astype(float) ** 2, len(texts))
    return at, b, n / (total if norm == 1 else np.sqrt(total))[at]


def dense_features(rows: DataFrame, keep: list[str], k: int, buckets: int, norm: int = 1, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """The columns of `keep` and features: the vector of hashed_features for a single k and few buckets, a batch of rows at a time; no k-mer is shuffled."""

    def run(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, buckets))
        for first, at, b, x in bucket_shares(batch.column(seq).to_pylist(), k, buckets, norm, canonical):
            out[first + at, b] = x
        return out

    return score_rows(rows, lambda: run, keep, "features").withColumn("features", array_to_vector("features"))


def linear_scorer(weights: np.ndarray, intercept: np.ndarray, k: int, norm: int = 1, canonical: bool = False, seq: str = "seq") -> Callable[[], Callable[[pa.RecordBatch], np.ndarray]]:
    """For score_rows: a linear model (classes x buckets) on the features of hashed_features, straight from standardized sequences of k <= 31."""
    buckets = weights.shape[1]

    def score(batch: pa.RecordBatch) -> np.ndarray:
        logits = np.tile(intercept, (batch.num_rows, 1)).astype(np.float64)
        for first, at, b, x in bucket_shares(batch.column(seq).to_pylist(), k, buckets, norm, canonical):
            np.add.at(logits, first + at, weights[:, b].T * x[:, None])
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return lambda: score


def linear_parts(model) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x buckets) and intercept of a fitted model: their size is set by parameters, not by the rows."""
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def transformed(model, rows: DataFrame, *keep: str) -> DataFrame:
    """keep, prediction and p of a fitted MLlib model."""
    return model.transform(rows).select(*keep, "prediction", vector_to_array("probability").alias("p"))
