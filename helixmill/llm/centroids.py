"""Exact k-means on integer vectors with geometrically tightened drift.

Every vector keeps a lower bound on its distance to all centroids but its own. When centroids move, the bound is loosened by
as much as a centroid can have come nearer to any point of the cluster's sphere, not by the whole way that it went. For a
centroid that goes from c to c' with midpoint q, a point x comes nearer by

    |x - c| - |x - c'| = 2 (x - q).(c' - c) / (|x - c| + |x - c'|) <= |c' - c| cos(x - q, c' - c),

as |x - c| + |x - c'| >= 2 |x - q|. In the plane through q, the way of the centroid and the middle of the sphere, the sphere
covers the angles phi +- alpha around its middle (sin alpha = radius / distance from q), so that the cosine is at most
cos(phi - alpha), and at most 0 if phi - alpha is over a right angle: a centroid that moves away loosens nothing.

A vector whose own centroid is nearer than its bound keeps it; the others are scanned over all centroids. Distances are
exact integers; bounds are kept a little too low, so that rounding never decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import ensure_checkpoint_dir, table

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Up to this size of components, squared distances are exact in doubles (64 * (2 * 2^20)^2 = 2^48), and a batch's sum of them in longs.
EXACT = 1 << 20
#: Relative margin of all bounds, far above the rounding of a square root and a sum of 64 products.
SLACK = 1e-9


def scaled(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: doubles where they and the sums of their squares are exact, else Python's integers."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if not len(v) or np.abs(v).max() <= EXACT:
        return v
    return np.array([int(a) * scale if a == int(a) else int(np.floor(a * scale)) for a in x.ravel().tolist()], object).reshape(-1, dims)


def as_numbers(centroids: list[list[int]]) -> np.ndarray:
    c = np.array(centroids, object)
    return c.astype(np.float64) if c.size and max(map(abs, c.ravel())) <= EXACT else c


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; at most 1e308, so that a vector so far away is never below its bound and is scanned."""
    if squares.dtype != object:
        return np.sqrt(squares)
    return np.array([math.sqrt(x) if x < 10**300 else float(min(math.isqrt(x), 10**308)) for x in map(int, squares.ravel().tolist())]).reshape(squares.shape)


def own_squares(v: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to their own centroids."""
    if v.dtype == object or c.dtype == object:
        v, c = v.astype(object), c.astype(object)
        v, c = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (v, c))
    d = v - c[own]
    return (d * d).sum(axis=1)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, exact squared distance, distance of the second less a margin) of the nearest centroid; ties: the smaller number."""
    if v.dtype == object or c.dtype == object:
        squares = np.stack([own_squares(v, c, np.full(len(v), j)) for j in range(len(c))], axis=1)
        order = np.array([min(range(len(r)), key=lambda j: (r[j], j)) for r in squares], np.int64)
    else:
        squares = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
        order = squares.argmin(axis=1)
    best = squares[np.arange(len(v)), order]
    others = squares.copy()
    others[np.arange(len(v)), order] = others.max() + 1 if others.size else 0
    second = others.min(axis=1) if len(c) > 1 else np.full(len(v), np.inf)
    return order, best, roots(second) * (1 - SLACK)


def loosening(old: list[list[int]], new: list[list[int]], radius: list[float]) -> np.ndarray:
    """By how much the bounds of each cluster's vectors sink at most when the centroids move from `old` to `new`.

    radius: distance of the cluster's farthest vector from its old centroid; of an empty cluster 0 (it has no bounds).
    """
    if max(abs(x) for m in (old, new) for c in m for x in c) > 10**100:  # squares would leave the doubles: all vectors are scanned
        return np.full(len(old), np.inf)
    a, b = np.array(old, np.float64), np.array(new, np.float64)
    way = b - a
    length = np.sqrt((way * way).sum(axis=1))
    out = np.zeros(len(a))
    for j in np.flatnonzero(length > 0):
        to = a - (a[j] + b[j]) / 2
        far = np.sqrt((to * to).sum(axis=1))
        r = np.asarray(radius) * (1 + SLACK)
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = np.arccos(np.clip((to @ way[j]) / (far * length[j]), -1, 1))
            alpha = np.arcsin(np.clip(r / far, 0, 1))
        angle = np.where((far <= r * (1 + SLACK)) | (far == 0), 0, np.maximum(phi - alpha - 1e-6, 0))  # inside the sphere every angle is possible
        nearer = length[j] * np.maximum(np.cos(angle), 0) * (1 + SLACK)
        nearer[j] = 0  # the own centroid has no lower bound
        out = np.maximum(out, nearer)
    return out


def assign(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], sink: np.ndarray | None, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Vectors (id, vector, cluster, square, low) with their new cluster, squared distance and bound; at the end of the partition a row a cluster.

    These last rows have no vector, but the cluster's farthest distance in low and in sums, as decimal numbers, the count, the
    sum of the squared distances and the components' sums. sink: what the last move takes from the bounds of each cluster;
    None: there are none yet. Squares of more than 38 digits are null in their row, not in the sums.
    """
    c = as_numbers(centroids)
    k = len(c)
    between = roots(np.stack([own_squares(c, c, np.full(k, j)) for j in range(k)]))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1, initial=np.inf) / 2 * (1 - SLACK)
    sums, far, kind = [[0] * (dims + 2) for _ in range(k)], np.zeros(k), None
    names = ["id", "vector", "cluster", "square", "low", "sums"]
    for batch in batches:
        kind, n = batch.schema.field("vector").type, batch.num_rows
        if not n:
            continue
        v = scaled(batch.column("vector"), dims, scale)
        number = object if object in (v.dtype, c.dtype) else np.float64
        if sink is None:
            cluster, low, square, todo = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, number), np.ones(n, bool)
        else:
            cluster = np.array(batch.column("cluster"), np.int64)
            low = np.asarray(batch.column("low")) - sink[cluster]
            low = low - np.abs(low) * SLACK
            square = own_squares(v, c, cluster)
            todo = ~(roots(square) * (1 + SLACK) < np.maximum(low, half[cluster]))
        if todo.any():
            cluster[todo], square[todo], low[todo] = nearest(v[todo], c)
        np.maximum.at(far, cluster, roots(square))
        for j in np.unique(cluster):
            on = cluster == j
            part = [on.sum(), (square[on] if number is object else square[on].astype(np.int64)).sum(), *v[on].sum(axis=0).tolist()]
            sums[j] = [x + int(y) for x, y in zip(sums[j], part)]
        exact = pa.array([int(x) if x < 10**38 else None for x in square.tolist()], pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cluster.astype(np.int32)), exact, pa.array(low), pa.nulls(n, pa.list_(pa.string()))], names)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, kind), pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.decimal128(38)), pa.array(far), pa.array([[str(x) for x in r] for r in sums], pa.list_(pa.string()))], names)


def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's rows (cluster, low, sums) as one a cluster: the largest low, the exact sums."""
    low: dict[int, float] = {}
    sums: dict[int, list[int]] = {}
    for b in batches:
        for j, x, s in zip(b.column("cluster").to_pylist(), b.column("low").to_pylist(), b.column("sums").to_pylist()):
            low[j] = max(low.get(j, 0.0), x)
            sums[j] = [p + int(q) for p, q in zip(sums.get(j) or [0] * len(s), s)]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([low[j] for j in sums], pa.float64()), pa.array([[str(x) for x in s] for s in sums.values()], pa.list_(pa.string()))], ["cluster", "low", "sums"])


def totals(frame: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[float]]:
    """The sums (count, squares, components) and farthest distances of the k clusters; partitions' rows are added in two steps."""
    schema = "cluster int, low double, sums array<string>"
    rows = frame.where(F.col("sums").isNotNull()).select("cluster", "low", "sums").withColumn("share", F.spark_partition_id() % 64)
    some = rows.repartition("cluster", "share").select("cluster", "low", "sums").mapInArrow(add_rows, schema)
    got = {r.cluster: r for r in some.repartition("cluster").mapInArrow(add_rows, schema).collect()}
    return [[int(x) for x in got[j].sums] if j in got else [0] * (dims + 2) for j in range(k)], [got[j].low if j in got else 0.0 for j in range(k)]


def finite_vectors(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, vector) of the rows whose vector has `dims` components, none of them null, NaN or infinite."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).where(plain).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(id, vector, cluster, square) of every usable vector, the k final centroids, and the squares' sum in each cluster.

    Vectors have `dims` components, none null or non-finite, taken as floor(scale * x); others are left out. The first centroids
    are the k vectors with the smallest sha256 of `seed:id`, in that order (rows of one id by their vectors; null ids last).
    Each round assigns all vectors to the nearest centroid (squared distance; ties: the smaller number) and moves every centroid
    that has vectors to the floor of their mean, exactly. With fewer than k vectors there are fewer centroids, with none an empty
    result. Repeated rows count as often as they come. Other columns are dropped.

    A round is one pass over the vectors, which are not shuffled: a partition sends a row a cluster, and k rows of sums come to
    the driver whatever the input. What a round has found is checkpointed, so that a lost executor costs a round at most.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    own = finite_vectors(vectors, key, vector, dims)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = own.select(named.alias("h"), F.col("vector")).orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    kind = own.schema["vector"].dataType
    at = [[int(x) for x in r] for r in scaled(pa.array([list(r.vector) for r in first], pa.list_(pa.float64())), dims, scale).tolist()] if first else []
    schema = f"id long, vector {kind.simpleString()}, cluster int, square decimal(38,0), low double, sums array<string>"
    if not at:
        return own.select("id", "vector", F.lit(0).alias("cluster"), F.lit(0).cast("decimal(38,0)").alias("square")), [], []
    frame, sink = own, None
    for i in range(rounds + 1):
        frame = frame.mapInArrow(lambda b, c=at, s=sink: assign(b, c, s, dims, scale), schema).checkpoint()
        sums, far = totals(frame, len(at), dims)
        if i < rounds:
            moved = [[x // s[0] for x in s[2:]] if s[0] else c for s, c in zip(sums, at)]
            sink, at = loosening(at, moved, far), moved
        frame = frame.where(F.col("sums").isNull()).drop("sums")
    return frame.select("id", "vector", "cluster", "square"), at, [s[1] for s in sums]


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a kept vector; numbers that do not fit a long are null."""
    found, at, inertia = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    fits = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of = lambda values: F.get(F.array(*values, F.lit(None)), F.col("cluster"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", F.col("square").try_cast("long").alias("distance"), of([fits(x) for x in inertia]).cast("long").alias("cluster_inertia"),
        fits(sum(inertia)).alias("inertia"), of([F.lit(x) for x in names]).cast("string").alias("centroid_sha256"),
    )
