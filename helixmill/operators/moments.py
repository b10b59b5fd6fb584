"""Bootstraps in one pass: each task keeps running sums of all replicates, so rows are neither copied nor shuffled per replicate.

A row's weights in B replicates are a vector, drawn from keyed uniform numbers; a batch adds weights^T x terms to the sums of its
group. What leaves a task is B rows of sums a group, whatever the number of rows, and these are added up by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cumulative Poisson(1) probabilities, up to where doubles no longer tell them from 1.
POISSON_ONE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: Draws that are held at once.
HELD = 1 << 20
#: Sums that a task holds before it sends them on.
SUMS = 1 << 23


def keyed_uniforms(keys: list[str | None], suffixes: list[bytes]) -> np.ndarray:
    """keyed_uniform(key, *suffix) for all keys (rows) and suffixes (columns), as the SQL functions give it."""
    try:
        from _md5 import md5  # the same function with less ado
    except ImportError:
        from hashlib import md5
    out = np.empty((len(keys), len(suffixes)))
    for i, k in enumerate(keys):
        head = b"" if k is None else k.encode() + b"|"
        out[i] = (np.frombuffer(b"".join([md5(head + s).digest() for s in suffixes]), ">u8")[::2] >> np.uint64(12)) / 2.0**52
    return out


def poisson_one(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(POISSON_ONE, u, side="right").astype(np.float64)


def poisson_counts(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The numbers of functions.stats.poisson_count: by cumulative probabilities up to a mean of 30, by the normal distribution beyond."""
    mean = np.broadcast_to(mean, u.shape)
    low = mean <= 30
    m, x = mean[low], u[low]
    p = np.exp(-m)
    c, k = p.copy(), np.zeros(len(m))
    for i in range(1, 91):
        on = c <= x
        if not on.any():
            break
        k[on] = i
        p = np.where(on, p * m / i, p)
        c = np.where(on, c + p, c)
    out = np.empty(u.shape)
    out[low] = k
    m = mean[~low]
    out[~low] = np.maximum(0.0, np.rint(m + np.sqrt(m) * np.sqrt(-2 * np.log(1 - u[~low])) * np.cos(2 * np.pi * v[~low])))
    return out


def replicate_sums(rows: DataFrame, key: str, terms: dict[str, Column], n: int, seed: str, by: list[str] = [], draw: Callable | None = None, made: Callable | None = None, names: list[str] | None = None) -> DataFrame:
    """(by..., replicate, w, terms...): the weights' sum and the weighted sums of the terms in each of n replicates.

    A row's weight is Poisson(1) by its key, the replicate and the seed. `draw`, if given, gets uniform numbers u and v (rows x n)
    and the rows' terms, and gives the weights. `made`, if given, turns weights and terms into an array rows x n x names that is
    summed as it is, in place of weight x term. Null terms count as 0, groups of null keys as others do.
    """
    names = names or list(terms)
    t = len(terms)
    frame = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), *by, *(c.cast("double").alias(f"_t{i}") for i, c in enumerate(terms.values())))
    types = [frame.schema[b] for b in by]
    schema = T.StructType([*types, T.StructField("replicate", T.IntegerType()), *(T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(names) + 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [f"{b}|{seed}".encode() for b in range(n)]
        other = [f"{b}|{seed}|n".encode() for b in range(n)] if draw else []
        groups: dict[tuple, np.ndarray] = {}
        kinds = [pa.null()] * len(by)

        def flush() -> Iterator[pa.RecordBatch]:
            for g, s in groups.items():
                own = [pa.array([x] * n, k) for x, k in zip(g, kinds)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(n, dtype=np.int32)), *(pa.array(np.ascontiguousarray(s[:, i])) for i in range(s.shape[1]))], [*by, "replicate", *(f"_s{i}" for i in range(s.shape[1]))])
            groups.clear()

        step = max(1, HELD // n)
        for batch in batches:
            kinds = [batch.schema.field(b).type for b in by]
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                keys = part.column("_key").to_pylist()
                x = np.column_stack([np.nan_to_num(np.asarray(part.column(f"_t{i}").fill_null(0.0))) for i in range(t)]) if t else np.zeros((len(keys), 0))
                u = keyed_uniforms(keys, plain)
                w = draw(u, keyed_uniforms(keys, other), x) if draw else poisson_one(u)
                own = list(zip(*(part.column(b).to_pylist() for b in by))) if by else [()] * len(keys)
                code: dict[tuple, int] = {}
                at = np.array([code.setdefault(g, len(code)) for g in own])
                for g, i in code.items():
                    on = at == i
                    s = groups.setdefault(g, np.zeros((n, len(names) + 1)))
                    s[:, 0] += w[on].sum(axis=0)
                    s[:, 1:] += made(w[on], x[on]).sum(axis=0) if made else w[on].T @ x[on]
                if len(groups) * n * (len(names) + 1) > SUMS:
                    yield from flush()
        yield from flush()

    sums = frame.mapInArrow(run, schema).groupBy(*by, "replicate").agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(names) + 1)))
    return sums.select(*by, "replicate", F.col("_s0").alias("w"), *(F.col(f"_s{i + 1}").alias(m) for i, m in enumerate(names)))
