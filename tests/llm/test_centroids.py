"""Centroid clustering against a plain version of its contract in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from helixmill.llm import centroids as ct


def plain(rows, dims=64, k=40, rounds=5, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    at = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [near(v) for _, v in kept]
    inertia = [sum(d for d, j in found if j == i) for i in range(len(at))]
    fits = lambda x: x if x < 2**63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(sum(inertia)), names[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def written(spark, rows, path, kind="float"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster int, id string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in ct.op11_centroids(spark, str(path)).collect()), key=str)


def test_planted_rows(spark, tmp_path):
    """Nulls, NaN, infinity, wrong lengths, repeated rows and ids, ties, clashing columns."""
    rng = random.Random(3)
    as_float = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, as_float(rng.gauss(0, 0.3) + (i % 7) for _ in range(64))) for i in range(300)]
    rows += [(i % 50, [float(i % 3)] * 64) for i in range(200)] + [(None, [0.5] * 64)] * 3
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [math.nan] + [1.0] * 63), (7, [-math.inf] + [1.0] * 63)]
    got = written(spark, [(*r, 1, "x") for r in rows + bad], tmp_path)
    assert got == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    rows = [(i, [float(i), *[0.25] * 63]) for i in range(n)]
    assert written(spark, [(*r, 1, "x") for r in rows], tmp_path) == plain(rows)


def test_huge_components(spark, tmp_path):
    """Beyond what doubles hold exactly, up to squares that no long holds."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([1.0, 1e4, 3e8, 1e15 if i % 5 == 0 else 2.0, 1e300 if i == 9 else 1.0]) * rng.choice([-1, 1]) * (1 + rng.random()) for _ in range(64)]) for i in range(60)]
    assert written(spark, [(*r, 1, "x") for r in rows], tmp_path, "double") == plain(rows)


def test_on_the_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in ct.op11_centroids(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(rows)


def test_loosening_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(200):
        d, k = int(rng.integers(1, 6)), int(rng.integers(2, 6))
        old = rng.integers(-50, 50, (k, d)).tolist()
        new = (np.array(old) + rng.integers(-20, 20, (k, d))).tolist()
        radius = rng.random(k) * rng.choice([1, 20, 80])
        sink = ct.loosening(old, new, radius.tolist())
        for i in range(k):
            x = rng.normal(size=(400, d))
            x = np.array(old[i]) + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.random((400, 1)) ** (1 / d)
            for j in set(range(k)) - {i}:
                assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= sink[i] + 1e-9
            drift = max(np.linalg.norm(np.array(new[j]) - old[j]) for j in range(k) if j != i)
            assert sink[i] <= drift * (1 + 1e-8)
            less += sink[i] < 0.9 * drift
    assert less > 200


def test_most_vectors_are_not_scanned(monkeypatch):
    """Four far groups that drift a little: after the first assignment few vectors are looked at again."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4_000, 64)) * 0.05 + np.repeat(np.eye(4, 64) * 4, 1_000, axis=0)
    scanned, whole = [], ct.nearest
    monkeypatch.setattr(ct, "nearest", lambda v, c: (scanned.append(len(v)), whole(v, c))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000)), pa.array(x.tolist())], ["id", "vector"])
    old = np.floor(x[::1_000] * 256).astype(int).tolist()
    *first, sums = ct.assign(iter([batch]), old, None, 64, 256)
    new = [[int(a) // int(s[0]) for a in s[2:]] for s in sums.column("sums").to_pylist()]
    list(ct.assign(iter(first), new, ct.loosening(old, new, sums.column("low").to_pylist()), 64, 256))
    assert scanned[0] == 4_000 and sum(scanned[1:]) < 40
