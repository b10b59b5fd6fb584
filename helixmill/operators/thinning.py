"""Samples of counted reads without a row a read: exact hypergeometric counts by a splitting tree.

A sample of `target` of N reads takes from any part of n reads a hypergeometric number. So the target is split between the two
halves of all ranges of keys, each half's share between its halves, and so on down to 4,096 ranges; inside a range the keys take
their numbers one after another, each from what is left. Together that is the multivariate hypergeometric distribution, and the
numbers sum to the target exactly. Every node and key draws one keyed number, so a count of 10^10 costs no more rows than one of 10.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12
CHUNK = 1 << 20


def uniform(*key: str) -> float:
    """functions.seq.keyed_uniform of plain strings."""
    return int(hashlib.md5("|".join(key).encode()).hexdigest()[:13], 16) / 16**13


def _steps(n: int, k: int, t: int, start: int, step: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Probabilities relative to that of the mode `start`, away from it in chunks (first number, values), for at most `most` numbers."""
    last, j, done = 0.0, start, 0
    while done < most:
        i = np.arange(min(CHUNK, most - done), dtype=np.float64)
        x = j + step * i
        if step > 0:
            ratio = np.log(k - x) + np.log(t - x) - np.log(x + 1) - np.log(n - k - t + x + 1)
        else:
            ratio = np.log(x) + np.log(n - k - t + x) - np.log(k - x + 1) - np.log(t - x + 1)
        logs = last + np.cumsum(ratio)
        yield j + step, np.exp(logs)
        last, j, done = float(logs[-1]), j + step * len(i), done + len(i)


def hypergeometric(n: int, k: int, t: int, u: float) -> int:
    """How many of t drawn of n are among k, where the distribution function passes u.

    Sums run from the mode to nine standard deviations on both sides (beyond lie 1e-18) in chunks: memory is bounded, time grows
    with the standard deviation.
    """
    lo, hi = max(0, k + t - n), min(k, t)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (k + 1) * (t + 1) // (n + 2)))
    reach = int(9 * math.sqrt(t * (k / n) * (1 - k / n) * (n - t) / max(n - 1, 1))) + 60
    down, up = min(reach, mode - lo), min(reach, hi - mode)
    below = sum(float(p.sum()) for _, p in _steps(n, k, t, mode, -1, down))
    above = sum(float(p.sum()) for _, p in _steps(n, k, t, mode, 1, up))
    want = u * (below + 1 + above)
    if want < below:  # below the mode: take from it what is not wanted
        left = below - want
        for first, p in _steps(n, k, t, mode, -1, down):
            c = np.cumsum(p)
            if c[-1] >= left:
                return first - int(np.searchsorted(c, left, side="left"))
            left -= float(c[-1])
        return mode - down
    want -= below + 1
    if want < 0:
        return mode
    for first, p in _steps(n, k, t, mode, 1, up):
        c = np.cumsum(p)
        if c[-1] > want:
            return first + int(np.searchsorted(c, want, side="right"))
        want -= float(c[-1])
    return mode + up


def split_target(totals: dict[int, int], target: int, seed: str, bits: int = BITS) -> dict[int, int]:
    """The target dealt to the 2^bits ranges with these totals, by halves."""
    levels = [totals]
    for _ in range(bits):
        up: dict[int, int] = {}
        for r, n in levels[-1].items():
            up[r >> 1] = up.get(r >> 1, 0) + n
        levels.append(up)
    shares = {0: min(target, levels[-1].get(0, 0))}
    for depth in range(bits):
        below = levels[bits - depth - 1]
        out: dict[int, int] = {}
        for r, t in shares.items():
            n, k = below.get(2 * r, 0) + below.get(2 * r + 1, 0), below.get(2 * r, 0)
            x = hypergeometric(n, k, t, uniform(str(depth), str(r), seed)) if n else 0
            out |= {2 * r: x, 2 * r + 1: t - x}
        shares = {r: t for r, t in out.items() if t}
    return shares


def thinned(counts: DataFrame, key: str, count: str, target: int, seed: str = "0") -> DataFrame:
    """`counts` with the counts of a sample of `target` of all counted reads, without replacement; all of them if there are fewer.

    Keys are distinct (rows of one key draw alike); a null or negative count is 0. Ranges are the first 12 bits of the key's md5.
    The totals of the ranges, at most 4,096 numbers, are split on the driver; a range's rows are then read in order of their key by
    one task, which holds two numbers for it. Exact for totals below 2^53.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = counts.select(F.struct(*(counts[c] for c in counts.columns)).alias("row"), own.alias("key"), F.greatest(F.coalesce(F.col(count), F.lit(0)).cast("long"), F.lit(0)).alias("n"))
    rows = rows.withColumn("range", F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 3), 16, 10).cast("int"))
    totals = {r["range"]: r.n for r in rows.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    shares = split_target(totals, target, seed)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, wanted = None, 0, 0
        for batch in batches:
            got = []
            for r, k, m in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "n"))):
                if r != at:
                    at, left, wanted = r, totals[r], shares.get(r, 0)
                x = hypergeometric(left, m, wanted, uniform(k, seed)) if wanted else 0
                left, wanted = left - m, wanted - x
                got.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.int64())], ["row", "taken"])

    dealt = rows.repartition(n, "range").sortWithinPartitions("range", "key")
    found = dealt.mapInArrow(take, f"row {rows.schema['row'].dataType.simpleString()}, taken long")
    return found.select(*(F.col("taken").alias(c) if c == count else F.col(f"row.`{c}`").alias(c) for c in counts.columns))
