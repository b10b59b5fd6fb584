"""Macro F1 of the weighted argmax over a whole grid of two classes' weights, from one pass over the rows.

With all other weights 1, a row's answer is its best other class until a weighted class passes it: below wa = ia and wb = ib of
the grid. Above, class a wins where wb / wa stays under the row's own ratio of the two. So a row falls into a cell of two small
histograms, of (ia, ib) and of (ia, rank of its ratio), and prefix sums over them give all counts at all grid points. What a row
costs does not depend on the number of points; what is summed depends on classes and grid only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(p: np.ndarray, label: np.ndarray, wa: np.ndarray, wb: np.ndarray, ratios: np.ndarray, a: int, b: int) -> np.ndarray:
    """Codes of the rows' cells: best other class, right or wrong for it, label is a, b or neither, ia, ib, rank."""
    rest = p.copy()
    rest[:, [a, b]] = -np.inf
    other = rest.argmax(axis=1)
    top = rest[np.arange(len(p)), other]
    lost = lambda w, c: (np.where((c < other)[:, None], w[None, :] * p[:, [c]] < top[:, None], w[None, :] * p[:, [c]] <= top[:, None])).sum(axis=1)
    ia, ib = lost(wa, a), lost(wb, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = p[:, b] / p[:, a]  # a is ahead where wa / wb is over it; on ties the smaller class
    ratio[np.isnan(ratio)] = 0.0 if a < b else np.inf
    rank = np.searchsorted(ratios, ratio, side="left" if a < b else "right")
    kind = np.where(label == a, 0, np.where(label == b, 1, 2))
    return np.ravel_multi_index((other, (label == other).astype(int), kind, ia, ib, rank), _shape(p.shape[1], wa, wb, ratios))


def _shape(n: int, wa: np.ndarray, wb: np.ndarray, ratios: np.ndarray) -> tuple[int, ...]:
    return n, 2, 3, len(wa) + 1, len(wb) + 1, len(ratios) + 1


def weight_counts(rows: DataFrame, label: str, p: str, n: int, a: int, b: int, wa: list[float], wb: list[float]) -> DataFrame:
    """(h, i, j, count): the two histograms' cells that are not empty. h tells histogram, class and hit apart; see f1_surface."""
    xa, xb = np.array(sorted(wa)), np.array(sorted(wb))
    ratios = np.unique(xa[:, None] / xb[None, :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros((n, 2, len(xa) + 1, len(xb) + 1), np.int64)  # by best other class: all and hits
        ahead = np.zeros((3, len(xa) + 1, len(ratios) + 1), np.int64)  # by label a, b, neither
        both = np.zeros((3, len(xa) + 1, len(xb) + 1), np.int64)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x = np.asarray(batch.column("p").flatten(), np.float64).reshape(-1, n)
            other, hit, kind, ia, ib, rank = np.unravel_index(_cells(x, np.asarray(batch.column("label").fill_null(-1), np.int64), xa, xb, ratios, a, b), _shape(n, xa, xb, ratios))
            np.add.at(low, (other, 0, ia, ib), 1)
            np.add.at(low, (other, 1, ia, ib), hit)
            np.add.at(ahead, (kind, ia, rank), 1)
            np.add.at(both, (kind, ia, ib), 1)
        if not seen:
            return
        # class a wins at (i, j) if ia <= i and its rank is small enough, whatever ib is; both holds (ia, ib) by label
        out = []
        for h, table in [*((2 * c + k, low[c, k]) for c in range(n) for k in (0, 1)), *((-1 - k, ahead[k]) for k in range(3)), *((-4 - k, both[k]) for k in range(3))]:
            i, j = np.nonzero(table)
            out.append((np.full(len(i), h), i, j, table[i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["h", "i", "j", "count"])

    sent = rows.select(F.col(label).cast("long").alias("label"), F.col(p).cast("array<double>").alias("p"))
    return sent.mapInArrow(run, "h long, i long, j long, count long").groupBy("h", "i", "j").agg(F.sum("count").alias("count"))


def f1_surface(rows: DataFrame, label: str, p: str, n: int, a: int, b: int, wa: list[float], wb: list[float]) -> list[tuple[float, float, float]]:
    """(wa, wb, macro F1) at every grid point, by wa, then wb. Labels are 0 to n - 1, weights positive, p has n numbers of at least 0; rows without p do not count, a null label is never right.

    Cells come to the driver: at most 2 n + 3 histograms of the grid's size and 3 of (weights of a) x (distinct ratios).
    """
    rows = rows.where(F.col(p).isNotNull())
    xa, xb = np.array(sorted(wa)), np.array(sorted(wb))
    ratios = np.unique(xa[:, None] / xb[None, :])
    low = np.zeros((n, 2, len(xa) + 1, len(xb) + 1))
    ahead, both = np.zeros((3, len(xa) + 1, len(ratios) + 1)), np.zeros((3, len(xa) + 1, len(xb) + 1))
    for r in weight_counts(rows, label, p, n, a, b, wa, wb).collect():
        if r.h >= 0:
            low[r.h // 2, r.h % 2, r.i, r.j] = r["count"]
        else:
            (ahead if r.h > -4 else both)[(-1 - r.h) % 3, r.i, r.j] = r["count"]
    total = rows.groupBy(F.col(label).cast("long").alias("c")).count().collect()
    real = np.zeros(n)
    for r in total:
        if r.c is not None and 0 <= r.c < n:
            real[r.c] = r["count"]
    every = sum(r["count"] for r in total)
    beyond = lambda t: t[..., ::-1, ::-1].cumsum(axis=-1).cumsum(axis=-2)[..., ::-1, ::-1]  # noqa: E731  rows with ia >= i and ib >= j
    inside = lambda t: t.cumsum(axis=-1).cumsum(axis=-2)
    low, both, ahead = beyond(low), beyond(both), inside(ahead)
    out = []
    for i, u in enumerate(xa):
        for j, v in enumerate(xb):
            rank = int(np.searchsorted(ratios, u / v))
            rest = low[:, :, i + 1, j + 1]  # neither weighted class passes the best other one
            got_a = ahead[:, i, rank]
            got_b = [real[a], real[b]] - got_a[:2] - both[:2, i + 1, j + 1]
            said, hits = rest[:, 0].copy(), rest[:, 1].copy()
            said[a], hits[a] = got_a.sum(), got_a[0]
            said[b], hits[b] = every - said.sum() + said[b], got_b[1]
            down = real + said
            out.append((float(u), float(v), float(np.mean(np.where(down > 0, 2 * hits / np.where(down > 0, down, 1), 0.0)))))
    return out
