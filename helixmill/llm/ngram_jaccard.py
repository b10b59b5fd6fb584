"""Exact n-gram Jaccard join by T-occurrence search.

Documents with the same set of shingles are one set. Two sets that are as alike as asked share at least T of their
shingles, so each must have one of the other's in its prefix: all but T - 1 of its shingles, the rarest first. How rare a
shingle is, a sketch of fixed size estimates from all documents; any order that all follow gives the same result. The
prefixes are inverted; sets that meet in a short list are pairs, in a long list each is paired with the list's smallest
one first, and only members that are then still in different components are paired with each other.

A set's candidates are searched together, through an inverted index of their whole sets: for each shingle of the query there
is the list of candidates that have it. The longest lists are put aside, the short ones merged by a heap, and candidates that
come often enough to reach T are looked up in the long ones by bisection (DivideSkip). Only this search counts common shingles.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import ensure_checkpoint_dir, free_name, int64s, lean, table, text_bytes, text_slices, with_row_ids

WORDS = 5
PERCENT = 75
SKETCH = 1 << 20
CHUNK = 1 << 14
#: Lists up to this long are paired at once.
SHORT = 8
#: Candidates of one set that are settled together.
BLOCK = 256
U = np.uint64
_rng = np.random.default_rng(20_240_310)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).view(U)
ODD = _rng.integers(1, 1 << 63, 32, dtype=np.int64).view(U) | U(1)
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of the distinct shingles of each text, by document and hash. Fewer words than asked are one shingle."""
    none = np.empty(0, U), np.empty(0, np.int64)
    if not len(data):
        return none
    gap = SPACE[data]
    starts = ~gap
    starts[1:] &= gap[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cut] = ~gap[cut]
    first = np.flatnonzero(starts)
    if not len(first):
        return none
    ends = ~gap
    ends[:-1] &= gap[1:]
    ends[cut - 1] = ~gap[cut - 1]
    last = np.flatnonzero(ends) + 1
    power = np.full(len(data), BASE, U)
    power[0] = U(1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[LOWER[data]] * np.multiply.accumulate(power), out=sums[1:])
    back = np.full(len(data), UNBASE, U)
    back[0] = U(1)
    word = mix((sums[last] - sums[first]) * np.multiply.accumulate(back)[first] + (last - first).astype(U) * ODD[31])
    doc = np.searchsorted(offsets, first, side="right") - 1
    n = np.bincount(doc, minlength=len(offsets) - 1)
    size = np.minimum(n, words)[doc]
    place = np.arange(len(first)) - (np.cumsum(n) - n)[doc]
    own = np.flatnonzero(place + size <= n[doc])
    total = size[own].astype(U) * ODD[30]
    for j in range(words):
        on = j < size[own]
        total[on] += word[own[on] + j] * ODD[j]
    h, d = mix(total), doc[own]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def set_names(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(name of the set, its size) for each of n documents; equal sets have equal names, the empty set 0."""
    size = np.bincount(d, minlength=n)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(h * ODD[20])))) if len(h) else np.zeros(1, U)
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    name = mix(sums[at[1:]] - sums[at[:-1]] + size.astype(U) * ODD[21])
    return np.where(size > 0, name, U(0)).view(np.int64), size


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n shares at least with any set as alike as asked."""
    return -(-percent * n // 100)


def divide_skip(lists: list[list[int]], least: int, weight: float = 0.01) -> dict[int, int]:
    """How often each number that is in at least `least` of the ascending lists is in them."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return {}
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (weight * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need = least - aside
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    out = {}
    while heap:
        top, count = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, i, j = heap[0]
            count += 1
            if j + 1 < len(short[i]):
                heapq.heapreplace(heap, (short[i][j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
        if count < need:
            continue
        for left, x in zip(range(aside, 0, -1), long):
            if count + left < least:
                break
            j = bisect_left(x, top)
            count += j < len(x) and x[j] == top
        if count >= least:
            out[top] = count
    return out


def summaries(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row per document (key, own, set, size), and at the end the partition's counts of shingles by sketch cell."""
    counts = np.zeros(SKETCH, np.int64)
    names = ["key", "own", "set", "size", "cells"]
    for batch in batches:
        for part in text_slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            h, d = shingles(data, offsets, words)
            counts += np.bincount((h >> U(44)).astype(np.int64), minlength=SKETCH)
            name, size = set_names(h, d, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("own"), pa.array(name), pa.array(size), pa.nulls(part.num_rows, pa.binary())], names)
    if counts.any():
        data = [counts[i : i + CHUNK].astype("<i8").tobytes() for i in range(0, SKETCH, CHUNK)]
        n = len(data)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.arange(n)), pa.array(np.full(n, -1)), pa.array(data, pa.binary())], names)


def add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column("set").to_pylist(), b.column("cells").to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(x, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["set", "cells"])


def prefixes(batches: Iterator[pa.RecordBatch], cells: np.ndarray, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(shingle, set, size) of each set's prefix; a set that comes again in a batch is sent once. In all lists the size's low 32 bits hold the shingle's place in the set's order."""
    for batch in batches:
        seen = np.empty(0, np.int64)
        for part in text_slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            h, d = shingles(data, offsets, words)
            name, size = set_names(h, d, part.num_rows)
            fresh = np.zeros(part.num_rows, bool)
            fresh[np.unique(name, return_index=True)[1]] = True
            fresh &= ~np.isin(name, seen) & (size > 0)
            seen = np.concatenate((seen, name[fresh]))
            on = fresh[d]
            h, d = h[on], d[on]
            order = np.lexsort((h, cells[(h >> U(44)).astype(np.int64)], d))
            h, d = h[order], d[order]
            n = np.bincount(d, minlength=part.num_rows)
            place = np.arange(len(d)) - (np.cumsum(n) - n)[d]
            sent = place <= (n - least_overlap(n, percent))[d]
            yield pa.RecordBatch.from_arrays([pa.array(h[sent].view(np.int64)), pa.array(name[d[sent]]), pa.array(size[d[sent]] << 32 | place[sent])], ["shingle", "set", "size"])


def _lists(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray] | None:
    """All rows by shingle and set, once each, of lists of two sets or more; and the length of each row's list."""
    got = [[np.asarray(b.column(c)) for c in columns] for b in batches if b.num_rows]
    if not got:
        return None
    cols = [np.concatenate(x) for x in zip(*got)]
    order = np.lexsort((cols[1], cols[0]))
    cols = [x[order] for x in cols]
    new = np.ones(len(order), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    cols = [x[new] for x in cols]
    head = np.ones(len(cols[0]), bool)
    head[1:] = cols[0][1:] != cols[0][:-1]
    g = np.cumsum(head) - 1
    n = np.bincount(g)[g] if len(g) else g
    return [x[n > 1] for x in cols], n[n > 1]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller name first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def possible(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that meet in a list can link, if it is their first common shingle: what stands before it in either is not shared.

    A pair that links passes in the list of its first common shingle, so it is enough to keep those that pass somewhere.
    """
    n, m = x >> 32, y >> 32
    most = np.minimum(n - (x & 0xFFFFFFFF), m - (y & 0xFFFFFFFF))
    return 100 * most >= percent * (n + m - most)


def first_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of short lists, and of each member of a long one with that which has the least before the shingle (kind 0); the rows of long lists (kind 1)."""
    got = _lists(batches, ("shingle", "set", "size"))
    if got is None:
        return
    (token, name, size), n = got
    a, b = [], []
    for k in range(1, SHORT):
        i = np.flatnonzero((token[k:] == token[:-k]) & (n[k:] <= SHORT)) if len(token) > k else np.empty(0, np.int64)
        i = i[possible(size[i], size[i + k], percent)]
        a.append(name[i])
        b.append(name[i + k])
    long = n > SHORT
    t, m, s = token[long], name[long], size[long]
    order = np.lexsort((m, ((s & 0xFFFFFFFF) << 20) // (s >> 32), t))
    t, m, s = t[order], m[order], s[order]
    head = np.ones(len(t), bool)
    head[1:] = t[1:] != t[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
    i = np.flatnonzero(~head & possible(s, s[first], percent)) if len(t) else np.empty(0, np.int64)
    x, y = _pairs(np.concatenate([*a, m[first[i]]]), np.concatenate([*b, m[i]]))
    kind = np.concatenate((np.zeros(len(x), np.int8), np.ones(len(t), np.int8)))
    join = lambda p, q: pa.array(np.concatenate((p, q)))
    yield pa.RecordBatch.from_arrays([pa.array(kind), join(x, t), join(y, m), join(np.zeros(len(x), np.int64), s)], ["kind", "a", "b", "size"])


def cross_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of long lists, pairs of members that can link and are not in one component."""
    got = _lists(batches, ("shingle", "set", "size", "comp"))
    if got is None:
        return
    (token, name, size, comp), _ = got
    a, b, held = [], [], 0

    def out() -> pa.RecordBatch:
        x, y = _pairs(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    edges = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
    for lo, hi in zip(edges, np.append(edges[1:], len(token))):
        if (comp[lo:hi] == comp[lo]).all():
            continue
        every = lo + np.argsort(size[lo:hi] >> 32, kind="stable")
        n = size[every] >> 32
        for i in range(len(every) - 1):
            stop = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
            other = every[i + 1 : stop]
            other = other[(comp[other] != comp[every[i]]) & possible(size[other], size[every[i]], percent)]
            if len(other):
                a.append(np.full(len(other), name[every[i]]))
                b.append(name[other])
                held += len(other)
            if held > 2_000_000:
                yield out()
                a, b, held = [], [], 0
    if a:
        yield out()


def settle(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows by (set, salt), first the set's own text (other is null), then its candidates' texts; the pairs that link."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    own, at, block, names = None, None, [], []
    out: list[tuple[int, int]] = []

    def tokens(data: bytes) -> np.ndarray:
        raw = np.frombuffer(unpack(data), np.uint8)
        return shingles(raw, np.array([0, len(raw)]), words)[0]

    def close() -> None:
        """Searches the block's inverted index: of the query's shingles, the lists of candidates that hold them."""
        nonlocal block, names
        if block:
            held = [tokens(x) for x in block]
            every = np.concatenate(held)
            member = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(every, kind="stable")  # by shingle, then by candidate
            every, member = every[order], member[order].tolist()
            starts, stops = np.searchsorted(every, own, "left").tolist(), np.searchsorted(every, own, "right").tolist()
            lists = [member[i:j] for i, j in zip(starts, stops) if i < j]
            for i, n in divide_skip(lists, max(1, int(least_overlap(len(own), percent)))).items():
                if 100 * n >= percent * (len(own) + len(held[i]) - n):
                    out.append((at, names[i]))
        block, names = [], []

    def rows() -> pa.RecordBatch:
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, other, data in zip(batch.column("a").to_pylist(), batch.column("other").to_pylist(), batch.column("packed").to_pylist()):
            if other is None:
                close()
                own, at = tokens(data), a
            else:
                block.append(data)
                names.append(other)
                if len(block) == BLOCK:
                    close()
        if len(out) > 100_000:
            yield rows()
            out.clear()
    close()
    yield rows()


def bitmap_of(ids: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bitmap of 2^bits hashed values, or-ed together in tasks. Its size doesn't depend on the table's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            x = (mix(np.asarray(b.column("x")).view(U)) >> U(64 - bits)).astype(np.int64)
            for i in np.unique(x >> 17):
                parts.setdefault(int(i), np.zeros(1 << 17, bool))[x[x >> 17 == i] & ((1 << 17) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(v).tobytes() for v in parts.values()], pa.binary())], ["part", "bits"])

    dealt = ids.select(F.col(column).alias("x")).mapInArrow(lean(run), "part long, bits binary").repartition(16, "part")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("part").to_pylist(), b.column("bits").to_pylist()):
                v = np.frombuffer(v, np.uint8)
                parts[i] = parts[i] | v if i in parts else v
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in dealt.mapInArrow(lean(unite), "part long, bits binary").collect():
        out[r.part << 14 : (r.part + 1) << 14] = np.frombuffer(r.bits, np.uint8)
    return out


def packed_texts(sets: DataFrame, reps: DataFrame, frame: DataFrame) -> DataFrame:
    """(set, packed): a compressed text of each of the distinct `sets`; reps (set, key) names the row of `frame` (key, text) that stands for it."""
    import zstandard

    asked = sets.join(reps, "set").checkpoint()
    bits = frame.sparkSession.sparkContext.broadcast(bitmap_of(asked, "key"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            x = (mix(int64s(b.column("key")).view(U)) >> U(40)).astype(np.int64)
            b = b.filter(pa.array((bits.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool)))
            for part in text_slices(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([squeeze((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], ["key", "packed"])

    return frame.mapInArrow(lean(packed), "key long, packed binary").join(asked, "key").groupBy("set").agg(F.min("packed").alias("packed"))


def verified(pairs: DataFrame, reps: DataFrame, frame: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link; each text travels to its pairs, a set with many candidates in several shares."""
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = packed_texts(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), reps, frame)
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(degree, "a").select("a", "b", F.when(F.col("n") <= 2 * BLOCK, 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK))).alias("salt"))
    firsts = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("set")).select("a", "salt", F.lit(None).cast("long").alias("other"), "packed")
    others = salted.join(texts, F.col("b") == F.col("set")).select("a", "salt", F.col("b").alias("other"), "packed")
    dealt = firsts.unionByName(others).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("other").asc_nulls_first())
    return dealt.select("a", "other", "packed").mapInArrow(lean(lambda b: settle(b, words, percent)), "a long, b long").checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(set, comp): the smallest name that each linked set reaches. Labels move to neighbours and along themselves."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("set")).agg(F.min("b").alias("m")).select("set", F.least("set", "m").alias("comp")).checkpoint()
    while True:  # each round shortens the longest way to the smallest name
        near = both.join(labels, F.col("b") == F.col("set")).groupBy("a").agg(F.min("comp").alias("m"))
        new = labels.join(near, F.col("set") == F.col("a")).select("set", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        far = labels.select(F.col("set").alias("at"), F.col("comp").alias("further"))
        new = new.join(far, F.col("comp") == F.col("at")).select("set", "old", F.least("comp", "further").alias("comp")).checkpoint()
        moved = new.where("old <> comp").limit(1).count()
        labels = new.select("set", "comp")
        if not moved:
            return labels


def with_components(rows: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """(key, n_shingles, component_id) of rows (key, own, set, size) by their sets' components."""
    labelled = rows.join(comps, "set", "left").select("key", "own", "size", F.when(F.col("size") > 0, F.coalesce("comp", "set")).alias("comp"))
    smallest = labelled.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(F.coalesce("own", F.lit(-(2**63)))).alias("component_id"))
    out = labelled.join(smallest, "comp", "left")
    return out.select(F.col("own").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "own", F.lit(-(2**63))).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of `docs`: key, n_shingles, component_id (the smallest key reachable by links, its own included).

    Texts are lower-cased in A-Z and divided at ASCII white space; a set is the distinct runs of `words` words, or all words
    if they are fewer; null, empty and blank texts have an empty set and no link. Rows link if 100 * common shingles are at
    least percent * all shingles of the two. Rows with equal texts that have a word link. Rows that share a key but not the text are documents
    of their own, so they may be in different components. A null key counts as the smallest number, -2^63, in component_id. Other columns are dropped; an empty table gives an empty result. Sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = with_row_ids(docs.select(F.col(key).cast("long").alias("own"), F.col(text).alias("text")), "own")
    frame = named.select(F.col("_id").alias("key"), "own", "text")
    whole = frame.mapInArrow(lean(lambda b: summaries(b, words)), "key long, own long, set long, size long, cells binary").checkpoint()
    frame = frame.select("key", "text")
    cells = np.zeros(SKETCH, np.int64)
    for r in whole.where("size = -1").select("set", "cells").repartition(16, "set").mapInArrow(lean(add_cells), "set long, cells binary").collect():
        cells[r.set * CHUNK : (r.set + 1) * CHUNK] = np.frombuffer(r.cells, "<i8")
    held = spark.sparkContext.broadcast(cells)
    rows = whole.where("size >= 0").select("key", "own", "set", "size")
    reps = rows.where("size > 0").groupBy("set").agg(F.min("key").alias("key"))
    sent = frame.mapInArrow(lean(lambda b: prefixes(b, held.value, words, percent)), "shingle long, set long, size long")
    met = sent.repartition(n, "shingle").mapInArrow(lean(lambda b: first_pairs(b, percent)), "kind byte, a long, b long, size long").checkpoint()

    links = verified(met.where("kind = 0").select("a", "b").distinct().checkpoint(), reps, frame, words, percent)
    comps = components(links)
    long = met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("set"), "size")
    if not long.isEmpty():
        labelled = long.join(comps, "set", "left").select("shingle", "set", "size", F.coalesce("comp", "set").alias("comp"))
        open_ = labelled.repartition(n, "shingle").mapInArrow(lean(lambda b: cross_pairs(b, percent)), "a long, b long").distinct().checkpoint()
        if not open_.isEmpty():
            links = links.unionByName(verified(open_, reps, frame, words, percent))
            comps = components(links)
    return with_components(rows, comps, key)


def keep_one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that come first in their component, by key and then by the text's hash; rows that repeat key and text are one row.

    Texts without a word have no component, so each of them stays (rows that repeat key and text are still one). Columns stay whatever their names; an empty table stays empty.
    """
    id_ = free_name(docs.columns, "_id")
    named = with_row_ids(docs, key, name=id_)
    found = jaccard_components(named, key=id_).where(F.col(id_) == F.col("component_id")).select(id_).distinct()
    return named.join(found, id_, "left_semi").dropDuplicates([id_]).select(*docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
