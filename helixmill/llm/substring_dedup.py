"""Removal of byte strings that occur earlier in the corpus, by suffix arrays.

A string of 100 bytes cannot meet every other one in one task. Each text therefore sends anchors: the places where the hash
of 32 bytes is the smallest among the 32-byte runs of a 100-byte string. Equal strings have equal anchors at equal
offsets, so two places can only be equal where an anchor hash comes twice. Anchors with the same whole surroundings are one
class, decided by its first member; where surroundings differ, one member of each class sends its bytes, and a suffix array
over them gives the strings of 100 bytes that two classes share. Rows are combined before each shuffle, and a text is
sent in compressed form, never all strings of it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import free_name, int64s, lean, table, text_bytes, text_slices, texts_changed, with_row_ids
from helixmill.llm.suffix_array import suffix_array

LENGTH = 100
GRAM = 32
U = np.uint64
_rng = np.random.default_rng(20_240_229)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).view(U) | U(1)
ODD = _rng.integers(1, 1 << 63, 64, dtype=np.int64).view(U) | U(1)
#: Groups of more places than this are divided by longer common strings before they are sorted.
SMALL = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on, by doubling; as many as there are whole runs."""
    h = BYTES[data]
    for i in range(5):
        m = 1 << i
        h = h[:-m] * ODD[i] + h[m:]
        h ^= h >> U(29)
    return h * ODD[7] | U(1)


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    m = 1
    while 2 * m <= w:
        x = op(x[:-m], x[m:])
        m *= 2
    return op(x[: len(x) - (w - m)], x[w - m :]) if w > m else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of runs; places of anchors in `data`; first and last start of the strings that have this anchor).

    A string's anchor is the leftmost smallest of its runs, so each string of `length` bytes inside a document has one.
    """
    w = length - GRAM + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, U), none, none, none
    h = gram_hashes(data)
    low = sliding(h, w, np.minimum)  # of the string that starts here
    ok = np.zeros(len(low) + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, offsets[1:][long] - length + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | (low[:-1] == h[: len(low) - 1])
    new[offsets[:-1][long]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return h, none, none, none
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | new[1:]
    last = np.flatnonzero(stop)
    least = low[last]
    pad = np.zeros(w - 1, U)
    at = np.flatnonzero(sliding(np.concatenate((pad, np.where(ok, low, U(0)), pad)), w, np.maximum) == h)
    i = np.searchsorted(at, last)
    while len(off := np.flatnonzero(h[at[i]] != least)):
        i[off] += 1
    return h, at[i], first, last


def _digest(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the bytes start..stop of `data`, at least 32 of them, from the runs' hashes that cover them."""
    out = (stop - start).astype(U) * ODD[9]
    for i in range(1 + max(0, int((stop - start).max(initial=0)) // GRAM)):
        own = start + i * GRAM
        inside = own + GRAM <= stop
        out = np.where(inside, mix(out + ODD[10] * h[np.where(inside, own, 0)]), out)
    return mix(out + ODD[11] * h[stop - GRAM])


def anchor_rows(doc: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each anchor: hash, hash of its surroundings, document, packed place, packed hashes of its two half surroundings.

    The surroundings are what the strings of `length` bytes with this anchor cover. A half, with the run, is contained in
    every string that reaches at least so far to its side; 0 stands for a half that does not fit.
    """
    h, at, start, last = anchors(data, offsets, length)
    stop = last + length
    owner = np.searchsorted(offsets, at, side="right") - 1
    whole = _digest(h, start, stop)
    half = (length - GRAM) // 2
    a, b = at - half, at + GRAM + half
    left = np.where(a >= start, _digest(h, np.maximum(a, start), at + GRAM) >> U(33) | U(1), U(0))
    right = np.where(b <= stop, _digest(h, at, np.minimum(b, stop)) >> U(33) | U(1), U(0))
    place = (at - offsets[owner]) << 16 | (at - start) << 8 | (stop - at)
    return [h[at].view(np.int64), whole.view(np.int64), doc[owner], place, (left << U(32) | right).view(np.int64)]


def spans(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = place >> 16
    return at - (place >> 8 & 255), at + (place & 255)


def classes(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, class begins, group begins): rows by hash, surroundings, document and place."""
    order = np.lexsort((place, doc, whole, key))
    k, c = key[order], whole[order]
    group = np.ones(len(order), bool)
    group[1:] = k[1:] != k[:-1]
    new = group.copy()
    new[1:] |= c[1:] != c[:-1]
    return order, new, group


def united(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, joined where they touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    base = np.cumsum(new)  # keeps documents apart while the largest end so far is carried on
    reach = np.maximum.accumulate(hi + base * (1 << 40)) - base * (1 << 40)
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.maximum.reduceat(hi, first)


ROW = "kind byte, key long, whole long, doc long, place long, ends long"
FOUND = "kind byte, key long, doc long, lo long, hi long"
DECIDED, ASKED = 1, 2


def _found(kind: int, key: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), *map(pa.array, (key, doc, lo, hi))], ["kind", "key", "doc", "lo", "hi"])


def send_anchors(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts. Members of a class that meet in a batch are decided here; only the first one is sent on."""
    for batch in batches:
        parts = []
        for part in text_slices(batch, "text", 1 << 18):
            data, offsets = text_bytes(part.column("text"))
            parts.append(anchor_rows(int64s(part.column("key")), data, offsets, length))
        if not parts:
            continue
        key, whole, doc, place, ends = (np.concatenate(x) for x in zip(*parts))
        order, new, _ = classes(key, whole, doc, place)
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        sent = order[new]
        later = ~new & ((doc[order] != doc[first]) | (place[order] != place[first]))
        lo, hi = spans(place[order[later]])
        d, lo, hi = united(doc[order[later]], lo, hi)
        zero = np.zeros(len(d), np.int64)
        kind = np.concatenate((np.zeros(len(sent), np.int8), np.full(len(d), DECIDED, np.int8)))
        join = lambda a, b: pa.array(np.concatenate((a, b)))
        yield pa.RecordBatch.from_arrays([pa.array(kind), join(key[sent], mix(d.view(U)).view(np.int64)), join(whole[sent], zero), join(doc[sent], d), join(place[sent], lo), join(ends[sent], hi)], ["kind", "key", "whole", "doc", "place", "ends"])


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All anchors of some hashes: spans of later class members, and questions where classes of one hash may share a string."""
    got = [[np.asarray(b.column(c)) for c in ("kind", "key", "whole", "doc", "place", "ends")] for b in batches if b.num_rows]
    if not got:
        return
    kind, key, whole, doc, place, ends = (np.concatenate(x) for x in zip(*got))
    done = kind == DECIDED
    if done.any():
        yield _found(DECIDED, key[done], doc[done], place[done], ends[done])
    key, whole, doc, place, ends = (x[~done] for x in (key, whole, doc, place, ends))
    order, new, group = classes(key, whole, doc, place)
    if not len(order):
        return
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = ~new & ((doc[order] != doc[first]) | (place[order] != place[first]))
    lo, hi = spans(place[order[later]])
    d, lo, hi = united(doc[order[later]], lo, hi)
    if len(d):
        yield _found(DECIDED, d, d, lo, hi)
    heads = order[new]  # one row of each class, by hash
    g = np.cumsum(group[new]) - 1
    many = np.bincount(g)[g] > 1
    heads, g = heads[many], g[many]
    if not len(heads):
        return
    left, right = (ends[heads].view(U) >> U(32)).astype(np.int64), (ends[heads].view(U) & U(0xFFFFFFFF)).astype(np.int64)
    shared = [_shared(g, x) for x in (left, right)]
    large = np.bincount(g)[g] > SMALL
    plain = ~large & (shared[0] | shared[1])
    rows = [(heads[plain], key[heads[plain]])]
    for i, (x, on) in enumerate(zip((left, right), shared)):
        at = large & on
        rows.append((heads[at], mix(key[heads[at]].view(U) ^ (x[at].astype(U) * ODD[20 + i])).view(np.int64)))
    which, name = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    yield _found(ASKED, name, doc[which], place[which], np.zeros(len(which), np.int64))


def _shared(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same x, 0 apart."""
    order = np.lexsort((x, group))
    same = (group[order][1:] == group[order][:-1]) & (x[order][1:] == x[order][:-1]) & (x[order][1:] != 0)
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def shared_strings(contexts: list[tuple[int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Of stretches (document, start, bytes): (document, start) of each string of `length` bytes that starts earlier as well."""
    m = len(contexts)
    text: list[int] = []
    begins: list[int] = []
    whole = bytearray()  # marks the places where a string of `length` bytes fits
    for i, (_, _, data) in enumerate(contexts):
        begins.append(len(text))
        text.extend([b + m for b in data])
        text.append(m - i - 1)  # closes a stretch; no other place has it, the last one is the smallest
        fits = max(0, len(data) - length + 1)
        whole += b"\1" * fits + bytes(len(data) + 1 - fits)
    joined = b"\0".join(c[2] for c in contexts) + b"\0"
    out: list[tuple[int, int]] = []
    run: list[int] = []
    last = b""

    def close() -> None:
        places = []
        for s in run:
            i = bisect_right(begins, s) - 1
            places.append((contexts[i][0], contexts[i][1] + s - begins[i]))
        first = min(places)
        out.extend(p for p in places if p != first)

    for s in suffix_array(text):
        if whole[s]:
            own = joined[s : s + length]
            if own == last:
                run.append(s)
            else:
                if len(run) > 1:
                    close()
                run, last = [s], own
    if len(run) > 1:
        close()
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with text less each byte of a string of `length` bytes that also starts earlier, and what was done.

    Earlier: in a document of a smaller key, or before in the same document. Texts are UTF-8 bytes, null counts as empty.
    Strings are judged on the input. Added: n_bytes, n_removed, n_spans (maximal removed runs), kept (binary) and
    kept_sha256. Rows that repeat key and text are judged alike, and neither is earlier; different texts of one key, null as
    well, are documents of their own in order of their hashes. A null key is before all others. All columns stay, but for clashing names of the new ones. An empty table gives an empty
    result. `length` is over 32 and at most 255 - 32.
    """
    import zstandard

    new = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    names = [c for c in docs.columns if c not in new]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in names if c != text]
    id_ = free_name(names, "_id")
    docs = with_row_ids(docs.select(*names), key, text, id_)
    frame = docs.select(F.col(id_).alias("key"), F.col(text).alias("text"))
    sent = frame.mapInArrow(lean(lambda b: send_anchors(b, length)), ROW).repartition(n, "key")
    found = sent.mapInArrow(lean(decide), FOUND)

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for part in text_slices(b, "text"):
                data = [None if x is None else squeeze(x.encode()) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(int64s(part.column("key"))), part.column("row"), pa.array(data, pa.binary())], ["doc", "row", "packed"])

    own = docs.select(F.col(id_).alias("key"), F.col(text).alias("text"), F.struct(*(docs[c] for c in kept)).alias("row"))
    row = own.schema["row"].dataType.simpleString()
    texts = own.mapInArrow(lean(zipped), f"doc long not null, row {row}, packed binary").repartition(n, "doc")

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of some MB of unpacked texts."""
        for b in batches:
            yield from text_slices(b, "packed", 1 << 19)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = []
            for doc, data, asked in zip(b.column("doc").to_pylist(), b.column("packed").to_pylist(), b.column("asked").to_pylist()):
                whole = zstandard.ZstdDecompressor().decompress(data) if data else b""
                for x in asked:
                    at = x["lo"] >> 16
                    start = at - (x["lo"] >> 8 & 255)
                    out.append((x["key"], doc, start, whole[start : at + (x["lo"] & 255)]))
            keys, ds, starts, data = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ds, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["key", "doc", "start", "data"])

    asked = found.where(F.col("kind") == ASKED).groupBy("doc").agg(F.collect_list(F.struct("key", "lo")).alias("asked"))
    stretches = texts.join(asked, "doc").select("doc", "packed", "asked", "row").mapInArrow(lean(surroundings), "key long, doc long, start long, data binary")

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of the key; a group is complete when the next key comes."""
        doc_out, start_out, group, at = [], [], {}, None

        def flush() -> pa.RecordBatch:
            d, lo, hi = united(np.array(doc_out, np.int64), np.array(start_out, np.int64), np.array(start_out, np.int64) + length)
            return _found(DECIDED, d, d, lo, hi)

        def close() -> None:
            if len(group) > 1:
                for d, s in shared_strings([(d, s, x) for x, (d, s) in group.items()], length):
                    doc_out.append(d)
                    start_out.append(s)

        for b in batches:
            for k, d, s, x in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "start", "data"))):
                if k != at:
                    close()
                    group, at = {}, k
                group[x] = min(group.get(x, (d, s)), (d, s))
            if len(doc_out) > 1_000_000:
                yield flush()
                doc_out, start_out = [], []
        close()
        yield flush()

    sorted_ = stretches.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(sort_groups), FOUND)
    cuts = found.where(F.col("kind") == DECIDED).select("doc", "lo", "hi").unionByName(sorted_.select("doc", "lo", "hi"))
    cuts = cuts.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            rows, texts_out, kept_out = [], [], []
            for data, found in zip(b.column("packed").to_pylist(), b.column("cuts").to_pylist()):
                whole = zstandard.ZstdDecompressor().decompress(data) if data else b""
                runs: list[list[int]] = []
                for x in sorted((x["lo"], x["hi"]) for x in found or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                edges = [0, *(y for x in runs for y in x), len(whole)]
                left = b"".join(whole[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((len(whole), len(whole) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                kept_out.append(left)
                texts_out.append(None if data is None else left.decode("utf-8", "ignore"))
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts_out, pa.string()), pa.array(kept_out, pa.binary()), *cols], ["row", "text", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = texts.join(cuts, "doc", "left").select("doc", "packed", "cuts", "row").mapInArrow(lean(cut), f"row {row}, text string, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.select(*(F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in names), *new)


def drop_repeated_strings(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs`, their texts less the repeated strings; parts of characters at a cut go. Columns stay whatever their names."""
    return texts_changed(docs, remove_repeats)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
