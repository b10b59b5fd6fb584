"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document above the capacity is cut; all its pieces but the first are full, so at most one piece of a document has to
share a sequence. Pieces are dealt to partitions by a hash of their key and packed there: above a third of the capacity
at most two fit together, so those are matched in pairs (largest first, each with the largest partner that fits);
the smaller ones fill the smallest gap that takes them, largest first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import KEPT, lean, table, text_bytes, text_slices

CAPACITY = 2048
#: How a byte-level vocabulary writes a blank (fixed value).
BLANK_BYTE = "\u0120"
#: How a byte-level vocabulary writes the bytes that do not stand for themselves in Latin-1 (fixed values).
BYTES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Bytes of a remembered piece beside its text and its ids, about.
ENTRY = 160
#: Kinds of bytes in UTF-8. Letters are the ASCII ones and those of two bytes from U+00C0 to U+017F and U+0400 to U+047F; the rest, an apostrophe too, is odd.
ODD, LETTER, DIGIT, SIGN, LINE, SPACE = range(6)
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = LETTER
KIND[48:58] = DIGIT
KIND[[b for b in range(33, 127) if KIND[b] == ODD and b != ord("'")]] = SIGN
KIND[[10, 32]] = LINE, SPACE
#: White space beyond ASCII, that of earlier Unicode versions too, as the number of its bytes (three, the last one 0 if there are two).
WHITE = [int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in range(0x80, 0x3001) if chr(c).isspace() or c == 0x180E]


def cut_pieces(flat: np.ndarray, bounds: np.ndarray, on: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start in the joined bytes of texts that start at `bounds`, and which of them are of plain chunks; without `on` chunks stay whole."""
    n = len(flat)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    kind = KIND[flat]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    blank = np.flatnonzero(kind == SPACE)
    after = np.append(flat, np.zeros(3, np.uint8))
    follows = after[blank + 1]
    cut_there = (follows > 32) & ~first[blank + 1]  # no white space, no control character, no end of a text
    some = np.flatnonzero((follows == 0xC2) | (follows >= 0xE1) & (follows <= 0xE3))
    a, b, c = (after[blank[some] + i].astype(np.int64) for i in (1, 2, 3))
    cut_there[some[np.isin(a << 16 | b << 8 | np.where(a == 0xC2, 0, c), WHITE)]] = False
    first[blank[cut_there]] = True
    first = first[:n]
    odd = kind == ODD
    odd[blank[~cut_there]] = True
    line = np.flatnonzero(kind == LINE)
    twice = line[1:][np.diff(line) == 1]
    odd[twice] = odd[twice - 1] = True
    sign = np.flatnonzero(flat == 0xC3)  # two signs among the letters
    odd[sign[np.isin(after[sign + 1], (0x97, 0xB7))]] = True
    starts = np.flatnonzero(first)
    plain = ~np.logical_or.reduceat(odd, starts) if on else np.zeros(len(starts), bool)
    more = np.empty(n, bool)
    more[0] = False
    np.not_equal(kind[1:], kind[:-1], out=more[1:])
    more[1:] &= kind[:-1] != SPACE
    sizes = np.diff(np.append(starts, n))
    inside = np.repeat(plain, sizes)
    starts = np.flatnonzero(first | more & inside)
    return starts, inside[starts]


class Encoder:
    """Token ids by a `tokenizers` file of a byte-level BPE, with a memory of pieces that always encode alike.

    Texts are cut before blanks that a word or sign follows, where the pre-tokeniser cuts in any case. What lies between two of
    these cuts is a chunk; one of plain characters (see KIND) is cut on as the pre-tokeniser cuts it, any other stays a piece.
    The pieces of many texts are numbered first, so that each is looked up once. New ones of plain chunks are encoded by the
    file's BPE model, other chunks without a blank inside many in one string: each begins with the only token there that
    begins with a blank.
    The memory has two generations of at most `most` bytes each (as estimated); what is asked for again moves to the younger.
    A text that holds an added token, such as the end of text, is encoded as a whole, so that no cut falls into it.
    """

    JOINED = 512
    #: Bytes of the longest piece that is remembered.
    LONGEST = 256
    #: Pieces whose ids are put in place at once.
    PLACED = 1 << 18

    def __init__(self, path: str, most: int = 48 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(BLANK_BYTE)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, cuts = self.tokenizer.model, self.tokenizer.pre_tokenizer
        #: Whether plain chunks can be cut here and encoded by the model alone.
        self.plain = (
            isinstance(self.model, models.BPE) and not self.model.dropout and self.tokenizer.normalizer is None
            and isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        )
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd_ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        found, alone, alike = {}, [], []
        for p in pieces:
            (alike if p.startswith(b" ") and p.count(b" ") == 1 else alone).append(p)
        runs = [alike[i : i + self.JOINED] for i in range(0, len(alike), self.JOINED)]
        for run, ids in zip(runs, self._encoded([b"".join(run).decode() for run in runs])):
            at = np.flatnonzero(self.opens[ids]) * 4
            if len(at) != len(run):
                alone += run
                continue
            data = ids.tobytes()
            found.update(zip(run, [data[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(data)])]))
        found.update(zip(alone, [ids.tobytes() for ids in self._encoded([p.decode() for p in alone])]))
        return found

    def _plain_ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        tokenize, ids, ends = self.model.tokenize, [], [0]
        for p in pieces:
            own = p.decode("latin-1")
            if not p.isascii() or own == "\n":
                own = own.translate(BYTES)
            elif own[0] == " ":
                own = BLANK_BYTE + own[1:]
            ids += [t.id for t in tokenize(own)]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return dict(zip(pieces, [data[i:j] for i, j in zip(ends, ends[1:])]))

    def _values(self, pieces: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of different pieces."""
        if self.held > self.most:
            self.older, self.known, self.held = self.known, {}, 0
        values = list(map(self.known.get, pieces))
        missing = [i for i, v in enumerate(values) if v is None]
        again = {p: v for p in map(pieces.__getitem__, missing) if (v := self.older.get(p)) is not None}
        new = [i for i in missing if pieces[i] not in again] if again else missing
        found = again | self._plain_ids([pieces[i] for i in new if plain[i]]) | self._odd_ids([pieces[i] for i in new if not plain[i]])
        for i in missing:
            values[i] = found[pieces[i]]
        kept = {p: v for p, v in found.items() if len(p) <= self.LONGEST}
        self.known.update(kept)
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        return values

    def many(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a null one is empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = {i for x in self.added for i in np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.match_substring(texts, x), False)))}
        cut_up = pa.compute.if_else(pa.array([i not in whole for i in range(len(texts))]), texts, None) if whole else texts
        flat, bounds = text_bytes(cut_up)
        starts, plain = cut_pieces(flat, bounds, self.plain)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(flat))), pa.py_buffer(flat)]).dictionary_encode()
        number, kinds = np.asarray(pieces.indices), np.zeros(len(pieces.dictionary), bool)
        kinds[number] = plain
        values = self._values(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), kinds.tolist())
        known, sizes = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        begins, ends = np.cumsum(sizes) - sizes, np.concatenate(([0], np.cumsum(sizes[number])))
        out = np.empty(ends[-1], "<u4")
        for i in range(0, len(number), self.PLACED):
            some = number[i : i + self.PLACED]
            a, b = ends[i], ends[i + len(some)]
            out[a:b] = known[np.repeat(begins[some] - ends[i : i + len(some)], sizes[some]) + np.arange(a, b)]
        at = ends[np.searchsorted(starts, bounds)].tolist()
        for i, (a, b) in enumerate(zip(at, at[1:])):
            yield self._encoded([texts[i].as_py()])[0] if i in whole else out[a:b]

    def ids(self, text: str) -> np.ndarray:
        return next(self.many([text]))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


KEPT["encoder"] = encoder.cache_clear


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length, which come in descending order."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    n_large = next((i for i, x in enumerate(lengths) if 3 * x <= capacity), len(lengths))
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(n_large - 1, -1, -1):
        by_length[lengths[i]].append(i)
    present = sum(1 << x for x in range(capacity + 1) if by_length[x])
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_bins = 0

    def largest(room: int) -> int:
        """Takes out a large item of at most `room`; -1 if there is none."""
        nonlocal present
        x = (present & ((1 << (room + 1)) - 1)).bit_length() - 1
        if x < 0:
            return -1
        i = by_length[x].pop()
        if not by_length[x]:
            present ^= 1 << x
        return i

    while (i := largest(capacity)) >= 0:
        out[i], room = (n_bins, 0), capacity - lengths[i]
        if (j := largest(room)) >= 0:
            out[j], room = (n_bins, lengths[i]), room - lengths[j]
        gaps[room].append(n_bins)
        n_bins += 1
    open_ = sum(1 << x for x in range(1, capacity + 1) if gaps[x])
    for i in range(n_large, len(lengths)):
        x = lengths[i]
        fits = open_ >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            at = gaps[room].pop()
            if not gaps[room]:
                open_ ^= 1 << room
        else:
            room, at, n_bins = capacity, n_bins, n_bins + 1
        out[i] = (at, capacity - room)
        if room > x:
            gaps[room - x].append(at)
            open_ |= 1 << (room - x)
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", key: tuple[str, ...] = ("doc_id", "piece"), partitions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to `capacity`; a row's place depends on the rows only.

    Each partition packs its own rows, at most one sequence of each is left badly filled. Ties go by the key columns.
    Other columns pass through; columns named sequence_id or offset are replaced. No row is dropped.
    """
    n = partitions or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.drop("sequence_id", "offset")
    dealt = pieces.repartition(n, F.xxhash64(*key)).sortWithinPartitions(F.desc(length), *key).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        places = pack(whole.column(length).to_pylist(), capacity)
        if not places:
            return
        base = whole.column("_part")[0].as_py() << 36
        whole = whole.drop_columns(["_part"]).append_column("sequence_id", pa.array([base + b for b, _ in places], pa.int64())).append_column("offset", pa.array([o for _, o in places], pa.int64()))
        yield from whole.to_batches(max_chunksize=20_000)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(lean(run), f"{names}, sequence_id long, offset long")


def tokenised_pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32 and, if asked for, ids. Null text is an empty one, which is the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows, ids_out = [], []
                for k, ids in zip(part.column("key").to_pylist(), own_encoder.many(part.column("text"))):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for i, (start, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + n]
                        rows.append((k, i, start, n, zlib.crc32(own)))
                        if with_ids:
                            ids_out.append(own.astype(np.int32))
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), (part.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []), ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run, "encoder"), f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, partitions: int | None = None) -> DataFrame:
    """Documents (doc_id, text) as pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; an empty document is one piece, the end id alone. Texts of any length are cut, none is
    shortened. Repeated rows are packed as often as they come, a null doc_id like any other. Other columns are dropped.
    An empty table gives an empty result. `with_ids` keeps the token ids of each piece.
    """
    return pack_pieces(tokenised_pieces(docs, path or tokenizer_path(), capacity=capacity, with_ids=with_ids), capacity, partitions=partitions)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
