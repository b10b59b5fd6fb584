"""Byte-level BPE by longest matches and backtracking.

A sequence of tokens is what the merges give exactly when each two neighbours are what the merges make of their joined
bytes. So an encoder can start from the longest token at each place, found in a trie over the bytes written as Latin-1,
and go back to shorter ones until neighbours agree. Every prefix has one encoding, so a place that
once could not be continued is never tried again, and the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import table, text_slices, texts_of
from helixmill.llm.words import head_and_chunks


class Bpe:
    """Encodes pieces of bytes by the ranks of a file; tokens' ids are their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.most = max(self.size.values(), default=0)
        #: What tokens start with, written as Latin-1, and for each such string the longest token that it starts with.
        self.starts = ahocorasick.Automaton()
        self.longest: dict[str, int] = {"": -1}
        #: For each token the longest shorter token that it starts with; -1 for a single byte.
        self.shorter: dict[int, int] = {}
        for b, r in ranks.items():
            t, n = b.decode("latin-1"), len(b) - 1
            self.starts.add_word(t, r)
            while n and t[:n] not in self.longest:
                n -= 1
            for k in range(n + 1, len(t) + 1):
                self.longest[t[:k]] = ranks.get(b[:k], self.longest[t[: k - 1]])
            self.shorter[r] = self.longest[t[:-1]]
        self.agree: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}

    def merges(self, data: bytes) -> tuple[list[int], list[tuple[int, int, int]]]:
        """The plain merges, always the adjacent pair of lowest rank, leftmost first: the tokens in the end, and each merge as (token, left part, right part)."""
        parts, done = [data[i : i + 1] for i in range(len(data))], []
        ranks = [self.ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < 1 << 60:
            at = ranks.index(best)
            done.append((best, self.ranks[parts[at]], self.ranks[parts[at + 1]]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = self.ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts], done

    def merged(self, data: bytes) -> list[int]:
        return self.merges(data)[0]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins to this one; (-1, -1) for a single byte, None if merges do not make it, or not in order of their ranks."""
        if token not in self.made:
            ids, done = self.merges(self.token[token])
            ranks = [x[0] for x in done]
            self.made[token] = (done[-1][1:] if done else (-1, -1)) if ids == [token] and ranks == sorted(ranks) else None
        return self.made[token]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merges leave both tokens as they are, side by side.

        Merges go on by themselves in either token until a pair across the middle comes first. Where they come in order of
        their ranks, the last of them are undone one after the other, and a pair across must rank before the merge undone.
        """
        if self.halves(left) is None or self.halves(right) is None:
            return self.merged(self.token[left] + self.token[right]) == [left, right]
        before = 1 << 60
        while self.ranks.get(self.token[left] + self.token[right], before) >= before:
            a, b = self.halves(left), self.halves(right)
            if a[1] < 0 and b[0] < 0:
                return True
            if b[0] < 0 or a[1] >= 0 and left > right:
                before, left = left, a[1]
            else:  # of two pairs of one rank the left one is merged first
                before, right = right + 1, b[0]
        return False

    def compatible(self, left: int, right: int) -> bool:
        known = self.agree.get((left, right))
        if known is None:
            if len(self.agree) > 500_000:
                self.agree.clear()
            known = self.agree[left, right] = self.neighbours(left, right)
        return known

    def encode(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        text, end, most, size, shorter, agree = data.decode("latin-1"), len(data), self.most, self.size, self.shorter, self.agree.get
        prefix, longest = self.starts.longest_prefix, self.longest
        out: list[int] = []
        at, dead, last = 0, set(), -1
        while at < end:
            token = longest[text[at : at + prefix(text[at : at + most])]]
            while True:
                while token >= 0:
                    if not dead or at + size[token] not in dead:
                        if last < 0 or (fits := agree((last, token))) or fits is None and self.compatible(last, token):
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                if last < 0:
                    raise ValueError("a byte is not in the vocabulary")
                dead.add(at)
                out.pop()
                at -= size[last]
                token, last = shorter[last], out[-1] if out else -1
            out.append(token)
            at += size[token]
            last = token
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Memory:
    """Bytes known for texts, in two generations of about `most` bytes each; what is asked for again moves to the younger."""

    #: Bytes of an entry beside its text and its bytes, about.
    ENTRY = 160

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def new(self, asked: set[str]) -> set[str]:
        """Those of `asked` that are not known; the others are in `known` until the next call."""
        if self.held > self.most:
            self.older, self.known, self.held = self.known, {}, 0
        missing = asked.difference(self.known)
        again = missing.intersection(self.older)
        self.put({x: self.older[x] for x in again})
        return missing.difference(again)

    def put(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + self.ENTRY * len(found)


class TextBpe:
    """Encodes texts: each match of the pattern on its own; chunks and matches that come again are looked up.

    A text is a head and chunks that follow a blank each, see spaced_chunks; chunks are kept without their blank. The matches
    of new chunks without a blank inside are found many in one string: each begins with the only match there that begins with a blank.
    """

    JOINED = 512

    def __init__(self, path: str, pattern: str, most: int = 64 << 20):
        import regex

        with open(path, "rb") as f:
            self.bpe = Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.matches = regex.compile(pattern).findall
        ids = range(max(self.bpe.token, default=-1) + 1)
        self.data = pa.array([self.bpe.token.get(r, b"") for r in ids], pa.large_binary())
        self.decimal = pa.array([b"%d," % r for r in ids], pa.large_binary())
        self.pieces, self.chunks = Memory(most), Memory(most)

    def _learn(self, chunks: set[str], heads: set[str]) -> dict[str, bytes]:
        """Puts the ids of new chunks into the memory; gives those of heads."""
        plain, odd = [c for c in chunks if " " not in c], [c for c in chunks if " " in c]
        names, found = [], []
        for run in (plain[i : i + self.JOINED] for i in range(0, len(plain), self.JOINED)):
            got = self.matches(" " + " ".join(run))
            at = [i for i, p in enumerate(got) if p[0] == " "]
            if len(at) != len(run):
                odd += run
                continue
            names += run
            found += [got[i:j] for i, j in zip(at, [*at[1:], len(got)])]
        names += odd
        found += [self.matches(" " + c) for c in odd]
        first = list(map(self.matches, heads))
        self.pieces.put({p: array("I", self.bpe.encode(p.encode())).tobytes() for p in self.pieces.new(set().union(*found, *first))})
        ids = self.pieces.known
        self.chunks.put({c: ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x]) for c, x in zip(names, found)})
        return {h: b"".join([ids[p] for p in x]) for h, x in zip(heads, first)}

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = list(map(head_and_chunks, texts))
        heads = self._learn(self.chunks.new(set().union(*(x[1] for x in parts))), {x[0] for x in parts})
        ids = self.chunks.known.__getitem__
        return [np.frombuffer(heads[head] + b"".join(map(ids, rest)), np.uintc) for head, rest in parts]

    def ids(self, text: str) -> list[int]:
        return self.many([text])[0].tolist()

    def written(self, texts: list[str]) -> list[tuple[bytes, int, bytes]]:
        """(decimal ids joined by commas, how many, the bytes they decode to) for each text."""
        ids = self.many(texts)
        sizes, flat = [len(x) for x in ids], pa.array(np.concatenate(ids))
        columns = []
        for words, less in ((self.decimal, 1), (self.data, 0)):
            _, offsets, data = words.take(flat).buffers()
            at = np.frombuffer(offsets, np.int64)[np.cumsum([0, *sizes])].tolist()
            data = memoryview(data or b"")
            columns.append([bytes(data[i : max(i, j - less)]) for i, j in zip(at, at[1:])])
        return list(zip(columns[0], sizes, columns[1]))

    def parts(self, text: str) -> list[tuple[bytes, int, bytes]]:
        return self.written([text])


@lru_cache(1)
def text_bpe(path: str, pattern: str) -> TextBpe:
    return TextBpe(path, pattern)


def _batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, rows, kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    own = text_bpe(path, pattern)
    for batch in batches:
        for part in text_slices(batch, "text"):
            done = rows(own, texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(zip(*done), kinds))], ["key", *names])


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array of int). Null or empty text: no ids. Rows stay as many as they are; other columns are dropped."""
    kind = docs.schema[key].dataType.simpleString()
    run = lambda b: _batches(b, path, pattern, lambda own, texts: zip(own.many(texts)), [pa.list_(pa.int32())], ["ids"])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, data (binary) of key, ids. Null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_bpe(path, pattern).bpe
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([own.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], ["key", "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def _digests(own: TextBpe, texts: list[str]) -> list[tuple[int, str, str]]:
    return [(n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()) for ids, n, data in own.written(texts)]


def bpe_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: what bpe_encode and bpe_decode give, hashed in the same pass.

    Null or empty text: 0 tokens and the hashes of nothing. Repeated rows stay; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    run = lambda b: _batches(b, path, pattern, _digests, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
