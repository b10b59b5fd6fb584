"""Quality rules on repetition inside a document.

Words become numbers, the suffixes of each document's word sequence are sorted by prefix doubling over many documents at
a time (each document has numbers of its own, so matches stay inside it), and the longest common prefixes of
neighbouring suffixes are read off the ranks of the doublings. Intervals of neighbours with a common prefix are the
maximal repeated substrings; the union of their spans gives the covered share, the largest prefix the longest repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import lean, table, text_slices, texts_of

SYMBOLS = re.compile(rb"[#*$%&|<>]")
MIN_REPEAT = 8
MIN_WORDS = 20
MAX_COVERED = 0.30
MAX_LONGEST = 0.20
LONGEST_FLOOR = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def suffix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... numbers; the last array tells all suffixes apart.

    A rank is the place of the class's first suffix, so a class that falls apart keeps its place among the others, and
    after the first round only suffixes that still tie are sorted again. The last number must occur nowhere else.
    """
    n = len(words)
    kind = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(words, kind="stable").astype(kind)
    own = words[order]
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    open_ = _tied(order, new)
    while len(open_):
        group, after = rank[open_], rank[np.minimum(open_ + step, n - 1)]
        by = np.lexsort((after, group))
        open_, group, after = open_[by], group[by], after[by]
        place = np.arange(len(open_))
        starts, new = np.ones(len(open_), bool), np.ones(len(open_), bool)
        starts[1:] = group[1:] != group[:-1]
        new[1:] = starts[1:] | (after[1:] != after[:-1])
        rank = rank.copy()
        rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(starts, place, 0))
        levels.append(rank)
        open_ = _tied(open_, new)
        step *= 2
    return levels


def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of suffixes in order, with marks where a class begins, those whose class has others."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return order[~alone]


def neighbour_lcps(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each of its places but the first, the common prefix with the place before (0 at the first)."""
    n = len(levels[-1])
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    open_, top = np.arange(max(n - 1, 0)), np.full(max(n - 1, 0), -1)
    for j, rank in enumerate(levels):
        open_ = open_[rank[a[open_]] == rank[b[open_]]]
        top[open_] = j
    for j in range(int(top.max(initial=-1)), -1, -1):
        i = np.flatnonzero(top >= j)
        x, y = np.minimum(a[i] + lcp[i + 1], n - 1), np.minimum(b[i] + lcp[i + 1], n - 1)
        lcp[i[levels[j][x] == levels[j][y]] + 1] += 1 << j
    return order, lcp


def repeats(words: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: words covered by repeated substrings of at least `least` words, and the longest repeat."""
    sizes = np.array([len(w) for w in words], np.int64)
    covered, longest = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if not len(words):
        return covered, longest
    doc = np.repeat(np.arange(len(words)), sizes + 1)
    flat = np.empty(len(doc), np.uint64)
    closing = np.zeros(len(doc), bool)
    closing[np.cumsum(sizes + 1) - 1] = True
    flat[~closing] = np.concatenate(words).view(np.uint64)
    flat[closing] = np.uint64(0x1D8E4E27C47D124F)
    # a word's number holds its document, so that matches stay inside one document
    flat = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order, lcp = neighbour_lcps(suffix_ranks(flat))
    reach = np.maximum(lcp, np.append(lcp[1:], 0))  # the longest repeat that starts here: an interval's prefix
    at = np.zeros(len(flat), np.int64)
    at[order] = reach
    np.maximum.at(longest, doc, at)
    open_ = np.flatnonzero(at >= least)
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, open_, 1)
    np.add.at(edge, open_ + at[open_], -1)
    inside = np.cumsum(edge)[:-1] > 0
    np.add.at(covered, doc[inside], 1)
    return covered, longest


def measures(texts: list[str], least: int = MIN_REPEAT) -> list[tuple[int, int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, covered words, longest repeat of each text."""
    out, words = [], []
    for t in texts:
        data = t.encode()
        own = data.split()  # ASCII white space only
        words.append(np.fromiter(map(hash, own), np.int64, len(own)))
        joined = b"".join(own)
        lines = [x for x in data.split(b"\n") if x.strip()]  # bytes.strip takes ASCII white space only
        out.append([len(own), len(joined) if joined.isascii() else len(joined.decode()), len(SYMBOLS.findall(data)), len(lines) - len(set(lines))])
    covered, longest = repeats(words, least)
    return [(*x, int(c), int(m)) for x, c, m in zip(out, covered, longest)]


def score_quality(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, longest_floor: int = LONGEST_FLOOR, keep_columns: bool = False) -> DataFrame:
    """Counts and verdict for each row of `docs`.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words covered by repeats of min_repeat words or more),
    longest_repeat, base_failed (fewer than min_words words, or more than max_covered of them covered) and kept (not
    base_failed, and no repeat longer than longest_floor words and max_longest of the document). Null text: no words, so
    base_failed. Rows stay as many as they are. `keep_columns` returns all columns of `docs` beside; of clashing names the
    new column stays. An empty table gives an empty result.
    """
    held = [c for c in docs.columns if c not in {*COUNTS, "base_failed", "kept"}] if keep_columns else [key]
    got = _measured(docs.select(F.struct(*(docs[c] for c in held)).alias("row"), docs[text].alias("text")), None, min_repeat)
    return _judged(got, min_words, max_covered, max_longest, longest_floor).select("row.*", *COUNTS, "base_failed", "kept")


def _measured(frame: DataFrame, text: str | None, least: int) -> DataFrame:
    """The column `row` of `frame` with the counts of its field `text`, or else of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            batch = pa.RecordBatch.from_arrays([row, row.field(text) if text else batch.column("text")], ["row", "text"])
            for part in text_slices(batch, "text"):
                cols = zip(*measures(texts_of(part.column("text")), least))
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, pa.int64()) for c in cols)], ["row", *COUNTS])

    return frame.mapInArrow(lean(run), ", ".join(["row " + frame.schema["row"].dataType.simpleString(), *(f"{c} long" for c in COUNTS)]))


def _judged(got: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, longest_floor: int = LONGEST_FLOOR) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_covered * F.col("n_words"))
    much = (F.col("longest_repeat") > longest_floor) & (F.col("longest_repeat") > max_longest * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~much)


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that score_quality keeps, with the same columns, whatever their names. Repeated rows stay repeated; null and empty texts go."""
    return _judged(_measured(docs.select(F.struct(*docs.columns).alias("row")), "text", MIN_REPEAT)).where("kept").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")
