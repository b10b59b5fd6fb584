"""Column functions on reads, k-mers and record ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 128
OUTER = 1 << 16
#: Rows that packed takes at a time, so that its arrays stay small whatever the size of an Arrow batch.
PACKED_ROWS = 256
_DIGIT = np.full(256, 9, np.uint8)
_DIGIT[[ord(c) for c in "ACGT"]] = range(4)


def standardize(seq: Column) -> Column:
    """Upper case, and nothing but A, C, G and T."""
    return F.regexp_replace(F.upper(seq), "[^ACTG]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def tiles(df: DataFrame, seq: str, overlap: int, size: int = TILE, outer: int = OUTER) -> DataFrame:
    """seq in pieces of `size` characters and the `overlap` that follows, as _part with its place _at. Cut twice, so that the work stays linear in a sequence's length."""
    cut = lambda s, n: F.posexplode(F.regexp_extract_all(s, F.lit(rf"(?=([\s\S]{{1,{n + overlap}}}))[\s\S]{{1,{n}}}"), 1))
    keep = [c for c in df.columns if c != seq]
    wide = df.select(*keep, cut(F.col(seq), outer).alias("_o", "_wide"))
    # the last characters of a wide piece are its overlap: they start no tile, but for those of the sequence's end, which are too short for one anyway
    inner = wide.select(*keep, "_o", cut(F.col("_wide"), size).alias("_i", "_part")).where(F.col("_i") * size < outer)
    return inner.select(*keep, (F.col("_o") * outer + F.col("_i") * size).alias("_at"), "_part")


def _places(n: int, k: Column) -> Column:
    """1 to the last start of a k-mer in a tile; whole tiles give no more than their own n starts."""
    return F.explode(F.sequence(F.lit(1), F.least(F.length("_part") - k + 1, F.lit(n))))


def explode_kmers(df: DataFrame, k: int, seq: str = "seq", canonical: bool = False, out: str = "kmer") -> DataFrame:
    """A row per overlapping k-mer with its offset; none for shorter sequences. Sequences are cut into tiles first, so that a substring never walks a whole one."""
    part = tiles(df.where(F.length(seq) >= k), seq, k - 1).where(F.length("_part") >= k)
    keep = [c for c in part.columns if c not in ("_at", "_part")]
    back = [reverse_complement(F.col("_part")).alias("_back")] if canonical else []
    rows = part.select("*", *back).select("*", _places(TILE, F.lit(k)).alias("_i"))
    kmer = F.expr(f"substring(_part, _i, {k})")
    if canonical:
        kmer = F.least(kmer, F.expr(f"substring(_back, length(_part) - _i - {k - 2}, {k})"))
    return rows.select(*keep, (F.col("_at") + F.col("_i") - 1).alias("offset"), kmer.alias(out))


def explode_codes(df: DataFrame, ks: list[int], seq: str = "seq", canonical: bool = True) -> DataFrame:
    """df without seq, k and the code of each overlapping k-mer, for all k at once. A tile is put into digits once for each strand; only numbers leave it."""
    part = tiles(df, seq, max(ks) - 1)
    keep = [c for c in part.columns if c not in ("_at", "_part")]
    digits = part.withColumn("_part", F.translate("_part", "ACGT", "0123"))
    digits = digits.withColumn("_back", F.reverse(F.translate("_part", "0123", "3210"))) if canonical else digits
    digits = digits.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where(F.length("_part") >= F.col("k"))
    rows = digits.select("*", _places(TILE, F.col("k")).alias("_i"))
    one = F.expr("substring(_part, _i, k)")
    if canonical:
        one = F.least(one, F.expr("substring(_back, length(_part) - _i - k + 2, k)"))
    # up to 18 digits are read as a decimal number here and put right by code_of_digits once counts are combined
    return rows.select(*keep, "k", (one.cast("bigint") if max(ks) <= 18 else F.conv(one, 4, 10).cast("bigint")).alias("code"))


def code_of_digits(code: Column, ks: list[int]) -> Column:
    """The code of what explode_codes gives for these ks."""
    return F.conv(code.cast("string"), 4, 10).cast("bigint") if max(ks) <= 18 else code


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers as an array; empty for a shorter sequence."""
    some = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, some).otherwise(F.array().cast("array<string>"))


def canonical_kmer(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; text order is the order of the codes."""
    return F.least(kmer, reverse_complement(kmer))


def base_code(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a number, the first base highest, A C G T = 0 1 2 3."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def splitmix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers. Their arithmetic is one that SQL types don't have."""
    # fixed values: the shifts and factors of splitmix64
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(T.LongType())
def splitmix_bucket(code: pd.Series, buckets: pd.Series) -> pd.Series:
    """splitmix64 of a code, modulo the number of buckets."""
    return pd.Series((splitmix64(code.to_numpy().astype(np.uint64)) % buckets.to_numpy().astype(np.uint64)).astype(np.int64))


def packed(seq: Column, n: int, first: int = 0x4E00) -> Column:
    """Each n bases as one character; bases left over at the end go. Other characters than A, C, G and T raise an error."""
    if n < 1 or not 0x800 <= first <= first + 4**n <= 0xD800:
        raise ValueError(f"packed: {n} bases a character from {first} on leave the characters of three bytes")
    return _packed(seq.cast("string"), F.lit(n), F.lit(first))


@F.arrow_udf(T.StringType())
def _packed(seq: pa.Array, n: pa.Array, first: pa.Array) -> pa.Array:
    """packed, a batch at a time: characters from U+0800 to U+D7FF are three bytes of UTF-8, so a batch's text is one array of them."""
    if not len(seq):
        return pa.array([], pa.string())
    k, start, out = n[0].as_py(), first[0].as_py(), []
    for at in range(0, len(seq), PACKED_ROWS):
        part = seq.slice(at, PACKED_ROWS)
        rows = [x or b"" for x in pc.cast(part, pa.binary()).to_pylist()]
        digits = _DIGIT[np.frombuffer(b"".join(rows), np.uint8)]
        if (digits > 3).any():
            raise ValueError("packed: only A, C, G and T")
        sizes = np.array([len(x) for x in rows], np.int64)
        begin, count = np.cumsum(sizes) - sizes, sizes // k
        ends = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat(begin - ends[:-1] * k, count) + np.arange(ends[-1]) * k
        code = np.zeros(len(place), np.int64)
        for j in range(k):
            code = code * 4 + digits[place + j]
        code += start
        text = np.empty((len(code), 3), np.uint8)
        text[:, 0], text[:, 1], text[:, 2] = 0xE0 | code >> 12, 0x80 | code >> 6 & 63, 0x80 | code & 63
        made = pa.StringArray.from_buffers(len(part), pa.py_buffer((ends * 3).astype(np.int32)), pa.py_buffer(text.tobytes()))
        out.append(pc.if_else(pc.is_null(part), pa.scalar(None, pa.string()), made))
    return pa.concat_arrays(out)


def field(read_id: Column, i: int) -> Column:
    return F.element_at(F.split(read_id, r"\|"), i)


def raw_label(read_id: Column) -> Column:
    """The last field up to a hyphen; an id of one field is its own label."""
    return F.when(F.size(F.split(read_id, r"\|")) >= 2, F.split(field(read_id, -1), "-")[0]).otherwise(read_id)


def transcript_id(read_id: Column) -> Column:
    return field(read_id, 1)


def mate_key(read_id: Column) -> Column:
    return F.regexp_replace(read_id, r"/[12](?=\||$)", "")


def fragment_key(read_id: Column) -> Column:
    """The id less its last field and the mate's mark: the same for both mates and all labelled copies."""
    return mate_key(F.regexp_replace(read_id, r"\|[^|]*$", ""))


def class_of(label: Column) -> Column:
    """NEGATIVE, L1HS, L1PA or OTHER of a raw label."""
    u = F.upper(label)
    return F.when(u == "NEGATIVE", "NEGATIVE").when(u.startswith("L1HS"), "L1HS").when(u.startswith("L1P"), "L1PA").otherwise("OTHER")


def task_label(read_id: Column) -> Column:
    return class_of(raw_label(read_id))


def age_rank(subfamily: Column) -> Column:
    """A key that sorts subfamilies from young to old, other old ones and the background last. The number is the first in the name, as the rule is written, so L1PA* share that of L1."""
    number = F.coalesce(F.nullif(F.regexp_extract(subfamily, "[0-9]+", 0), F.lit("")).cast("int"), F.lit(99))
    first = F.when(subfamily == "L1HS", 0).when(subfamily.startswith("L1PA"), 1).when(subfamily.startswith("L1P"), 2).when(subfamily == "NEGATIVE", 9).otherwise(5)
    return F.struct(first.alias("era"), F.when(first == 1, number).otherwise(0).alias("number"), subfamily.alias("name"))


def display_group(label: Column) -> Column:
    """The names of the groups."""
    u = F.upper(label)
    return (
        F.when(u == "NEGATIVE", "NEGATIVE").when(u.startswith("L1HS"), "L1HS (young)").when(u.rlike("^L1PA[2-6]$"), "L1PA2-6 (young)")
        .when(u.startswith("L1P"), "L1PA7+/L1P (older)").when(u.startswith("L1M"), "L1M*/L1ME* (old)").when(u.startswith("L1"), "other L1").otherwise("other")
    )


def parse_region(region: Column) -> Column:
    """chr:start-end(strand) as a struct; anything else raises an error."""
    at = lambda i: F.regexp_extract(region, r"^(chr\w+):(\d+)-(\d+)\(([+-])\)", i)
    good = F.when(region.isNotNull() & (at(1) == ""), F.raise_error(F.concat(F.lit("bad region: "), region)).cast("string")).otherwise(at(1))
    return F.struct(good.alias("chrom"), at(2).try_cast("bigint").alias("start"), at(3).try_cast("bigint").alias("end"), at(4).alias("strand"))


def parse_locus_name(name: Column) -> Column:
    """family.category.region.strand as a struct."""
    part = lambda i: F.get(F.split(name, r"\."), F.lit(i))
    return F.struct(part(0).alias("family"), part(1).alias("category"), part(2).alias("region"), part(3).alias("strand"))


def uid(key: Column) -> Column:
    return F.replace(F.split(F.split(key, ":")[0], r"\.")[0], F.lit("UID-"), F.lit("UID"))


def is_primary(chrom: Column) -> Column:
    return chrom.rlike("^chr([1-9]|1[0-9]|2[0-2]|X|Y|M)$")


def chrom_order(chrom: Column) -> Column:
    """1 to 22, X, Y, M and MT, others last."""
    tail = F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1 << 20)).otherwise(chrom)
    return F.when(tail.rlike("^[0-9]+$"), F.when(F.length(tail) < 10, tail).cast("int")).when(tail == "X", 23).when(tail == "Y", 24).when(tail.isin("M", "MT"), 25).otherwise(26)


#: Regions of the consensus, 1-based and inclusive.
REGIONS = [("5UTR", 1, 909), ("ORF1", 910, 1923), ("interORF", 1924, 1990), ("ORF2_EN", 1991, 2730), ("ORF2_mid", 2731, 3399), ("ORF2_RT", 3400, 4350), ("ORF2_C", 4351, 5814), ("3UTR", 5815, 6100)]
SUBREGIONS = [("ORF0", 235, 450)]


def consensus_region(position: Column, regions: list[tuple[str, int, int]] = REGIONS) -> Column:
    out = F.lit("outside")
    for name, lo, hi in reversed(regions):
        out = F.when(position.between(lo, hi), name).otherwise(out)
    return out


def nested_regions(position: Column, regions: list[tuple[str, int, int]] = SUBREGIONS) -> Column:
    """Names of all nested features that hold the position."""
    return F.array_compact(F.array(*(F.when(position.between(lo, hi), F.lit(name)) for name, lo, hi in regions)))


def pair_encoding(a: Column, b: Column, most: int, cls: int = 0, sep: int = 2) -> Column:
    """[cls] a [sep] b [sep] with type ids and mask; the longer of a and b gives way until `most` ids are left, a first on ties.

    For a budget of B = most - 3 ids, a keeps min(|a|, max(B // 2, B - |b|)) and b the rest.
    """
    room = most - 3
    na = F.when(F.size(a) + F.size(b) <= room, F.size(a)).otherwise(F.least(F.size(a), F.greatest(F.lit(room // 2), room - F.size(b))))
    nb = F.when(F.size(a) + F.size(b) <= room, F.size(b)).otherwise(F.least(F.size(b), room - na))
    mark = lambda x: F.array(F.lit(x).cast("bigint"))
    ids = F.concat(mark(cls), F.slice(a, F.lit(1), na), mark(sep), F.slice(b, F.lit(1), nb), mark(sep))
    types = F.concat(F.array_repeat(F.lit(0), na + 2), F.array_repeat(F.lit(1), nb + 1))
    return F.struct(ids.alias("input_ids"), types.alias("token_type_ids"), F.array_repeat(F.lit(1), na + nb + 3).alias("attention_mask"))


def padded(ids: Column, multiple: int, pad: int = 1) -> Column:
    """The array with `pad` up to the next multiple."""
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), F.pmod(-F.size(ids), F.lit(multiple)).cast("int")))


def keyed_uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key only, by md5, as other engines have it too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(16**13)


def masked_ids(ids: Column, key: Column, share: float = 0.2, mask: int = 4) -> Column:
    """Ids with about `share` of them masked, and labels: the id where masked, else -100. What is masked depends on the key."""
    on = lambda i: keyed_uniform(key, i.cast("string")) < share
    return F.struct(F.transform(ids, lambda t, i: F.when(on(i), F.lit(mask).cast("bigint")).otherwise(t)).alias("input_ids"), F.transform(ids, lambda t, i: F.when(on(i), t).otherwise(F.lit(-100).cast("bigint"))).alias("labels"))


def long_read_fragments(df: DataFrame, key: str, seq: str, read_length: int = 150, mean: int = 500, sd: int = 10, coverage: int = 5, seed: str = "0") -> DataFrame:
    """Pairs (forward, reverse) from long reads: len * coverage / mean fragments of normal sizes at keyed starts; a short read gives one pair."""
    u = lambda name: keyed_uniform(F.col(key).cast("string"), F.col("i").cast("string"), F.lit(f"{seed}{name}"))
    n = F.length(seq)
    short = df.where(n < mean + sd).select(key, F.lit(0).alias("i"), F.substring(seq, 1, read_length).alias("forward"), F.reverse(F.substring(seq, 1, read_length + 1)).alias("reverse"))
    many = df.where(n >= mean + sd).select(key, seq, n.alias("n"), F.explode(F.sequence(F.lit(1), F.floor(n * coverage / mean).cast("int"))).alias("i"))
    normal = F.sqrt(-2 * F.log(1 - u("a"))) * F.cos(2 * F.pi() * u("b"))
    many = many.withColumn("size", (mean + sd * normal).cast("int"))
    many = many.withColumn("start", F.floor(u("c") * F.greatest(F.lit(1), F.col("n") - F.col("size") + 1)).cast("int"))
    end = F.col("start") + read_length + (F.col("size") - 2 * read_length) + read_length
    other = (read_length + F.floor(u("d") * (F.col("n") - read_length))).cast("int")
    many = many.withColumn("stop", F.when(end > F.col("n"), other).otherwise(end))
    cut = lambda a: F.expr(f"substring(`{seq}`, {a} + 1, {read_length})")
    return short.unionByName(many.select(key, "i", cut("start").alias("forward"), cut(f"(stop - {read_length})").alias("reverse")))


def utr_window(start: Column, end: Column, strand: Column, most: int = 909) -> Column:
    """The first `most` bases of an element, seen from its own start."""
    size = F.least(F.lit(most), end - start)
    return F.struct(F.when(strand == "+", start).otherwise(end - size).alias("start"), F.when(strand == "+", start + size).otherwise(end).alias("end"))


def offset_5p(start: Column, end: Column, strand: Column, pos: Column) -> Column:
    return F.when(strand == "+", pos - start).otherwise(end - 1 - pos)


def binned(x: Column, edges: list[int]) -> Column:
    """low-high of the bin, >=last past the end; below the first edge as the last too."""
    out = F.lit(f">={edges[-1]}")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((x >= lo) & (x < hi), f"{lo}-{hi}").otherwise(out)
    return out


def significance(p: Column) -> Column:
    return F.when(p < 1e-4, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")


def kmer_position(mid: Column, strand: Column, offset: Column, k: int, read_len: Column) -> Column:
    """Where a read's k-mer lies on the target of the read's alignment."""
    delta = offset + k / 2 - read_len / 2
    return mid + F.when(strand == "+", delta).otherwise(-delta)


def better_hit(a: Column, b: Column) -> Column:
    """The alignment (struct with identity, aligned_frac) of the larger product; a on ties, the other if one is missing."""
    score = lambda x: x["identity"] * x["aligned_frac"]
    return F.when(a.isNull(), b).when(b.isNull(), a).when(score(a) >= score(b), a).otherwise(b)


def sequence_label(hit: Column, identity: float, coverage: float) -> Column:
    """(class, subfamily) of a read's best hit; NEGATIVE below either floor or without a hit."""
    weak = hit.isNull() | (hit["identity"] < identity) | (hit["aligned_frac"] < coverage)
    sub = F.split(F.split(hit["target"], "#")[0], r"\s+")[0]
    return F.struct(F.when(weak, "NEGATIVE").otherwise(class_of(sub)).alias("task_class"), F.when(weak, "NEGATIVE").otherwise(sub).alias("subfamily"))


def label_by(df: DataFrame, fn: Callable[[Column], Column], read_id: str = "id") -> DataFrame:
    """A label by any function from column to column, as for three classes or raw subfamilies."""
    return df.withColumn("label", fn(F.col(read_id)))
