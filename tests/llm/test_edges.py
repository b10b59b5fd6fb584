"""Nulls in any column, empty and long texts, repeated rows, clashing names and empty tables."""

import hashlib

import pytest

from helixmill.llm import bpe, license_scan, line_dedup, ngram_jaccard, order_minhash, packing, quality_rules, substring_dedup

P = pytest.importorskip("public_tokenizers")
LONG = "long words go on and on " * 20_000
ROWS = [(None, "a b c d e f", None, 1), (1, None, "x", None), (2, "", "x", 1), (3, LONG, "x", 1), (4, "same text here", "x", 1), (4, "same text here", "x", 1), (5, "same text here", "y", 2)]
SCHEMA = "doc_id long, text string, kept string, n_words int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def operators():
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    return {
        "licenses": license_scan.scan_licenses,
        "minhash": order_minhash.order_minhash,
        "quality": quality_rules.score_quality,
        "lines": line_dedup.dedup_lines,
        "encode": lambda d: bpe.bpe_encode(d, path, pattern),
        "digests": lambda d: bpe.bpe_digests(d, path, pattern),
        "components": ngram_jaccard.jaccard_components,
        "repeats": substring_dedup.remove_repeats,
        "packing": packing.pack_documents,
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_every_row_has_a_result(spark, name):
    rows = operators()[name](frame(spark)).collect()
    keys = sorted(str(r.doc_id) for r in rows)
    assert keys == sorted(str(r[0]) for r in ROWS) if name != "packing" else set(keys) == {str(r[0]) for r in ROWS}
    own = {str(r.doc_id): r for r in rows}
    twins = [tuple(r) for r in rows if r.doc_id == 4]
    if name != "packing":
        assert twins[0] == twins[1]
    if name == "quality":
        assert own["1"].base_failed and own["1"].n_words == 0 and not own["3"].kept and own["3"].n_words == 120_000
    if name == "digests":
        assert own["1"].ids_sha256 == hashlib.sha256(b"").hexdigest() and own["3"].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    if name == "components":
        assert own["5"].component_id == 4 and own["2"].n_shingles == 0 and own["3"].n_shingles == 6
    if name == "minhash":
        assert own["4"].fingerprint == own["5"].fingerprint and own["1"].fingerprint == own["2"].fingerprint == ""
    if name == "repeats":
        assert own["3"].n_removed == len(LONG) - 24


@pytest.mark.parametrize("name", sorted(operators()))
def test_empty_table(spark, name):
    assert operators()[name](frame(spark, [])).count() == 0


def test_stages_keep_columns(spark):
    df = frame(spark)
    for stage in (quality_rules.keep_quality, line_dedup.drop_repeated_lines, ngram_jaccard.keep_one_of_each, substring_dedup.drop_repeated_strings):
        assert stage(df).columns == df.columns
    assert quality_rules.score_quality(df, keep_columns=True).columns == ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"]


HELPERS = "_id _ID_ _key _text _rows _row _lines doc no key row packed cuts own set component_id kept n_shingles".split()


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("stage", [line_dedup.drop_repeated_lines, ngram_jaccard.keep_one_of_each, substring_dedup.drop_repeated_strings, quality_rules.keep_quality], ids=lambda f: f.__name__)
def test_columns_of_helper_names_stay(spark, stage, shared):
    """Columns that are named as the operators' own helpers come out as they went in, with keys that are unique and with shared ones."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text.replace("word", "one")), (2, text.replace("word", "two")), (1 if shared else 3, text.replace("word", "three")), (None, text.replace("word", "four")), (None if shared else 5, text.replace("word", "five"))]
    df = spark.createDataFrame([(*r, *(100 * i + j for j in range(len(HELPERS)))) for i, r in enumerate(rows)], f"doc_id long, text string, {', '.join(f'{c} int' for c in HELPERS)}")
    out = stage(df)
    assert out.columns == df.columns
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(tuple(r)[1:] for r in df.collect())


def test_decoding(spark):
    df = spark.createDataFrame([(1, "häß  x\n"), (2, None)], "doc_id long, text string")
    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    got = {r.doc_id: bytes(r.data) for r in bpe.bpe_decode(bpe.bpe_encode(df, *args), *args).collect()}
    assert got == {1: "häß  x\n".encode(), 2: b""}
