"""Short lines, and rows that share a key or have none."""

import random

import pytest

from helixmill.llm import line_dedup, ngram_jaccard, substring_dedup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_short_lines(spark, tmp_path):
    rows = [(1, "And ornd.\n}\n\npage 1"), (2, "And ornd.\n}\n\npage 2\nx"), (3, "x\nAnd ornd.")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "}\n\npage 2\nx", 3: ""}
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, 0), 2: (5, 1, 0), 3: (2, 2, 0)}


def sentence(seed):
    return " ".join("".join(random.Random(seed * 100 + i).choices("abcdefgh", k=6)) for i in range(25))


@pytest.mark.parametrize("key", [None, 7])
def test_texts_of_one_key_are_documents(spark, key):
    a, b, c, d = map(sentence, range(4))
    mixed = [(1, a), (key, f"{b}\n{a}"), (key, f"{c}\n{d}"), (9, f"{a}\n{c}")]
    got = sorted(r.text for r in line_dedup.drop_repeated_lines(docs(spark, mixed)).collect())
    # a null key comes before 1, so the null document keeps a and document 1 loses it
    assert got == sorted([a, b, f"{c}\n{d}", ""] if key else ["", f"{b}\n{a}", f"{c}\n{d}", ""])
    kept = [r.text for r in ngram_jaccard.keep_one_of_each(docs(spark, [(1, a), (key, a), (key, b), (key, c), (key, c), (key, d), (9, d)])).collect()]
    assert sorted(kept) == sorted([a, b, c, d])
    rows = [(key, b), (key, c + d), (key, c + d), (9, "x" + b)]
    got = sorted((str(r.doc_id), r.n_removed, r.kept.decode()) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == sorted([(str(key), 0, b), (str(key), 0, c + d), (str(key), 0, c + d), ("9", len(b), "x")])


def test_components_of_shared_keys(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = a + " more"
    rows = [(2, a), (4, near), (4, b), (5, b), (8, near), (None, "one lone text"), (None, b + " x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_jaccard.jaccard_components(frame).collect())
    least = -(2**63)
    assert got == [(False, 2, 2), (False, 4, least), (False, 4, 2), (False, 5, least), (False, 8, 2), (True, 0, least), (True, 0, least)]
    kept = sorted(r.text for r in ngram_jaccard.keep_one_of_each(frame).collect())
    assert kept == sorted([a, "one lone text", b + " x"])
