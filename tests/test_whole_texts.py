"""Queries over texts take the whole text."""

import random
from collections import Counter

from helixmill.plans import q_streams as Q


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_kmer_has_a_token(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "en", "".join(rng.choices("ACGT", k=rng.choice((3, 6, 45, 46, 300))))) for i in range(1, 41)] + [(50, "en", None)]
    codes = {}
    for i, _, t in rows:
        for j in range(len(t or "") - 5):
            x = t[j : j + 6]
            codes[i, j] = int(min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))).translate(str.maketrans("ACGT", "0123")), 4)
    seen = Counter(codes.values())
    rank = {c: r for r, c in enumerate(sorted(c for c, n in seen.items() if n * len(seen) > len(codes)))}
    assert 0 < len(rank) < len(seen)
    want = {at: 5 + rank[c] if c in rank else 5 + len(rank) + c % 32 for at, c in codes.items()}
    got = [tuple(r) for r in Q.p07_token_ids(spark, documents(spark, tmp_path, rows)).select("doc_id", "off", "token").collect()]
    assert len(got) == len(want) and {(i, j): t for i, j, t in got} == want and max(j for _, j, _ in got) == 294


def test_every_word_may_be_masked(spark, tmp_path):
    rows = [(1, "en", "word " * 299 + "end"), (2, "en", "one two"), (3, "en", None)]
    got = {r.doc_id: r for r in Q.p24_masked_tokens(spark, documents(spark, tmp_path, rows)).collect()}
    assert got[1].n == 300 and 30 < got[1].masked < 90 and got[2].n == 2
