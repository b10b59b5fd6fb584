"""Whole results of the queries against plain Python, and names that clash."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import license_scan, line_dedup, order_minhash, packing, quality_rules

P = pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdé漢", k=rng.randrange(1, 6)))
    out = [None, "", " \n ", "one two three", "#a *b $c\nx\nx\n" + "w " * 30]
    out += [" ".join(word() for _ in range(rng.randrange(15, 120))) for _ in range(25)]
    base = [word() for _ in range(90)]
    return out + [" ".join(base), " ".join([*base[:80], *base[:10]]), " ".join(base * 2), " ".join([*base, *(word() for _ in range(400)), *base]), "<|endoftext|> " + "many words " * 2500]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("columns")
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{top}/documents.parquet")
    return str(top), dict(rows)


def test_op3_is_the_plain_one(spark, folder):
    top, docs = folder
    got = {r.doc_id: r for r in order_minhash.op3_order_minhash(spark, top).collect()}
    order = sorted(docs)
    edited, likeness = {}, lambda a, b: len(a & b) / max(len(a), len(b)) if a or b else 1.0
    for k, after in zip(order, [*order[1:], order[0]]):
        own, other = docs[k] or "", docs[after] or ""
        half = len(own) // 2
        edited[k] = own[: len(own) - half] + other[:half]
    again = {r.doc_id: r.fingerprint for r in order_minhash.order_minhash(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    slots = lambda f: {f[i : i + 10] for i in range(0, len(f), 10)}
    assert set(got) == set(docs)
    for k, after in zip(order, [*order[1:], order[0]]):
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(docs[k] or ""), hashlib.sha256(edited[k].encode()).hexdigest())
        assert r.edited_fingerprint == again[k]
        assert r.near_edited == likeness(slots(r.fingerprint), slots(r.edited_fingerprint))
        assert r.near_next == likeness(slots(r.fingerprint), slots(got[after].fingerprint))


def test_op4_is_the_plain_one(spark, folder):
    top, docs = folder
    got = {r.doc_id: r for r in quality_rules.op4_quality(spark, top).collect()}
    verdicts = set()
    for k, t in docs.items():
        w = (t or "").encode().split()
        at: dict[tuple, list[int]] = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = {i + j for x in at.values() if len(x) > 1 for i in x for j in range(8)}
        longest, row = 0, [0] * (len(w) + 1)  # common prefixes of all pairs of suffixes, from the end on
        for i in range(len(w) - 1, -1, -1):
            row = [row[j + 1] + 1 if j < i and w[i] == w[j] else 0 for j in range(len(w))] + [0] if len(w) < 800 else row
            longest = max(longest, *row)
        r = got[k]
        lines = [x for x in (t or "").split("\n") if x.split()]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed) == (len(w), len(repeated), len(lines) - len(set(lines)), failed), k
        assert (r.word_chars, r.n_symbols) == (len(b"".join(w).decode()), sum((t or "").count(c) for c in "#*$%&|<>"))
        if len(w) < 800:
            assert r.kept == (not failed and not (longest > 64 and longest > 0.2 * len(w))), k
        verdicts.add((r.base_failed, r.kept))
    assert {(True, False), (False, True)} <= verdicts


def test_op7_is_the_plain_one(spark, folder):
    from tokenizers import Tokenizer

    top, docs = folder
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.op7_packing(spark, top).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, t in docs.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        want = [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        assert sorted(pieces[k]) == want
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048


def test_whole_licenses(spark):
    label, text = license_scan.TEXTS[3]
    words = text.split()
    worn = " ".join(["Before.", *words[:40], "really", "so", *words[41:90], *words[93:], "After."])
    frame = spark.createDataFrame([(1, worn), (2, " ".join(words[:30])), (3, " ".join([*words[:20], *words[:20], *words[:20], *words[:20], *words[:20]]))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame, phrases=[], notices=[(label, text)]).collect()}
    assert got[1].labels == label and got[1].base_labels == "" and 0.6 < got[1].score < 1
    assert got[2].labels == got[3].labels == "" and got[3].score < 0.3  # the same fifth five times is a fifth


def test_many_templates_join_by_shuffle(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "under the MIT License " + license_scan.NOTICES[1][1]), (2, None)], "doc_id long, text string")
    want = sorted(map(str, license_scan.scan_licenses(frame).collect()))
    monkeypatch.setattr(license_scan, "MOST_TEMPLATE_WORDS", 1)
    assert sorted(map(str, license_scan.scan_licenses(frame).collect())) == want


@pytest.mark.parametrize("name", ["fingerprint", "n_near", "offset"])
def test_clashing_names(spark, name):
    frame = spark.createDataFrame([(1, "a line that is long enough\nx", "old"), (2, None, "old")], f"doc_id long, text string, `{name}` string")
    if name == "fingerprint":
        out = order_minhash.order_minhash(frame)
        assert [r.fingerprint == "old" for r in out.collect()] == [False, False]
    elif name == "n_near":
        out = line_dedup.dedup_lines(frame)
        assert {r.n_near for r in out.collect()} == {0}
    else:
        pieces = packing.tokenised_pieces(frame, packing.tokenizer_path()).withColumn("offset", F.lit("old"))
        out = packing.pack_pieces(pieces)
        assert {type(r.offset) for r in out.collect()} == {int}
    assert out.columns.count(name) == 1 and out.count() == 2
