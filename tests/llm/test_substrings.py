import random

import numpy as np

from helixmill.llm.substring_dedup import anchors, remove_repeats, shared_strings
from helixmill.llm.suffix_array import suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        a = rng.choice([1, 2, 3, 26])
        t = [rng.randrange(1, a + 1) for _ in range(rng.randrange(40))] * rng.randrange(1, 4) + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    assert suffix_array([]) == []


def brute(docs, length=100):
    """{key: (n_bytes, removed, spans, kept)} by looking at every string."""
    first, out = {}, {}
    for k, data in sorted(docs.items()):
        for s in range(len(data) - length + 1):
            first.setdefault(data[s : s + length], (k, s))
    for k, data in docs.items():
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] != (k, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[k] = (len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), kept)
    return out


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    base = [" ".join(word() for _ in range(80)) for _ in range(4)]
    docs = {0: "", 1: None, 2: base[0], 3: base[0], 4: base[0][:150] + "X" + base[0][150:], 5: "a" * 1000, 6: "ab" * 400, 7: base[1] + base[1], 8: base[2][:99], 9: base[2], 10: base[2][1:101]}
    for i in range(30):
        a, b = rng.choice(base), rng.choice(base)
        x = rng.randrange(300)
        docs[20 + i] = a[x : x + 130] + word() + b[: rng.randrange(250)] + "\n" + word()
    line = " ".join(word() for _ in range(12)) + " hot line of some length"
    for i in range(90):
        docs[100 + i] = word() + "\n" + line + "\n" + " ".join(word() for _ in range(30))
    return docs


def test_remove_repeats_is_brute_force(spark):
    docs = made()
    want = brute({k: (t or "").encode() for k, t in docs.items()})
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], "doc_id long, text string, row string, kept int")
    got = remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert {r.row for r in got} == {"x"} and next(r.text for r in got if r.doc_id == 1) is None


def test_edges(spark):
    empty = remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    twice = spark.createDataFrame([(None, "q" * 150), (7, "q" * 150), (7, "q" * 150)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(twice).collect())
    assert got == [("7", 150), ("7", 150), ("None", 149)]


def test_anchors_cover_every_string():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 50, 1200, 1200, 1310, 3000])
    _, at, first, last = anchors(data, offsets)
    strings = {s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 99)}
    covered = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert sorted(covered) == sorted(strings)
    assert all(b <= p <= a + 68 for p, a, b in zip(at, first, last))


def test_shared_strings():
    x = bytes(range(32, 160))
    assert sorted(shared_strings([(2, 0, x), (1, 5, x[10:] + b"zz")])) == [(2, s) for s in range(10, 29)]
