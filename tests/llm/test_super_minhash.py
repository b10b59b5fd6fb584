"""SuperMinHash against a plain version, its estimates, and near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from helixmill.llm import super_minhash as sm
from helixmill.llm.ngram_jaccard import mix

U = np.uint64


def plain_signature(hashes, slots):
    """One shingle after another, with a whole permutation each and no early stop."""
    out = [(slots, 0)] * slots
    for h in hashes:
        p = list(range(slots))
        for j in range(slots):
            x = int(mix(np.array([(int(h) + j * int(sm.LEVEL)) % 2**64], U))[0])
            k = j + ((x & 0xFFFFFFFF) * (slots - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], (j, x))
    return [x for _, x in out]


@pytest.mark.parametrize("slots", [5, 12, 64])
def test_signature_is_the_plain_one(slots):
    rng = np.random.default_rng(slots)
    sizes = [1, 2, 7, 40, 0, 300, 3]
    h = rng.integers(0, 2**63, sum(sizes)).astype(U)
    d = np.repeat(np.arange(len(sizes)), sizes)
    got = sm.signatures(h, d, len(sizes), slots)
    for i, n in enumerate(sizes):
        assert got[i].tolist() == (plain_signature(h[d == i], slots) if n else [2**64 - 1] * slots)


def test_estimates_vary_less_than_independent_ones():
    """Sets of 20 and 25 shingles, 15 in common (J = 1/2): the mean is right, the variance below J (1 - J) / m."""
    rng = np.random.default_rng(7)
    m, seen = 120, []
    for _ in range(300):
        h = rng.integers(0, 2**63, 30).astype(U)
        a, b = h[:20], np.concatenate((h[:15], h[20:30]))
        s = sm.signatures(np.concatenate((a, b)), np.repeat([0, 1], [20, 25]), 2, m)
        seen.append((s[0] == s[1]).mean())
    assert abs(np.mean(seen) - 0.5) < 0.01 and np.var(seen) < 0.7 * 0.25 / m


def plain(rows, words=3, percent=85):
    """Components over all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = -(2**63)
    own = [low if k is None else k for k, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(own[i], least.get(root(i), own[i]))
    return sorted(((k, len(s), least[root(i)], own[i] == least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, docs, **more):
    frame = spark.createDataFrame([(*r, 1, "x", 3) for r in docs], "doc_id long, text string, set int, kept string, size int").repartition(3)
    return sorted((tuple(r) for r in sm.near_duplicates(frame, **more).collect()), key=str)


def test_all_pairs(spark):
    """Chains of edits around the threshold, exact copies, short, empty and null texts, null and shared keys."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(12):
            text = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8]) * len(base) // 120):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1_000, " ".join(text).title() if rng.random() < 0.3 else "\t".join(text)))
            base = text if g % 2 else base
    rows += [(2_000, None), (2_001, ""), (2_002, " \n"), (2_003, "one"), (2_004, "One"), (2_005, "one two"), (None, "one two"), (None, "other words here"), (2_006, "other words here"), (2_007, "far from all of them"), (2_007, "one")]
    rows += rows[:5]
    assert found(spark, rows) == plain(rows)


def test_common_counts():
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 90, rng.integers(0, 60))).astype(U) for _ in range(n)] for n in (7, 9))
    assert sm.common_counts(a, b, 8).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


@pytest.mark.parametrize("share", [512, 20])
def test_large_and_hot_groups(spark, monkeypatch, share):
    """One text in hundreds of copies, and sets that share bands with it but link only among themselves; one block a list, and many."""
    monkeypatch.setattr(sm, "SHARE", share)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(400)]
    for i in range(150):
        text = base.copy()
        for _ in range(rng.choice([1, 3, 7, 9, 11])):
            text[rng.randrange(200)] = rng.choice(words)
        rows.append((1_000 + i, " ".join(text)))
    assert found(spark, rows) == plain(rows)


def test_other_parameters(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(60)]
    assert found(spark, rows, words=1, percent=60, bands=60, rows=2) == plain(rows, 1, 60)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_very_long_text(spark):
    rows = [(1, "word " * 300_000), (2, "word word word word"), (3, " ".join(f"a{i % 70_000}" for i in range(140_000)))]
    assert found(spark, rows) == [(1, 1, 1, True), (2, 1, 1, False), (3, 70_000, 3, True)]
