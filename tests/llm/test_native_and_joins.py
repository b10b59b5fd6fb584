import random
import re
import string

import pytest
from pyspark.sql import functions as F

from helixmill.llm import license_scan as LS
from helixmill.llm import line_dedup as LD
from helixmill.llm import ngram_jaccard as NJ
from helixmill.llm import order_minhash as OM
from helixmill.llm.common import table
from helixmill.llm.packing import pack_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def made():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randrange(2, 8)))
    lines = [" ".join(word() for _ in range(rng.randrange(6, 12))) for _ in range(12)]
    docs = {0: None, 1: "", 2: " \n ", 3: "one two", 4: "one two", 5: "Released under the MIT License.\nmit license MIT\tLicense", 6: "GNU General Public License; Apache License", 7: "mit licenseK İ"}
    base = " ".join(word() for _ in range(60))
    for i in range(25):
        w = base.split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = word()
        docs[20 + i] = " ".join(w)
    for i in range(25):
        own = [rng.choice(lines) for _ in range(4)]
        x = list(own[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x))
            x[at : at + 1] = rng.choice(["", "z", x[at] + "q"])
        docs[60 + i] = "\n".join([*own, "".join(x), "}"])
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "w", 3) for k, t in docs.items()], "doc_id long, text string, words string, n long").repartition(5)


def test_licenses(spark):
    docs = made()
    got = {r.doc_id: r for r in LS.scan_licenses(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for k, t in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = sorted((j, label) for label, p in LS.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1
    notice = LS.NOTICES[0][1].split()
    changed = " ".join(["x", *notice[:12], "really", *notice[12:], "y"])
    r = LS.scan_licenses(frame(spark, {1: changed})).first()
    assert (r.base_labels, r.labels, r.n_base) == ("", "mit", 0) and r.spans[0].start == 1
    assert LS.scan_licenses(frame(spark, made()).limit(0)).count() == 0


def brute_slots(spark, text, k=3, slots=64):
    """The same choice, in plain Python, with Spark's hash of each item asked for one by one."""
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    mers = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    if not mers:
        return []
    rows = [(i, *m, *[None] * (k - len(m))) for i, m in enumerate(mers)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"w{j} string" for j in range(k)))
    h = {r.i: r.h for r in df.select("i", F.shiftright(F.xxhash64(*(f"w{j}" for j in range(k))), OM.PLACE).alias("h")).collect()}
    seen, items = {}, []
    for i in range(len(mers)):
        seen[h[i]] = seen.get(h[i], -1) + 1
        items.append((i, h[i], seen[h[i]]))
    y = {r.i: r.y % (1 << 64) for r in spark.createDataFrame(items, "i int, h long, o int").select("i", F.xxhash64("h", "o").alias("y")).collect()}
    best: dict[int, list] = {}
    for i, hh, _ in items:
        best.setdefault(y[i] % slots, []).append((y[i] >> (64 - (63 - 6 - OM.PLACE)), i, hh))
    out = []
    for s, x in sorted(best.items()):
        two = sorted(x)[:2]
        out.append((s, [hh for _, _, hh in sorted(two, key=lambda v: v[1])]))
    return out


def test_order_minhash(spark):
    texts = ["a b c d e f g a b c d a b c", "x", "", "p q " * 30, " ".join("abcdefghij"[i * i % 7] for i in range(60))]
    df = spark.createDataFrame(list(enumerate([*texts, None, texts[0]])), "doc_id long, text string")
    got = [r.s for r in OM.slots_of(df, "text", "s").orderBy("doc_id").select("s").collect()]
    for t, s in zip(texts, got):
        want = brute_slots(spark, t)
        assert [x >> 32 for x in s] == [b for b, _ in want], t
    assert got[0] == got[6] and got[2] == got[5] == []
    a = spark.createDataFrame([("a b c d e f g h i j k l",), ("g h i j k l a b c d e f",)], "text string")
    x, y = (r.s for r in OM.slots_of(a, "text", "s").select("s").collect())
    assert 0 < len(set(x) & set(y)) < len(x)


def test_next_document(spark):
    ids = random.Random(3).sample(range(10_000), 300)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next.text for r in OM.with_next(df, "doc_id", ["text"], 9).collect()}
    order = sorted(ids)
    assert got == {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}
    assert OM.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    assert OM.with_next(df.where(F.col("doc_id") == ids[0]), "doc_id", ["text"]).first().next is not None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("t", [1, 3, 6])
def test_edit_distance_of_stripped_lines(spark, t):
    rng = random.Random(t)
    pairs = []
    for _ in range(150):
        x = "".join(rng.choices("abé", k=rng.randrange(1, 90)))
        y = list(x)
        for _ in range(rng.randrange(t + 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "a", "z"])
        pairs.append((x, "".join(y)))
    pairs += [("", ""), ("a" * 64, "a" * 63), ("a" * 16, ""), ("", "ab")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", LD.within(F.col("a"), F.col("b"), t).alias("near"), LD.fingerprint(F.col("a")).alias("p"), LD.fingerprint(F.col("b")).alias("q"))
    for r in got.collect():
        assert r.near == (distance(r.a, r.b) <= t), (r.a, r.b)
        assert not r.near or ((r.p ^ r.q) & (1 << 64) - 1).bit_count() <= 2 * t - abs(len(r.a) - len(r.b))


@pytest.mark.parametrize("t", [1, 2])
def test_lines(spark, t):
    docs = made()
    first = {}
    for k in sorted(docs):
        for j, x in enumerate((docs[k] or "").split("\n") if docs[k] is not None else []):
            if any(c.isalnum() for c in x) or len(x) >= 20:
                first.setdefault(x, (k, j))
    near = {x for x in first for y in first if min(len(x), len(y)) >= 20 and first[y] < first[x] and abs(len(x) - len(y)) <= t and distance(x, y) <= t}
    got = {r.doc_id: r for r in LD.dedup_lines(frame(spark, docs), t).collect()}
    for k, text in docs.items():
        lines = text.split("\n") if text is not None else []
        exact = [j for j, x in enumerate(lines) if x in first and first[x] != (k, j)]
        close = [j for j, x in enumerate(lines) if j not in exact and x in near]
        want = None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in exact and j not in close)
        r = got[k]
        assert (r.text, r.n_lines, r.n_exact, r.n_near, r.words, r.n) == (want, len(lines), len(exact), len(close), "w", 3), k
    assert near and LD.dedup_lines(frame(spark, docs).limit(0)).count() == 0


def test_lines_come_from_two_smaller_plans(spark):
    """A plan that holds the search for keys at each place where its result is read is too large for a small driver."""
    docs, sizes, plain = frame(spark, made()), [], LD.stored

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    def seen(df, name):
        sizes.append(exchanges(df))
        return plain(df, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(LD, "stored", seen)
        sizes.append(exchanges(LD.dedup_lines(docs)))
    assert len(sizes) == 2 and max(sizes) <= 50, sizes


def test_divide_skip():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(20))) for _ in range(rng.randrange(1, 15))]
        t = rng.randrange(1, 8)
        count = {x: sum(x in y for y in lists) for x in range(30)}
        assert NJ.divide_skip(lists, t) == {x: n for x, n in count.items() if n >= t}


def test_jaccard(spark):
    docs = made()
    rng = random.Random(8)
    base = [f"w{rng.randrange(40)}" for _ in range(50)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(50)] = f"v{rng.randrange(900)}"
        docs[200 + i] = " ".join(w).upper() if i % 2 else "\t".join(w)
    sets = {}
    for k, t in docs.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(50):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NJ.jaccard_components(frame(spark, docs)).collect()}
    assert got == {k: (len(s), comp[k]) for k, s in sets.items()}
    kept = {r.doc_id for r in NJ.keep_one_of_each(frame(spark, docs)).collect()}
    assert kept == set(comp.values())
    assert NJ.jaccard_components(frame(spark, docs).limit(0)).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = made() | {500: "many words " * 3000}
    rows = pack_documents(frame(spark, docs), with_ids=True, capacity=256).collect()
    place, whole = {}, {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append((r.start, r.ids))
    for x in place.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 256
    for k, t in docs.items():
        assert [i for _, ids in sorted(whole[k]) for i in ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    src = table(spark, "/root/testdata/sf0.001", "documents")
    docs, seen = src, []
    for name, stage in P.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == src.columns
            assert docs.where("n_chars <> length(text)").count() == 0
    assert seen[0] == seen[1] >= seen[2] == seen[3] <= seen[4] and seen[0] > 150
    assert docs.select("doc_id").distinct().count() == seen[3]
