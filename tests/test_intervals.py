"""Interval joins of any length against all pairs, coverage against counted bases, and rules read from the source of each measure."""

import random

from pyspark.sql import functions as F

from helixmill.operators import intervals as I


def sides(spark, rng, lengths_l, lengths_r, span, n=250):
    make = lambda lengths: [(i, rng.choice("ab"), (s := rng.randrange(-span // 4, span)), s + rng.choice(lengths)) for i in range(n)]
    a, b = make(lengths_l), make(lengths_r)
    return a, b, spark.createDataFrame(a, "x long, contig string, start long, end long"), spark.createDataFrame(b, "y long, contig string, f_start long, f_end long")


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(1)
    every = [0, 1, 2, 127, 128, 129, 1_000, 1_024, 1_025, 70_000, 10**6, 10**8]
    for ll, lr, span in ((every, every, 10**8), ([1], every, 10**6), (every, [40, 60], 5_000), ([10**7], [3], 10**8), ([10**11], [10**5, 10**10], 10**9)):
        a, b, left, right = sides(spark, rng, ll, lr, span)
        want = sorted((x, y) for x, c, s, e in a for y, d, t, f in b if c == d and s < e and t < f and s < f and t < e)
        assert sorted(map(tuple, I.overlap_join(left, right).select("x", "y").collect())) == want
        assert I.overlap_join(left, right).columns == ["contig", "x", "start", "end", "y", "f_start", "f_end"]


def test_known_levels_give_the_same(spark):
    a, b, left, right = sides(spark, random.Random(2), [1], [5, 300], 2_000)
    assert sorted(map(tuple, I.overlap_join(left, right, levels=([0], [0, 1])).collect())) == sorted(map(tuple, I.overlap_join(left, right).collect()))


def test_rows_sent_do_not_grow_with_length(spark, monkeypatch):
    """What is shuffled for chromosomes against reads: a few rows an interval, whatever its length."""
    reads = spark.range(2_000).select(F.lit("c").alias("contig"), (F.col("id") * 50_000).alias("start"), (F.col("id") * 50_000 + 100).alias("end"))
    wide = spark.range(20).select(F.lit("c").alias("contig"), F.col("id").alias("f_start"), (F.col("id") + 10**8).alias("f_end"))
    sent, whole = [], I.bin_of
    monkeypatch.setattr(I, "bin_of", whole)
    joined = I.overlap_join(reads, wide)
    assert joined.count() == 20 * 2_000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 2
    for side in (0, 1):
        rows, c = ((reads, ("start", "end")), (wide, ("f_start", "f_end")))[side]
        level = I.level_of("f_start", "f_end") if side else F.lit(7)
        bins = rows.select(F.size(F.sequence(I.bin_of(F.col(c[0]), level), I.bin_of(F.col(c[1]) - 1, level))).alias("n")).agg(F.max("n")).first()[0]
        sent.append(bins)
    assert max(sent) <= 2


def test_deep_bin_is_split(spark):
    """A third of all reads on one locus: with skew splitting no task of the join holds them all."""
    reads = spark.range(0, 60_000, 1, 16).select(F.lit("c").alias("contig"), F.when(F.col("id") % 3 == 0, 490).otherwise(F.col("id") * 40).alias("start"), F.md5(F.col("id").cast("string")).alias("tag")).withColumn("end", F.col("start") + 30)
    loci = spark.range(30_000).select(F.lit("c").alias("contig"), (F.col("id") * 80).alias("f_start"), (F.col("id") * 80 + 20).alias("f_end"))
    for k, v in (("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "128k"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    try:
        met = I.overlap_join(reads, loci).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("tag"))
        per = [r["n"] for r in met.collect()]
    finally:
        for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(k)
    assert sum(per) == 20_000 + 20_000  # every hot read on one locus, every second other read on its own
    assert max(per) < 0.4 * sum(per)


def test_coverage_counts_bases(spark):
    rng = random.Random(3)
    feats = [(f"k{i % 7}", "c", s, s + n) for i, (s, n) in enumerate((rng.randrange(0, 300), rng.randrange(1, 60)) for _ in range(12))] + [("none", "d", 5, 15)]
    reads = [("c", s, s + rng.randrange(1, 40)) for s in (rng.randrange(-20, 350) for _ in range(80))]
    f = spark.createDataFrame(feats, "key string, contig string, f_start long, f_end long")
    r = spark.createDataFrame(reads, "contig string, start long, end long")
    want = {}
    for k, c, a, b in feats:
        met = [(max(a, s), min(b, e)) for d, s, e in reads if d == c and s < b and e > a]
        want[k, a, b] = (len(met), len({x for s, e in met for x in range(s, e)}), sum(e - s for s, e in met) / (b - a))
    for tile in (1 << 20, 16):
        assert {(x.key, x.f_start, x.f_end): (x.n_reads, x.covered, x.mean_depth) for x in I.coverage(f, r, "key", tile).collect()} == want
    per = {x.key: (x["count"], x.effective_length, x.coverage) for x in I.element_coverage(f, r, "key").collect()}
    own = [v for (k, *_), v in want.items() if k == "k0"]
    assert per["k0"] == (sum(v[0] for v in own), sum(v[1] for v in own) / len(own), sum(v[2] for v in own) / len(own)) and per["none"] == (0, 0.0, 0.0)


def test_mean_insert(spark):
    rows = [(99, 300), (99, 500), (99, 0), (147, -300), (99 | 256, 9_000), (99 | 2048, 9_000), (65, 7_000)]
    flags = spark.createDataFrame(rows, "flag int, tlen int")
    assert I.mean_insert(flags).first()[0] == 400.0 and I.mean_insert(flags.where("flag = 65")).first()[0] == 500.0


def strand_rows(spark, shares):
    """A bin of 100 first mates for each share of forward ones, and mates that do not count."""
    rows = [("c", i * 10_000 + j, 64 | (0 if j < round(100 * s) else 16)) for i, s in enumerate(shares) for j in range(100)]
    return spark.createDataFrame(rows + [("c", 5, f) for f in (128, 64 | 256, 64 | 2048, 64 | 4)] * 300 + [("d", 5, 64)] * 49, "contig string, start long, flag int")


def test_strandedness_by_its_thresholds(spark):
    """Worked by hand: 0.15 and 0.85 are extreme; over 0.80 central and under 0.05 extreme is unstranded; over 0.30 extreme is stranded."""
    for shares, verdict in (([0.5] * 20, "unstranded"), ([0.5] * 16 + [0.7] * 4, "ambiguous"), ([0.5] * 19 + [0.15], "ambiguous"), ([0.5] * 7 + [0.85] * 3, "ambiguous"), ([0.5] * 6 + [0.85] * 2 + [0.15] * 2, "stranded"), ([0.16, 0.84] * 5, "ambiguous"), ([], "ambiguous")):
        assert I.strandedness(strand_rows(spark, shares)).first().verdict == verdict
    r = I.strandedness(strand_rows(spark, [0.5] * 6 + [0.85] * 2 + [0.15] * 2)).first()
    assert (r.n_bins, round(r.mean, 9), r.central, r.extreme) == (10, 0.5, 0.6, 0.4)


def test_strand_histogram(spark):
    rows = I.strand_histogram(strand_rows(spark, [0.0, 0.05, 0.3, 0.55, 1.0, 0.99])).orderBy("bucket").collect()
    assert [r.n for r in rows] == [2, 0, 0, 1, 0, 1, 0, 0, 0, 2]


def all_stretches(cigar):
    import re

    at, out = 0, []
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        out += [(at, at + int(n))] * (op in "M=X")
        at += int(n) * (op in "MDN=X")
    return out


def pair_rows_shuffled(df):
    """Exchanges of the plan that stand above a join of reads and features."""
    lines, above = df._jdf.queryExecution().optimizedPlan().toString().split("\n"), 0
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "Aggregate" in x or "Window" in x:
            below = [lines[j] for j in range(i + 1, len(lines)) if all(depth[k] > depth[i] for k in range(i + 1, j + 1))]
            above += any("_bin" in y and "Join Inner" in y for y in below)
    return above


def test_full_length_sums_stretches_inside_the_pair(spark):
    """Few and many stretches, a read twice at one place, an element twice, gaps that hold a whole element; no pair is grouped."""
    rng = random.Random(4)
    cigars = ["30M", "5S10M5N10M", "3M2N3M2D4M1I5M9N6X", "2M3N" * 11 + "4=", "1M1N" * 7 + "2M", "4M60N4M"]
    reads = [(i, rng.choice("ab"), rng.choice("+-"), s := rng.randrange(0, 400), s + max(e for _, e in all_stretches(c)), c) for i in range(60) for c in [rng.choice(cigars)]]
    reads += reads[:5]
    elements = [(f"g{i}", rng.choice("ab"), s := rng.randrange(0, 400), s + rng.choice([4, 20, 60, 300]), rng.choice("+-")) for i in range(40)]
    elements += elements[:3]
    want = {}
    for read, c, strand, s, e, cigar in reads:
        for gene, d, a, b, fs in elements:
            for x, y in all_stretches(cigar):
                if c == d and s + x < b and s + y > a:
                    want[read, gene] = want.get((read, gene), 0) + min(s + y, b) - max(s + x, a)
    got = I.full_length(spark.createDataFrame(reads, "read long, contig string, strand string, start long, end long, cigar string"), spark.createDataFrame(elements, "gene string, contig string, f_start long, f_end long, f_strand string"), 0.4, 9)
    rows = got.collect()
    assert {(r.read, r.gene): r.covered for r in rows} == want and len(rows) == len(want) > 100
    assert pair_rows_shuffled(got) == 0


def joined_pairs(df):
    """Whether the plan pairs intervals by bins."""
    return "_bin" in df._jdf.queryExecution().optimizedPlan().toString()


def random_reads(rng, n=150):
    reads = [(rng.randrange(n // 2), rng.choice("ab"), s := rng.randrange(-20, 400), s + rng.choice([0, 1, 5, 30, 200]), rng.choice("+-")) for _ in range(n)] + [(None, "a", 50, 60, "+"), (7_000, None, 50, 60, "+"), (7_001, "a", None, 60, "+")]
    return reads, "read long, contig string, start long, end long, strand string"


def test_counts_without_pairs_are_those_of_pairs(spark):
    """Reads with several rows, empty ones and nulls; touching, nested and equal features."""
    rng = random.Random(5)
    reads, schema = random_reads(rng)
    loci = [(f"g{i}", rng.choice("abc"), s := rng.randrange(-50, 450), s + rng.choice([0, 3, 10, 100]), rng.choice("xyz")) for i in range(30)] + [("n", None, 0, 400, "x")]
    loci += loci[:4]
    r, f = spark.createDataFrame(reads, schema), spark.createDataFrame(loci, "gene string, contig string, f_start long, f_end long, track string")
    meets = lambda x, g: None not in (x[1], x[2], g[1]) and x[1] == g[1] and x[2] < x[3] and g[2] < g[3] and x[2] < g[3] and x[3] > g[2]
    want = sorted((str(x), sum(meets(x, g) for g in loci), sum(meets(x, g) and g[4] == "y" for g in loci)) for x in reads)
    got = I.overlap_counts(r, f, {"n": F.lit(True), "y": F.col("track") == "y"})
    assert got.columns == [*r.columns, "n", "y"] and sorted((str(tuple(x[:5])), x.n, x.y) for x in got.collect()) == want and not joined_pairs(got)
    hit = {x[0] for x in reads if x[0] is not None and any(meets(x, g) for g in loci)}
    free = I.without_overlap(r, f, ["read"])
    assert sorted(str(tuple(x)) for x in free.collect()) == sorted(str(x) for x in reads if x[0] not in hit) and not joined_pairs(free)
    flags = I.track_flags(r, f, "read", ["x", "z"], {"any": ["x", "z"]})
    on = lambda read, t: read is not None and any(meets(x, g) and g[4] == t for x in reads if x[0] == read for g in loci)
    assert all((x.in_x, x.in_z, x.any) == (on(x.read, "x"), on(x.read, "z"), on(x.read, "x") or on(x.read, "z")) for x in flags.collect()) and flags.count() == len(reads) and not joined_pairs(flags)
    named = f.withColumns({"target": F.when(F.col("track") == "x", "L1HS").otherwise("o"), "family": F.when(F.col("track") == "y", "LINE/L1").otherwise("SINE")})
    shares = I.membership_fractions(r, named, "read", ["L1HS", "NEGATIVE"], ["L1HS"])
    for x in (rows := shares.collect()):
        all_hits = [g[4] for y in reads if y[0] == x.read for g in loci if meets(y, g)]
        assert x.L1HS == all_hits.count("x") / len(all_hits) and x.NEGATIVE == all_hits.count("z")
    assert len(rows) == len(hit) + any(x[0] is None and any(meets(x, g) for g in loci) for x in reads) and not joined_pairs(shares)


def test_coverage_makes_no_pairs(spark):
    r = spark.createDataFrame([("c", 0, 10), ("c", 5, 8), ("c", 10, 12), ("c", 20, 21)], "contig string, start long, end long")
    f = spark.createDataFrame([("k", "c", 5, 25), ("m", "c", 12, 20), ("o", "c", 8, 10), ("o", None, 8, 10)], "key string, contig string, f_start long, f_end long")
    got = I.coverage(f, r, "key")
    assert sorted(tuple(x)[0:1] + tuple(x)[4:] for x in got.collect()) == [("k", 4, 8, 11 / 20), ("m", 0, 0, 0.0), ("o", 0, 0, 0.0), ("o", 1, 2, 1.0)] and not joined_pairs(got)


def test_five_prime_hits_once_a_read(spark):
    """Reads of several rows, both ends in a window, windows that genes share, genes of one and of several windows, other strands; ends are not paired with windows for a distinct count."""
    rng = random.Random(6)
    reads, schema = random_reads(rng, 200)
    windows = [(f"g{i}", rng.choice("ab"), s := rng.randrange(-20, 420), s + rng.choice([0, 1, 4, 9, 40]), rng.choice("+-.")) for i in range(50)]
    windows += [("h", *w[1:]) for w in windows[:2]] + [("i", *windows[3][1:])] + [(None, "a", 40, 70, "+")]
    r, make = spark.createDataFrame(reads, schema), lambda rows: spark.createDataFrame(rows, "gene string, contig string, f_start long, f_end long, f_strand string")
    want = {}
    for gene, c, a, b, fs in windows:
        for read, d, s, e, strand in reads:
            for at, side in ((s, "+"), (None if e is None else e - 1, "-")):
                if c == d and at is not None and a <= at < b:
                    n = want.setdefault(gene, [0, 0, set()])
                    n[0] += side == strand == fs
                    n[1] += side == fs
                    n[2] |= {read} - {None}
    got = I.five_prime_hits(r, make(windows))
    assert {x.gene: (x.strand_matched, x.position_matched, x.either_end) for x in got.collect()} == {g: (a, b, len(c)) for g, (a, b, c) in want.items()}
    plan = I.five_prime_hits(r, make(windows[:50]))._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan
