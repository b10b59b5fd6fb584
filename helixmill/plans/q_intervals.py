"""Queries on intervals. Order lines stand for reads, orders for features, days since 1992 for bases, a key modulo 997 for the contig."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import intervals as I
from helixmill.plans.q_kmers import rounded
from helixmill.plans.registry import query, table

BASE = """f AS (SELECT o_orderkey AS gene, 'c' || (o_custkey % 997) AS contig, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS f_start, f_start + 5 + o_orderkey % 40 AS f_end, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS f_strand, o_orderpriority AS family FROM orders),
r AS (SELECT l_orderkey * 10 + l_linenumber AS read, l_orderkey AS qname, 'c' || (l_partkey % 997) AS contig, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS start, start + l_quantity::BIGINT AS "end", CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
  (CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_linenumber > 5 THEN 256 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END)::INT AS flag FROM lineitem),
m AS (SELECT r.*, gene, f_start, f_end, f_strand, family FROM r JOIN f ON r.contig = f.contig AND start < f_end AND "end" > f_start)"""


def features(spark, d):
    o = table(spark, d, "orders")
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return o.select(F.col("o_orderkey").alias("gene"), F.concat(F.lit("c"), F.col("o_custkey") % 997).alias("contig"), start.alias("f_start"), (start + 5 + F.col("o_orderkey") % 40).alias("f_end"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("f_strand"), F.col("o_orderpriority").alias("family"))


def alignments(spark, d):
    x = table(spark, d, "lineitem")
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    flag = F.when(F.col("l_linestatus") == "O", 2).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128) + F.when(F.col("l_linenumber") > 5, 256).otherwise(0) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read"), F.col("l_orderkey").alias("qname"), F.concat(F.lit("c"), F.col("l_partkey") % 997).alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), flag.alias("flag"))


@query(f"WITH {BASE} SELECT read, gene, (least(\"end\", f_end) - greatest(start, f_start))::BIGINT AS bases FROM m")
def j01_overlap_join(spark, d):
    return I.overlap_join(alignments(spark, d), features(spark, d)).select("read", "gene", I.shared_bases().alias("bases"))


@query(f"WITH {BASE} SELECT read, gene FROM m WHERE (least(\"end\", f_end) - greatest(start, f_start)) / (\"end\" - start) >= 0.9")
def j02_strict_overlap(spark, d):
    return I.strict_overlap(I.overlap_join(alignments(spark, d), features(spark, d)), 0.9).select("read", "gene")


@query(f"WITH {BASE} SELECT read FROM r WHERE read NOT IN (SELECT read FROM m)")
def j03_no_overlap(spark, d):
    return I.without_overlap(alignments(spark, d), features(spark, d), ["read"]).select("read")


MERGED = """i AS (SELECT *, max(f_end) OVER (PARTITION BY contig ORDER BY f_start, f_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM f), i2 AS (SELECT *, sum(CASE WHEN far IS NULL OR f_start > far THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY f_start, f_end ROWS UNBOUNDED PRECEDING) AS island FROM i),
u AS (SELECT contig, min(f_start)::BIGINT AS start, max(f_end)::BIGINT AS "end" FROM i2 GROUP BY contig, island)"""


@query(f"WITH {BASE}, {MERGED} SELECT * FROM u")
def w05_merged_intervals(spark, d):
    return I.merged(features(spark, d).select("contig", F.col("f_start").alias("start"), F.col("f_end").alias("end")))


@query(f"WITH {BASE}, {MERGED} SELECT DISTINCT read FROM r JOIN u ON r.contig = u.contig AND r.start < u.end AND r.end > u.start WHERE r.end - r.start >= 20")
def j05_restricted_loci(spark, d):
    return I.restrict_loci(alignments(spark, d), features(spark, d).select("contig", F.col("f_start").alias("start"), F.col("f_end").alias("end")), 20, ["read"]).select("read").distinct()


@query(f"WITH {BASE}, g AS (SELECT * FROM r WHERE flag & 2 <> 0 AND flag & 256 = 0) SELECT a.qname, a.start AS start_1, b.start AS start_2 FROM g a JOIN g b USING (qname) WHERE a.flag & 64 <> 0 AND b.flag & 128 <> 0")
def j06_proper_pairs(spark, d):
    return I.proper_pairs(alignments(spark, d)).select("qname", "start_1", "start_2")


WINDOWS = """w AS (SELECT gene, contig, f_strand, CASE WHEN f_strand = '+' THEN f_start ELSE f_end - least(9, f_end - f_start) END AS f_start, CASE WHEN f_strand = '+' THEN f_start + least(9, f_end - f_start) ELSE f_end END AS f_end FROM f)"""


def windows(spark, d):
    from helixmill.functions.seq import utr_window

    return features(spark, d).withColumn("w", utr_window(F.col("f_start"), F.col("f_end"), F.col("f_strand"), 9)).select("gene", "contig", "f_strand", F.col("w.start").alias("f_start"), F.col("w.end").alias("f_end"))


@query(f"WITH {BASE}, {WINDOWS} SELECT gene, f_start, f_end, (f_start - 4)::BIGINT AS run_start, (f_end + 4)::BIGINT AS run_end FROM w")
def p22_windows(spark, d):
    return windows(spark, d).select("gene", "f_start", "f_end", (F.col("f_start") - 4).alias("run_start"), (F.col("f_end") + 4).alias("run_end"))


@query(f"""WITH {BASE}, {WINDOWS}, e AS (SELECT read, contig, strand, start AS pos, '+' AS side FROM r UNION ALL SELECT read, contig, strand, "end" - 1, '-' FROM r)
SELECT gene, count(*) FILTER (WHERE side = strand AND f_strand = strand) AS strand_matched, count(*) FILTER (WHERE side = f_strand) AS position_matched, count(DISTINCT read) AS either_end FROM e JOIN w ON e.contig = w.contig AND pos >= f_start AND pos < f_end GROUP BY gene""")
def j07_five_prime_hits(spark, d):
    return I.five_prime_hits(alignments(spark, d), windows(spark, d))


@query(f"""WITH {BASE}, e AS (SELECT r.*, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS p FROM r), o AS (SELECT CASE WHEN f_strand = '+' THEN p - f_start ELSE f_end - 1 - p END AS off FROM e JOIN f ON e.contig = f.contig AND p >= f_start AND p < f_end AND f_strand = strand)
SELECT CASE WHEN off >= 0 AND off < 5 THEN '0-5' WHEN off >= 5 AND off < 10 THEN '5-10' WHEN off >= 10 AND off < 20 THEN '10-20' ELSE '>=20' END AS bin, count(*) AS n, round(avg(off), 6) AS mean_offset FROM o GROUP BY 1""")
def p23_offset_bins(spark, d):
    from helixmill.functions.seq import binned, offset_5p

    r = alignments(spark, d)
    points = r.withColumn("start", F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))).withColumn("end", F.col("start") + 1)
    met = I.overlap_join(points, features(spark, d)).where("strand = f_strand").withColumn("off", offset_5p(F.col("f_start"), F.col("f_end"), F.col("f_strand"), F.col("start")))
    return rounded(met.groupBy(binned(F.col("off"), [0, 5, 10, 20]).alias("bin")).agg(F.count("*").alias("n"), F.avg("off").alias("mean_offset")), "mean_offset")


CIGAR = "cg AS (SELECT r.*, ((\"end\" - start) // 2)::BIGINT AS h FROM r WHERE \"end\" - start >= 4), bl AS (SELECT read, contig, strand, start AS r_start, \"end\" AS r_end, start AS b0, start + h AS b1 FROM cg UNION ALL SELECT read, contig, strand, start, \"end\", start + h + 2, start + h + 2 + h FROM cg)"


@query(f"""WITH {BASE}, {CIGAR}, v AS (SELECT read, gene, strand, r_start, r_end, f_start, f_end, f_strand, sum(least(b1, f_end) - greatest(b0, f_start))::BIGINT AS covered FROM bl JOIN f ON bl.contig = f.contig AND b0 < f_end AND b1 > f_start GROUP BY ALL),
x AS (SELECT *, CASE WHEN strand = '-' THEN r_end - 1 ELSE r_start END AS p, least(9, f_end - f_start) AS u FROM v)
SELECT read, gene, covered, covered / (f_end - f_start) >= 0.4 AND strand = f_strand AND CASE WHEN f_strand = '+' THEN p >= f_start AND p < f_start + u ELSE p >= f_end - u AND p < f_end END AS "full" FROM x""")
def j08_full_length(spark, d):
    r = alignments(spark, d).where("end - start >= 4").withColumn("h", F.floor((F.col("end") - F.col("start")) / 2))
    r = r.withColumn("cigar", F.concat(F.lit("3S"), "h", F.lit("M2N"), "h", F.lit("=1I")))
    return I.full_length(r, features(spark, d), 0.4, 9)


@query(f"""WITH {BASE}, e AS (SELECT contig, strand, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS p FROM r), o AS (SELECT least(floor((CASE WHEN f_strand = '+' THEN p - f_start ELSE f_end - 1 - p END) / (f_end - f_start) * 20), 19)::INT AS bin FROM e JOIN f ON e.contig = f.contig AND p >= f_start AND p < f_end AND strand = f_strand)
SELECT bin, count(*) AS n, round(count(*) * 20 / sum(count(*)) OVER (), 6) AS enrichment FROM o GROUP BY bin""")
def j09_start_profile(spark, d):
    return rounded(I.start_profile(alignments(spark, d), features(spark, d)), "enrichment")


TRACKS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query(f"""WITH {BASE}, x AS (SELECT read, bool_or(family = '1-URGENT') AS a, bool_or(family = '2-HIGH') AS b, bool_or(family = '5-LOW') AS c FROM m GROUP BY read)
SELECT r.read, coalesce(a, false) AS "in_1-URGENT", coalesce(b, false) AS "in_2-HIGH", coalesce(c, false) AS "in_5-LOW", coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false) AS any_track FROM r LEFT JOIN x USING (read)""")
def j15_track_flags(spark, d):
    f = features(spark, d).withColumnRenamed("family", "track")
    return I.track_flags(alignments(spark, d), f, "read", TRACKS, {"any_track": TRACKS}).select("read", *(f"in_{t}" for t in TRACKS), "any_track")


@query(f"""WITH {BASE}, c AS (SELECT gene, count(*) AS n, sum(least("end", f_end) - greatest(start, f_start)) AS b FROM m GROUP BY gene), days AS (SELECT gene, count(DISTINCT g) AS w FROM m, unnest(range(greatest(start, f_start), least("end", f_end))) t(g) GROUP BY gene)
SELECT gene, coalesce(n, 0) AS n_reads, coalesce(w, 0)::BIGINT AS covered, round(coalesce(b, 0) / (f_end - f_start), 6) AS mean_depth FROM f LEFT JOIN c USING (gene) LEFT JOIN days USING (gene)""")
def j16_coverage(spark, d):
    return rounded(I.coverage(features(spark, d), alignments(spark, d), "gene").drop("contig", "f_start", "f_end"), "mean_depth")


@query(f"""WITH {BASE}, c AS (SELECT gene, count(*) AS n, sum(least("end", f_end) - greatest(start, f_start)) AS b FROM m GROUP BY gene), days AS (SELECT gene, count(DISTINCT g) AS w FROM m, unnest(range(greatest(start, f_start), least("end", f_end))) t(g) GROUP BY gene),
i AS (SELECT coalesce(avg("end" - start), 500) AS insert FROM r WHERE flag & 2 <> 0 AND flag & 64 <> 0 AND flag & 256 = 0)
SELECT contig, coalesce(sum(n), 0)::BIGINT AS count, round(avg(coalesce(w, 0)), 6) AS effective_length, round(avg(coalesce(b, 0) / (f_end - f_start)), 6) AS coverage, round(any_value(insert), 6) AS insert FROM f LEFT JOIN c USING (gene) LEFT JOIN days USING (gene), i GROUP BY contig""")
def j16_element_coverage(spark, d):
    """Per contig, which many features share as their key."""
    r = alignments(spark, d).withColumn("tlen", F.when(F.col("strand") == "-", F.col("start") - F.col("end")).otherwise(F.col("end") - F.col("start")))
    f = features(spark, d).withColumn("element", F.col("contig"))
    out = I.element_coverage(f, r, "element").crossJoin(I.mean_insert(r)).withColumnRenamed("element", "contig")
    return rounded(out, "effective_length", "coverage", "insert")


@query(f"WITH {BASE}, q AS (SELECT qname, count(*) AS n FROM r GROUP BY qname) SELECT gene, round(sum(1.0 / n), 6) AS count FROM m JOIN q USING (qname) GROUP BY gene")
def j17_fractional_counts(spark, d):
    return rounded(I.fractional_counts(alignments(spark, d), features(spark, d), "gene"), "count")


@query(f"WITH {BASE} SELECT gene, count(*) AS count FROM m GROUP BY gene")
def j18_all_counts(spark, d):
    return I.all_counts(alignments(spark, d), features(spark, d), "gene")


@query(f"""WITH {BASE} SELECT contig, count(*) FILTER (WHERE family = '1-URGENT') AS "1-URGENT", count(*) FILTER (WHERE family = '2-HIGH') AS "2-HIGH", count(*) FILTER (WHERE family = '5-LOW') AS "5-LOW" FROM f GROUP BY contig""")
def a32_annotation_density(spark, d):
    return I.annotation_density(features(spark, d), "family", TRACKS)


STRANDED = """b AS (SELECT contig, start // 100 AS bin, count(*) AS n, avg((flag & 16 = 0)::INT) AS fw FROM r WHERE flag & 64 <> 0 AND flag & 256 = 0 GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"""WITH {BASE}, {STRANDED},
s AS (SELECT count(*) AS n_bins, avg(fw) AS mean, stddev_pop(fw) AS sd, avg((fw BETWEEN 0.4 AND 0.6)::INT) AS central, avg((fw <= 0.15 OR fw >= 0.85)::INT) AS extreme FROM b)
SELECT n_bins, round(mean, 6) AS mean, round(sd, 6) AS sd, round(central, 6) AS central, round(extreme, 6) AS extreme, CASE WHEN central > 0.80 AND extreme < 0.05 THEN 'unstranded' WHEN extreme > 0.30 THEN 'stranded' ELSE 'ambiguous' END AS verdict FROM s""")
def a43_strandedness(spark, d):
    return rounded(I.strandedness(alignments(spark, d), 100, 2), "mean", "sd", "central", "extreme")


@query(f"""WITH {BASE}, {STRANDED}, t AS (SELECT range AS bucket FROM range(10))
SELECT bucket::INT AS bucket, count(fw) AS n FROM t LEFT JOIN b ON bucket = least(floor(fw * 10), 9) GROUP BY bucket""")
def a43_strand_histogram(spark, d):
    return I.strand_histogram(alignments(spark, d), 100, 2)


@query(f"""WITH {BASE}, k AS (SELECT read, CASE WHEN family = '1-URGENT' THEN 'L1HS' WHEN family = '2-HIGH' THEN 'L1PA2' WHEN family = '3-MEDIUM' THEN 'L1PA' WHEN family = '5-LOW' THEN 'NEGATIVE' ELSE 'LINE/L1' END AS c FROM m)
SELECT read, round(count(*) FILTER (WHERE c = 'L1HS') / count(*), 6) AS L1HS, (count(*) FILTER (WHERE c = 'L1PA'))::DOUBLE AS L1PA, round(count(*) FILTER (WHERE c = 'NEGATIVE') / count(*), 6) AS NEGATIVE FROM k GROUP BY read""")
def a18_membership_fractions(spark, d):
    fam = F.col("family")
    f = features(spark, d).withColumn("target", F.when(fam == "1-URGENT", "L1HS").when(fam == "2-HIGH", "L1PA2").when(fam == "3-MEDIUM", "L1PA7").otherwise("x")).withColumn("family", F.when(fam == "5-LOW", "SINE").otherwise("LINE/L1"))
    return rounded(I.membership_fractions(alignments(spark, d), f, "read", ["L1HS", "L1PA", "NEGATIVE"], ["L1HS", "NEGATIVE"]), "L1HS", "NEGATIVE")


@query("""WITH s AS (SELECT 'd' || doc_id AS contig, regexp_replace(upper(text), '[^ACTG]', '', 'g') AS seq FROM documents), iv AS (SELECT contig, length(seq) // 3 AS a, length(seq) // 3 + length(seq) // 2 AS b, CASE WHEN length(seq) % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, (length(seq) // 3 + 1)::INT, (length(seq) // 2)::INT) AS part FROM s)
SELECT contig, CASE WHEN strand = '-' THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS seq FROM iv WHERE a < b""")
def p21_subsequences(spark, d):
    from helixmill.functions.seq import standardize

    s = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("contig"), standardize(F.col("text")).alias("seq"))
    n = F.length("seq")
    iv = s.select(F.col("contig"), F.floor(n / 3).alias("start"), (F.floor(n / 3) + F.floor(n / 2)).alias("end"), F.when(n % 2 == 0, "+").otherwise("-").alias("strand"))
    tiles = s.where(n > 0).select("contig", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int"))).alias("tile"), "seq").withColumn("seq", F.expr("substring(seq, tile * 256 + 1, 256)"))
    return I.subsequences(tiles, iv, "contig", 256)
