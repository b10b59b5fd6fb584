"""Queries on labels, splits and samples. Labelled documents stand for reads, their source for the transcript."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import seq as S
from helixmill.operators import labels as L
from helixmill.operators.thinning import thinned
from helixmill.plans.q_kmers import rounded, unif
from helixmill.plans.registry import query, table

IDS = """ids AS (SELECT d.doc_id, d.source, CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'L1HS' WHEN quality = 0 THEN 'L1PA' || (d.doc_id % 9) ELSE 'L1ME3' END AS sub,
'ENST' || d.source || '|f' || (d.doc_id // 3) || '/' || (1 + d.doc_id % 2) || '|' || sub || '-9' AS id, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
cl AS (SELECT *, CASE WHEN sub = 'NEGATIVE' THEN 'NEGATIVE' WHEN sub LIKE 'L1HS%' THEN 'L1HS' WHEN sub LIKE 'L1P%' THEN 'L1PA' ELSE 'OTHER' END AS label, 'ENST' || source || '|f' || (doc_id // 3) AS frag FROM ids)"""


def ids(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    sub = F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "L1HS").when(F.col("quality") == 0, F.concat(F.lit("L1PA"), F.col("doc_id") % 9)).otherwise("L1ME3")
    x = x.withColumn("sub", sub)
    return x.select("doc_id", "source", "n_chars", "sub", F.concat(F.lit("ENST"), "source", F.lit("|f"), F.floor(F.col("doc_id") / 3), F.lit("/"), 1 + F.col("doc_id") % 2, F.lit("|"), "sub", F.lit("-9")).alias("id"))


def classed(spark, d):
    return ids(spark, d).withColumns({"label": S.task_label(F.col("id")), "frag": S.fragment_key(F.col("id"))})


@query(f"WITH {IDS} SELECT doc_id, id, sub AS raw, label, 'ENST' || source AS transcript, frag, 'ENST' || source || '|f' || (doc_id // 3) || '|' || sub || '-9' AS mate FROM cl")
def p09_p10_record_ids(spark, d):
    i = F.col("id")
    return ids(spark, d).select("doc_id", "id", S.raw_label(i).alias("raw"), S.task_label(i).alias("label"), S.transcript_id(i).alias("transcript"), S.fragment_key(i).alias("frag"), S.mate_key(i).alias("mate"))


@query(f"""WITH {IDS} SELECT sub, CASE WHEN sub = 'L1HS' THEN 0 WHEN sub LIKE 'L1PA%' THEN 1 WHEN sub = 'NEGATIVE' THEN 9 ELSE 5 END AS era, CASE WHEN sub LIKE 'L1PA%' THEN 1 ELSE 0 END AS number,
CASE WHEN sub = 'NEGATIVE' THEN 'NEGATIVE' WHEN sub = 'L1HS' THEN 'L1HS (young)' WHEN sub IN ('L1PA2', 'L1PA3', 'L1PA4', 'L1PA5', 'L1PA6') THEN 'L1PA2-6 (young)' WHEN sub LIKE 'L1P%' THEN 'L1PA7+/L1P (older)' ELSE 'L1M*/L1ME* (old)' END AS grp, count(*) AS n FROM ids GROUP BY ALL""")
def p11_age_groups(spark, d):
    x = ids(spark, d).groupBy("sub").agg(F.count("*").alias("n")).withColumn("r", S.age_rank(F.col("sub")))
    return x.select("sub", "r.era", "r.number", S.display_group(F.col("sub")).alias("grp"), "n")


@query("SELECT o_orderkey, 'chr' || (o_custkey % 30) AS chrom, o_custkey AS start, o_custkey + 7 AS \"end\", CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'UID' || (o_orderkey % 50) AS uid FROM orders")
def p12_regions(spark, d):
    o = table(spark, d, "orders")
    region = F.concat(F.lit("chr"), F.col("o_custkey") % 30, F.lit(":"), "o_custkey", F.lit("-"), F.col("o_custkey") + 7, F.lit("("), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"), F.lit(")"))
    x = o.select("o_orderkey", S.parse_region(region).alias("r"), S.uid(F.concat(F.lit("UID-"), F.col("o_orderkey") % 50, F.lit(".x:1-2"))).alias("uid"))
    return x.select("o_orderkey", "r.*", "uid")


CHROM = "CASE WHEN n_nationkey < 23 THEN 'chr' || n_nationkey WHEN n_nationkey = 23 THEN 'chrX' ELSE 'chrUn_KI270' END"


@query(f"SELECT {CHROM} AS chrom, n_nationkey BETWEEN 1 AND 23 AS primary_chrom, CASE WHEN n_nationkey < 23 THEN n_nationkey WHEN n_nationkey = 23 THEN 23 ELSE 26 END AS chrom_order FROM nation")
def p13_t01_chromosomes(spark, d):
    n = F.col("n_nationkey")
    c = table(spark, d, "nation").select(F.when(n < 23, F.concat(F.lit("chr"), n)).when(n == 23, "chrX").otherwise("chrUn_KI270").alias("chrom"))
    return c.select("chrom", S.is_primary(F.col("chrom")).alias("primary_chrom"), S.chrom_order(F.col("chrom")).alias("chrom_order")).orderBy("chrom_order")


@query("""SELECT l_partkey % 6300 AS pos, CASE WHEN pos BETWEEN 1 AND 909 THEN '5UTR' WHEN pos BETWEEN 910 AND 1923 THEN 'ORF1' WHEN pos BETWEEN 1924 AND 1990 THEN 'interORF' WHEN pos BETWEEN 1991 AND 2730 THEN 'ORF2_EN' WHEN pos BETWEEN 2731 AND 3399 THEN 'ORF2_mid' WHEN pos BETWEEN 3400 AND 4350 THEN 'ORF2_RT' WHEN pos BETWEEN 4351 AND 5814 THEN 'ORF2_C' WHEN pos BETWEEN 5815 AND 6100 THEN '3UTR' ELSE 'outside' END AS region,
CASE WHEN pos BETWEEN 235 AND 450 THEN 'ORF0' ELSE '' END AS nested, count(*) AS n FROM lineitem GROUP BY ALL""")
def p14_consensus_regions(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_partkey") % 6300).alias("pos"))
    return x.groupBy("pos", S.consensus_region(F.col("pos")).alias("region"), F.array_join(S.nested_regions(F.col("pos")), ",").alias("nested")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name AS contig FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def p15_renamed_contigs(spark, d):
    names = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("contig"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(names), "c_nationkey").select("c_custkey", "contig")


ORDER = ["L1HS", "L1PA", "NEGATIVE"]
RANK = "CASE label WHEN 'L1HS' THEN 0 WHEN 'L1PA' THEN 1 WHEN 'NEGATIVE' THEN 2 ELSE 3 END"


@query(f"WITH {IDS} SELECT frag, arg_min(label, ({RANK})::BIGINT * 1000000000 + doc_id) AS label FROM cl GROUP BY frag")
def a11_best_label(spark, d):
    return L.best_label(classed(spark, d), "frag", "label", ORDER, "doc_id")


DOM = f"{IDS}, c AS (SELECT source, label, count(*) AS n, min(doc_id) AS f FROM cl GROUP BY ALL), dom AS (SELECT source, arg_max(label, n * 1000000000 - f) AS label FROM c GROUP BY source)"


@query(f"WITH {DOM} SELECT * FROM dom")
def a12_dominant_label(spark, d):
    return L.dominant_label(classed(spark, d), "source", "label", "doc_id")


@query(f"WITH {IDS} SELECT doc_id, sub FROM ids WHERE sub IN (SELECT sub FROM ids GROUP BY sub HAVING count(*) >= 40)")
def a13_frequent_classes(spark, d):
    return L.frequent_classes(ids(spark, d), "sub", 40).select("doc_id", "sub")


@query(f"WITH {IDS}, c AS (SELECT sub, count(*) AS n FROM ids GROUP BY sub) SELECT sub, n, quantile_cont(n, 0.25) OVER () AS q25, quantile_cont(n, 0.5) OVER () AS q50, quantile_cont(n, 0.75) OVER () AS q75 FROM c")
def a14_label_histogram(spark, d):
    counts, q = L.label_histogram(ids(spark, d), "sub")
    return counts.crossJoin(F.broadcast(q))


@query(f"WITH {IDS}, g AS (SELECT unnest(['L1HS', 'L1PA', 'NEGATIVE', 'ABSENT']) AS label), c AS (SELECT label, count(doc_id) AS n FROM g LEFT JOIN cl USING (label) GROUP BY label) SELECT label, n, round(coalesce(sum(n) OVER () / (4 * nullif(n, 0)), 0), 6) AS weight, round(max(n) OVER () / nullif(n, 0), 6) AS imbalance FROM c")
def a36_class_weights(spark, d):
    return rounded(L.class_weights(classed(spark, d).where("label <> 'OTHER'"), "label", [*ORDER, "ABSENT"]), "weight", "imbalance")


@query(f"""WITH {IDS}, s AS (SELECT frag, min({RANK}) AS r FROM cl WHERE doc_id % 5 < 2 GROUP BY frag), c AS (SELECT DISTINCT frag FROM cl WHERE doc_id % 5 = 4), e AS (SELECT DISTINCT frag FROM cl),
x AS (SELECT e.frag, CASE WHEN r = 0 THEN 'L1HS' WHEN r = 1 THEN 'L1PA' WHEN r = 2 THEN 'NEGATIVE' WHEN r = 3 THEN 'OTHER' WHEN c.frag IS NOT NULL THEN 'NEGATIVE' ELSE 'DROP' END AS label FROM e LEFT JOIN s USING (frag) LEFT JOIN c USING (frag)) SELECT * FROM x WHERE label NOT IN ('OTHER', 'DROP')""")
def j04_fragment_classes(spark, d):
    x = classed(spark, d)
    return L.fragment_classes(x.where("doc_id % 5 < 2"), x.where("doc_id % 5 = 4"), x.select("frag").distinct(), "frag", "sub")


@query(f"WITH {IDS} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def j10_semi_join(spark, d):
    return L.keep_ids(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("toxic = 0"), "doc_id")


@query(f"""WITH {DOM}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {unif('source', "'11'")}, source) AS i, count(*) OVER (PARTITION BY label) AS n FROM dom),
a AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS t, greatest(1, round_even(n * 0.1, 0)) AS v FROM k),
b AS (SELECT source, i, CASE WHEN n - t - v >= 1 THEN t WHEN n >= 2 THEN 1 ELSE 0 END AS t2, CASE WHEN n - t - v >= 1 THEN v WHEN n >= 3 THEN 1 ELSE 0 END AS v2 FROM a)
SELECT doc_id, source, CASE WHEN i <= t2 THEN 'test' WHEN i <= t2 + v2 THEN 'eval' ELSE 'train' END AS split FROM cl JOIN b USING (source)""")
def x01_group_split(spark, d):
    return L.group_split(classed(spark, d), "source", "label", "doc_id", 0.2, 0.1, "11").select("doc_id", "source", "split")


def rk(part: str, seed: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {unif('doc_id::VARCHAR', repr(seed))}, doc_id) AS i, count(*) OVER ({p}) AS n"


@query(f"WITH {IDS}, k AS (SELECT *, {rk('label', '3')} FROM cl) SELECT doc_id, CASE WHEN i <= round_even(n * 0.25, 0) THEN 'test' ELSE 'train' END AS split FROM k")
def x02_row_split(spark, d):
    return L.row_split(classed(spark, d), "doc_id", "label", 0.25, "3").select("doc_id", "split")


@query(f"WITH {IDS}, k AS (SELECT *, {rk('label', '4')} FROM cl) SELECT doc_id, label FROM k WHERE i <= 25")
def x04_capped(spark, d):
    return L.capped(classed(spark, d), "doc_id", "label", 25, "4").select("doc_id", "label")


@query(f"""WITH {IDS}, p AS (SELECT * FROM (VALUES ('NEGATIVE', 0.2::DOUBLE), ('L1PA', 0.5), ('L1HS', 0.3)) t(label, p)), s AS (SELECT min(c / p) AS s FROM (SELECT label, count(*) AS c FROM cl GROUP BY label) JOIN p USING (label)),
k AS (SELECT cl.*, p, s, {rk('label', '5')} FROM cl JOIN p USING (label), s) SELECT doc_id, label FROM k WHERE i <= round_even(p * s, 0)""")
def x05_to_priors(spark, d):
    return L.to_priors(classed(spark, d), "doc_id", "label", {"NEGATIVE": 0.2, "L1PA": 0.5, "L1HS": 0.3}, "5").select("doc_id", "label")


@query(f"WITH {IDS}, k AS (SELECT *, {rk('label', '6')}, count(*) OVER () AS al FROM cl) SELECT doc_id, label FROM k WHERE i <= greatest(1, round_even(n * 100 / al, 0))")
def x06_same_mix(spark, d):
    return L.same_mix(classed(spark, d), "doc_id", "label", 100, "6").select("doc_id", "label")


@query(f"""WITH {IDS}, k AS (SELECT *, label = 'L1HS' AS pin, {unif('doc_id::VARCHAR', "'8'")} AS u FROM cl), s AS (SELECT *, sum(n_chars) OVER (PARTITION BY pin ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS c FROM k), f AS (SELECT * FROM s WHERE pin AND c <= 25000), z AS (SELECT coalesce(sum(n_chars), 0) AS used FROM f)
SELECT doc_id, n_chars FROM f UNION ALL SELECT doc_id, n_chars FROM s, z WHERE NOT pin AND (c + used <= 50000 OR (c = n_chars AND used = 0))""")
def x07_within_budget(spark, d):
    return L.within_budget(classed(spark, d), "doc_id", "n_chars", 50_000, F.col("label") == "L1HS", "8").select("doc_id", "n_chars")


#: The splitting tree in SQL: totals by the key's first md5 bits at each depth, the left half's share by summed probabilities. Each of the languages is alone in its range.
TREE = f"""c AS (SELECT lang, count(*) AS n, ('0x' || substr(md5(lang), 1, 3))::INT AS bits FROM documents GROUP BY lang), node AS (SELECT d AS depth, bits >> (12 - d) AS spot, sum(n)::BIGINT AS n FROM c, unnest(range(13)) t(d) GROUP BY ALL),
split AS (SELECT p.depth, p.spot, p.n, coalesce(l.n, 0)::BIGINT AS k, {unif('p.depth::VARCHAR', 'p.spot::VARCHAR', "'9'")} AS u FROM node p LEFT JOIN node l ON l.depth = p.depth + 1 AND l.spot = 2 * p.spot WHERE p.depth < 12),
cdf AS (SELECT depth, spot, t, j, sum(exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(n - k + 1) - lgamma(t - j + 1) - lgamma(n - k - t + j + 1) - lgamma(n + 1) + lgamma(t + 1) + lgamma(n - t + 1))) OVER (PARTITION BY depth, spot, t ORDER BY j) AS f FROM split, unnest(range(51)) s(t), unnest(range(greatest(0, k + t - n), least(k, t))) w(j) WHERE t <= n),
taken AS (SELECT s.depth, s.spot, t, greatest(0, k + t - n) + (SELECT count(*) FROM cdf WHERE cdf.depth = s.depth AND cdf.spot = s.spot AND cdf.t = r.t AND f <= u) AS x FROM split s, unnest(range(51)) r(t) WHERE t <= n),
walk AS (SELECT 0 AS depth, 0 AS spot, least(50, n) AS t FROM node WHERE depth = 0 UNION ALL SELECT w.depth + 1, 2 * w.spot + h, CASE WHEN h = 0 THEN x ELSE w.t - x END FROM walk w JOIN taken USING (depth, spot, t), unnest([0, 1]) y(h))"""


@query(f"WITH RECURSIVE {TREE} SELECT lang, coalesce(t, 0)::BIGINT AS n FROM c LEFT JOIN walk ON depth = 12 AND spot = bits")
def x08_thinned(spark, d):
    return thinned(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 50, "9")


@query(f"WITH k AS (SELECT doc_id, {rk('', '10')} FROM documents) SELECT doc_id, CASE WHEN i <= n // 2 THEN 'fit' ELSE 'report' END AS half FROM k")
def x09_halves(spark, d):
    return L.halves(table(spark, d, "documents").select("doc_id"), "doc_id", "10")


@query(f"SELECT doc_id FROM (SELECT doc_id, {unif('doc_id::VARCHAR', repr('12'))} AS u, count(*) OVER () AS n FROM documents) WHERE u < 60 / n")
def x10_depth_matched(spark, d):
    return L.depth_matched(table(spark, d, "documents").select("doc_id"), "doc_id", 60, "12")


@query("SELECT 'pos' AS kind, doc_id FROM labels WHERE toxic = 0 UNION ALL SELECT 'neg', doc_id FROM labels WHERE toxic = 1")
def u01_union(spark, d):
    x = table(spark, d, "labels")
    return x.where("toxic = 0").select(F.lit("pos").alias("kind"), "doc_id").unionByName(x.where("toxic = 1").select(F.lit("neg").alias("kind"), "doc_id"))


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def u02_unseen_labels(spark, d):
    x = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return x.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct().join(x.where("o_orderpriority = '2-HIGH'"), "o_custkey", "left_anti")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def u03_common_loci(spark, d):
    x = table(spark, d, "lineitem")
    of = lambda f: x.where(F.col("l_returnflag") == f).select("l_partkey")
    return of("A").intersect(of("R")).intersect(of("N"))


@query("(SELECT o_custkey, 'first' AS side FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, 'first' FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey, 'second' FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey, 'second' FROM orders WHERE o_orderstatus = 'F')")
def u04_set_difference(spark, d):
    x = table(spark, d, "orders")
    return L.symmetric_difference(x.where("o_orderstatus = 'F'").select("o_custkey"), x.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT DISTINCT lang, source FROM documents")
def u05_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").dropDuplicates()


@query("SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CASE WHEN a.conv_id IS NULL THEN 'second' ELSE 'first' END AS side FROM (SELECT conv_id FROM conversations WHERE turn = 2) a FULL JOIN (SELECT conv_id FROM conversations WHERE turn = 4) b ON a.conv_id = b.conv_id WHERE a.conv_id IS NULL OR b.conv_id IS NULL")
def q01_unpaired(spark, d):
    x = table(spark, d, "conversations")
    return L.unpaired(x.where("turn = 2"), x.where("turn = 4"), "conv_id")


@query("SELECT min(list_min(list_transform(string_split(text, ' '), lambda w: length(w))))::BIGINT AS min_id, max(list_max(list_transform(string_split(text, ' '), lambda w: length(w))))::BIGINT AS max_id, min(quality) AS min_label, max(quality) AS max_label, max(list_max(list_transform(string_split(text, ' '), lambda w: length(w)))) < 100 AS ok FROM documents JOIN labels USING (doc_id)")
def q02_id_range(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"), "quality")
    return L.id_range(x, "ids", "quality", 100, 2)


@query("SELECT source, count(DISTINCT lang) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def q03_leaks(spark, d):
    return L.leaks(table(spark, d, "documents"), "source", "lang")


@query("SELECT count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) AS discount, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS quantity FROM lineitem")
def q04_violations(spark, d):
    x = L.require_columns(table(spark, d, "lineitem"), ["l_discount", "l_quantity"])
    return L.violations(x, {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") > 0})


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q05_shared_contigs(spark, d):
    return L.shared_names(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 0 ELSE 1 END AS v FROM events) WHERE v > 0 GROUP BY event_type")
def q06_without_empty(spark, d):
    x = table(spark, d, "events").select("event_type")
    least = x.agg(F.min("event_type").alias("m"))
    v = x.crossJoin(F.broadcast(least)).select("event_type", F.when(F.col("event_type") == F.col("m"), 0).otherwise(1).alias("v"))
    return L.without_empty(v, "event_type", "v").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT s AS lang, count(doc_id) AS n FROM unnest(['en', 'fr', 'xx']) t(s) LEFT JOIN documents ON lang = s GROUP BY s")
def q07_split_counts(spark, d):
    return L.split_counts(table(spark, d, "documents"), ["en", "fr", "xx"], "lang")
