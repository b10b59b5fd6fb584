"""Sources and sinks, there and back: rows of the given tables are written in a file format to the shared folder and read by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import seq as S
from helixmill.plans.q_streams import shared_folder
from helixmill.plans.registry import query, table
from helixmill.sources import fastx as X
from helixmill.sources import tables as T

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
SEQ = f"translate(md5(o_orderkey::VARCHAR), '{HEX}', '{BASES}')"
SPAN = "l_orderkey * 10 + l_linenumber AS r, 'chr' || (l_partkey % 22 + 1) AS contig, (l_suppkey * 7)::BIGINT AS start, (l_suppkey * 7 + 10 + l_quantity)::BIGINT AS \"end\", CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand"


def written(spark, rows, *parts, sep="\t"):
    """A folder with a line for each row: the parts between separators."""
    path = shared_folder(spark)
    rows.select(F.concat_ws(sep, *(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("value")).write.text(path)
    return path


def as_csv(spark, rows, sep="\t"):
    path = shared_folder(spark)
    rows.write.csv(path, sep=sep, header=True)
    return path


def orders(spark, d):
    return table(spark, d, "orders").withColumn("seq", F.translate(F.md5(F.col("o_orderkey").cast("string")), HEX, BASES)).withColumn("id", F.concat(F.lit("o"), "o_orderkey"))


def spans(spark, d):
    x = table(spark, d, "lineitem")
    start = (F.col("l_suppkey") * 7).cast("bigint")
    return x.select("*", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"), F.concat(F.lit("chr"), F.col("l_partkey") % 22 + 1).alias("contig"), start.alias("start"), (start + 10 + F.col("l_quantity").cast("bigint")).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))


@query(f"SELECT 'o' || o_orderkey AS id, {SEQ} AS seq FROM orders")
def s01_fasta(spark, d):
    return X.read_fastx(spark, written(spark, orders(spark, d), F.concat(F.lit(">"), "id", F.lit(" more")), F.substring("seq", 1, 20), F.substring("seq", 21, 12), sep="\n"), kind="fasta").select("id", "seq")


@query(f"SELECT 'o' || o_orderkey AS read_id, {SEQ} AS r1, translate({SEQ}, 'ACGT', 'TGCA') AS r2 FROM orders")
def s02_read_pairs(spark, d):
    o = orders(spark, d)
    mate = lambda n, s: X.read_fastx(spark, written(spark, o, F.concat(F.lit("@"), "id", F.lit(f"/{n}")), s, "+", F.repeat(F.lit("I"), 32), sep="\n"), kind="fastq")
    return X.read_pairs(mate(1, F.col("seq")), mate(2, F.translate("seq", "ACGT", "tgca")))


@query(f"SELECT r::VARCHAR AS qname, (l_linenumber * 16)::INT AS flag, contig, start, (start + l_quantity + 5)::BIGINT AS \"end\" FROM (SELECT *, {SPAN} FROM lineitem) WHERE l_linenumber < 6")
def s03_sam(spark, d):
    cigar = F.concat("q", F.lit("M2D3N1I4S"))
    x = spans(spark, d).withColumn("q", F.col("l_quantity").cast("int"))
    head = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("@CO\tx\n"), "r")).otherwise(F.col("r").cast("string"))
    path = written(spark, x, head, F.col("l_linenumber") * 16, F.col("contig"), F.col("start") + 1, "60", cigar, "*", "0", "0", F.when(F.col("l_linenumber") < 6, "ACGT").otherwise("*"), "IIII")
    return T.read_sam(spark, path).select("qname", "flag", "contig", "start", "end")


@query(f"SELECT contig, start, \"end\", strand, 'L1-' || l_linenumber AS name, CASE WHEN l_linenumber < 4 THEN 'LINE/L1' ELSE 'SINE/Alu' END AS family, l_linenumber::DOUBLE AS div FROM (SELECT *, {SPAN} FROM lineitem)")
def s04_repeatmasker(spark, d):
    x = spans(spark, d)
    line = F.concat(F.lit("   "), "l_linenumber")
    path = written(spark, x, line, F.col("l_linenumber").cast("double"), "0.0", "0.0", F.col("contig"), F.col("start") + 1, F.col("end"), "(9)", F.when(F.col("strand") == "-", "C").otherwise("+"), F.concat(F.lit("L1-"), "l_linenumber"), F.when(F.col("l_linenumber") < 4, "LINE/L1").otherwise("SINE/Alu"), "1", "2", "(0)", F.when(F.col("l_linenumber") == 1, "1\n\n SW perc").otherwise("1"), sep=" ")
    return T.read_rmout(spark, path).select("contig", "start", "end", "strand", "name", "family", "div")


@query(f"SELECT contig, start, \"end\", r::VARCHAR AS uid, strand, 't' AS track, \"end\" - start - 5 AS element_bp FROM (SELECT *, {SPAN} FROM lineitem) WHERE \"end\" - start - 5 > 20")
def s05_bed(spark, d):
    first = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("track name=x\n"), "contig")).otherwise(F.col("contig"))
    return T.read_bed(spark, written(spark, spans(spark, d), first, F.col("start"), F.col("end"), F.col("r"), "0", F.col("strand")), "t", 5, 20)


@query(f"SELECT contig, start, \"end\", strand, CASE l_linenumber % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'I' ELSE 'N' END || l_linenumber AS subfamily FROM (SELECT *, {SPAN} FROM lineitem)")
def s06_gff(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_linenumber") % 3
    attributes = F.when(k == 0, F.concat(F.lit('Target "Motif:T'), n, F.lit('" 1 2'))).when(k == 1, F.concat(F.lit("x=1;ID=I"), n, F.lit(";y=2"))).otherwise(F.concat(F.lit("Name=N"), n))
    return T.read_gff(spark, written(spark, spans(spark, d), F.col("contig"), "a", "b", F.col("start") + 1, F.col("end"), ".", F.col("strand"), ".", attributes)).select("contig", "start", "end", "strand", "subfamily")


def feature_table(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("T"), "p_size", F.lit(".c.r"), "p_partkey", F.lit(".+"))
    return T.read_feature_counts(spark, as_csv(spark, p.select(name.alias("Geneid"), *(F.lit(0).alias(c) for c in ("Chr", "Start", "End", "Strand", "Length")), F.col("p_size").alias("a.bam"), (F.col("p_partkey") % 50).alias("b.bam"))))


@query("SELECT 'T' || p_size || '.c.r' || p_partkey || '.+' AS geneid, 'T' || p_size AS target, 'c' AS category, 'r' || p_partkey AS region, '+' AS strand, l AS library, CASE l WHEN 'a.bam' THEN p_size ELSE p_partkey % 50 END::DOUBLE AS count FROM part, (VALUES ('a.bam'), ('b.bam')) v(l)")
def s07_feature_counts(spark, d):
    return feature_table(spark, d)


@query("SELECT 'UID-' || p_partkey AS name, p_size::DOUBLE AS efflen, (p_partkey % 50)::DOUBLE AS value FROM part")
def s08_quant(spark, d):
    p = table(spark, d, "part")
    return T.read_quant(spark, as_csv(spark, p.select(F.concat(F.lit("UID-"), "p_partkey").alias("Name"), F.lit(9).alias("Length"), F.col("p_size").alias("EffectiveLength"), F.lit(0).alias("TPM"), (F.col("p_partkey") % 50).alias("NumReads"))), "NumReads")


@query("SELECT 'UID' || c_nationkey AS uid, sum(c_custkey % 7 + 1)::DOUBLE AS value FROM customer GROUP BY ALL")
def s09_em_counts(spark, d):
    c = table(spark, d, "customer")
    return T.read_em_counts(spark, as_csv(spark, c.select(F.concat(F.lit("UID-"), "c_nationkey").alias("name"), (F.col("c_custkey") % 7).alias("only"), F.lit(1).alias("3prunon"), F.lit(5).alias("other"))))


@query("SELECT 'UID' || c_nationkey AS uid, sum(c_custkey % 7)::DOUBLE AS value FROM customer GROUP BY ALL")
def s10_te_counts(spark, d):
    name = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit('GENE\t1\n__none\t2\n"UID-'), "c_nationkey", F.lit('"'))).otherwise(F.concat(F.lit("UID-"), "c_nationkey"))
    return T.read_te_counts(spark, written(spark, table(spark, d, "customer"), name, F.col("c_custkey") % 7))


PAF = "l_orderkey AS q, l_linenumber AS n, 100 AS qlen, (l_partkey % 50) AS a, 60 AS b, (l_suppkey % 90 + 10) AS m"


@query(f"WITH p AS (SELECT {PAF} FROM lineitem), s AS (SELECT *, m / 100 * ((60 - a) / 100) AS score FROM p) SELECT 'q' || q AS qname, round(max(score), 9) AS score FROM s GROUP BY q")
def s11_best_hits(spark, d):
    x = table(spark, d, "lineitem")
    path = written(spark, x, F.concat(F.lit("q"), "l_orderkey"), "100", F.col("l_partkey") % 50, "60", "+", "L1", "6000", F.when(F.col("l_linenumber") > 0, 100), "200", F.col("l_suppkey") % 90 + 10, "100", "60")
    return T.best_hits(T.read_paf(spark, path)).select("qname", F.round(F.col("identity") * F.col("aligned_frac"), 9).alias("score"))


@query(f"SELECT substr({SEQ}, 1, 12) AS kmer, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 1 END::BIGINT AS count FROM orders")
def s12_kmer_dump(spark, d):
    return T.read_kmer_dump(spark, written(spark, orders(spark, d), F.substring("seq", 1, 12), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.lit(None)), sep=" "))


@query("SELECT 's' || s_suppkey AS contig, s_suppkey::BIGINT AS length, 'NC_' || s_suppkey AS accession FROM supplier WHERE s_suppkey % 5 <> 0")
def s13_sizes_and_names(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("s"), "s_suppkey")
    sizes = T.read_sizes(spark, written(spark, s, name, F.col("s_suppkey")))
    report = T.read_assembly_names(spark, written(spark, s, *["a"] * 6, F.when(F.col("s_suppkey") % 5 == 0, "na").otherwise(F.concat(F.lit("NC_"), "s_suppkey")), "b", "c", name))
    return sizes.join(report, sizes["contig"] == report["name"]).select("contig", "length", "accession")


@query(f"SELECT contig, start, \"end\", 'L1' AS family, l_linenumber::VARCHAR AS category, 'r' || r AS region, strand FROM (SELECT *, {SPAN} FROM lineitem)")
def s14_named_bed(spark, d):
    name = F.concat(F.lit("L1."), "l_linenumber", F.lit(".r"), "r", F.lit("."), "strand")
    return T.read_named_bed(spark, written(spark, spans(spark, d), F.col("contig"), F.col("start"), F.col("end"), name, "0", F.col("strand")))


@query("SELECT o_orderkey::VARCHAR AS id, (o_custkey % 8 / 8)::DOUBLE AS A, (o_orderkey % 4 / 4)::DOUBLE AS B FROM orders")
def s15_scores(spark, d):
    path = shared_folder(spark)
    T.write_scores(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 8 / 8).alias("A"), (F.col("o_orderkey") % 4 / 4).alias("B")), path, "o_orderkey", ["A", "B"])
    return spark.read.parquet(path).select("id", F.col("A").cast("double"), F.col("B").cast("double"))


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, n::VARCHAR AS n FROM (SELECT n_nationkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)")
def s16_result_table(spark, d):
    path = shared_folder(spark)
    t = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    T.write_table(t, path, ["key"])
    return spark.read.csv(f"{path}/csv", header=True)


@query("SELECT 'N' || l_linenumber AS subfamily, count(*) AS n FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL")
def s17_split_export(spark, d):
    path = shared_folder(spark)
    gff = T.read_gff(spark, written(spark, spans(spark, d), F.col("contig"), "a", "b", F.col("start"), F.col("end"), ".", "+", ".", F.concat(F.lit("ID=N"), "l_linenumber")))
    T.write_split_gff(gff, path, "^N[1-4]$")
    return spark.read.text(path).groupBy("subfamily").agg(F.count("*").alias("n"))


@query(f"SELECT 'o' || o_orderkey || '/' || m || '|' || o_orderstatus AS id, CASE m WHEN 1 THEN {SEQ} ELSE translate({SEQ}, 'ACGT', 'TGCA') END AS seq FROM orders, (VALUES (1), (2)) v(m) WHERE o_orderkey % 3 = 0")
def s18_labelled_reads(spark, d):
    o = orders(spark, d)
    pairs = o.select(F.col("id").alias("read_id"), F.col("seq").alias("r1"), F.translate("seq", "ACGT", "TGCA").alias("r2"))
    labels = o.where("o_orderkey % 3 = 0").select(F.col("id").alias("read_id"), F.col("o_orderstatus").alias("label"))
    return X.read_fastx(spark, written(spark, T.labelled_fasta(pairs, labels), F.col("value")), kind="fasta").select("id", "seq")


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def s19_manifest(spark, d):
    path = shared_folder(spark)
    T.manifest({n: table(spark, d, n) for n in ("orders", "part")}, {"seed": 1}, path, spark)
    entry = F.from_json("tables", "map<string, struct<rows: bigint, fingerprint: bigint>>")
    return spark.read.json(path).select(F.explode(entry).alias("name", "v")).select("name", "v.rows")


@query("SELECT (o_orderkey % 5)::INT AS label, (o_custkey % 8 / 8)::DOUBLE AS first, count(*) AS n FROM orders GROUP BY ALL")
def s20_logits(spark, d):
    path = shared_folder(spark)
    T.write_logits(table(spark, d, "orders").select(F.array(F.col("o_custkey") % 8 / 8, F.lit(0.5)).alias("logits"), (F.col("o_orderkey") % 5).alias("label")), path)
    return spark.read.parquet(path).groupBy("label", F.get("logits", F.lit(0)).alias("first")).agg(F.count("*").alias("n"))


@query("SELECT 'UID' || o_orderkey AS l1_id, o_custkey::BIGINT AS count, '0.8' AS power, '0.1' AS delprob FROM orders")
def s21_truth(spark, d):
    path = f"{shared_folder(spark)}/power_0.8_delprob_0.1"
    table(spark, d, "orders").select(F.concat_ws("\t", F.concat(F.lit("UID"), "o_orderkey"), "o_custkey").alias("value")).write.text(path)
    return T.read_truth(spark, path)


@query("SELECT o_orderpriority AS split, 's' || s AS class, (1000000 + s * 1000 + count(*))::BIGINT AS n FROM orders, (VALUES (1), (2)) v(s) GROUP BY o_orderpriority, s")
def s22_composition(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("split")).agg(F.count("*").alias("c"))
    return T.read_composition(spark, as_csv(spark, n.select("split", *(F.format_number(1_000_000 + 1000 * s + F.col("c"), 0).alias(f"s{s}") for s in (1, 2))), ","))


@query("SELECT CASE l WHEN 'a.bam' THEN 'x' ELSE 'y' END AS arm, 'T' || p_size || '.c.r' || p_partkey || '.+' AS \"Geneid\", CASE l WHEN 'a.bam' THEN p_size ELSE p_partkey % 50 END::DOUBLE AS count FROM part, (VALUES ('a.bam'), ('b.bam')) v(l)")
def s23_arms(spark, d):
    path = shared_folder(spark)
    arms = spark.createDataFrame([("a.bam", "x"), ("b.bam", "y")], "library string, arm string")
    T.write_arms(T.arm_tables(feature_table(spark, d), arms), path)
    return spark.read.csv(path, sep="\t", header=True).select("arm", "Geneid", F.col("count").cast("double"))


@query(f"SELECT r, (start + CASE WHEN strand = '+' THEN 1 ELSE -1 END * (l_linenumber + 17 / 2 - l_quantity / 2))::DOUBLE AS position FROM (SELECT *, {SPAN} FROM lineitem)")
def p25_kmer_positions(spark, d):
    x = spans(spark, d)
    return x.select("r", S.kmer_position(F.col("start"), F.col("strand"), F.col("l_linenumber"), 17, F.col("l_quantity").cast("double")).cast("double").alias("position"))


@query("SELECT l_orderkey * 10 + l_linenumber AS r, CASE WHEN l_linenumber = 7 OR l_discount < 0.03 OR l_tax < 0.02 THEN 'NEGATIVE' ELSE 'L1HS' END AS task_class, CASE WHEN l_linenumber = 7 OR l_discount < 0.03 OR l_tax < 0.02 THEN 'NEGATIVE' ELSE 'L1HS' END AS subfamily FROM lineitem")
def p27_sequence_labels(spark, d):
    x = table(spark, d, "lineitem")
    hit = F.when(F.col("l_linenumber") < 7, F.struct(F.col("l_discount").cast("double").alias("identity"), F.col("l_tax").cast("double").alias("aligned_frac"), F.lit("L1HS#LINE/L1 x").alias("target")))
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"), S.sequence_label(hit, 0.03, 0.02).alias("s")).select("r", "s.*")
