"""Readers and writers of alignment, annotation and abundance tables: text to typed columns, by Spark's own readers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.seq import is_primary, parse_locus_name


def _fields(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.text(path).select(F.split("value", sep).alias("f"), "value")


def _at(i: int, kind: str = "string") -> Column:
    return F.get("f", F.lit(i)).try_cast(kind)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, contig, pos (1-based), start and end (0-based half-open), mapq, cigar, tlen, seq; headers and records without a sequence go."""
    t = _fields(spark, path).where(~F.col("value").startswith("@") & (F.size("f") >= 11))
    out = t.select(_at(0).alias("qname"), _at(1, "int").alias("flag"), _at(2).alias("contig"), _at(3, "bigint").alias("pos"), _at(4, "int").alias("mapq"), _at(5).alias("cigar"), _at(8, "bigint").alias("tlen"), _at(9).alias("seq"), F.monotonically_increasing_id().alias("record_index"))
    used = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return out.where(F.col("seq") != "*").withColumns({"start": F.col("pos") - 1, "end": F.col("pos") - 1 + used})


def last_of_each(sam: DataFrame) -> DataFrame:
    """One sequence per query name, the last in the file."""
    return sam.groupBy("qname").agg(F.max_by("seq", "record_index").alias("seq"))


def read_rmout(spark: SparkSession, path: str, zero_based: bool = True) -> DataFrame:
    """contig, start, end, strand, name, family, div of a RepeatMasker table; lines whose numbers don't parse are its header."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    out = t.select(_at(4).alias("contig"), (_at(5, "bigint") - int(zero_based)).alias("start"), _at(6, "bigint").alias("end"), F.when(_at(8) == "C", "-").otherwise(_at(8)).alias("strand"), _at(9).alias("name"), _at(10).alias("family"), _at(1, "double").alias("div"))
    return out.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_bed(spark: SparkSession, path: str, track: str = "", flank: int = 0, least: int = 0) -> DataFrame:
    """contig, start, end, uid, strand, track, element_bp (less the flank); track lines and other contigs than chr* go, and elements of `least` bases or fewer."""
    t = _fields(spark, path).where(F.col("value").startswith("chr"))
    out = t.select(_at(0).alias("contig"), _at(1, "bigint").alias("start"), _at(2, "bigint").alias("end"), _at(3).alias("uid"), _at(5).alias("strand"), F.lit(track).alias("track"))
    out = out.where(F.col("end").isNotNull()).withColumn("element_bp", F.col("end") - F.col("start") - flank)
    return out.where(F.col("element_bp") > least) if least else out


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """contig, source, type, start (0-based), end, strand, attributes and subfamily (Target Motif, else ID, Name or family); short lines go."""
    t = _fields(spark, path).where(~F.col("value").startswith("#") & (F.size("f") >= 9))
    a = _at(8)
    some = lambda p: F.nullif(F.regexp_extract(a, p, 1), F.lit(""))
    sub = F.coalesce(some(r'Target[ =]"?(?:Motif:)?([^" ;]+)'), some(r"(?:^|;)\s*ID=([^;]+)"), some(r"(?:^|;)\s*Name=([^;]+)"), some(r"(?:^|;)\s*family=([^;]+)"))
    return t.select(_at(0).alias("contig"), _at(1).alias("source"), _at(2).alias("type"), (_at(3, "bigint") - 1).alias("start"), _at(4, "bigint").alias("end"), _at(6).alias("strand"), a.alias("attributes"), sub.alias("subfamily"), "value")


def read_feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """geneid, target, category, region, strand, library, count: one row for each count column."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#")
    libs = t.columns[6:]
    long = t.unpivot(["Geneid"], [f"`{c}`" for c in libs], "library", "count") if libs else t.select("Geneid", F.lit(None).cast("string").alias("library"), F.lit(None).cast("string").alias("count"))
    part = lambda i: F.regexp_extract("Geneid", r"^([^.]+)\.([^.]+)\.([^.]+)\.([^.]+)$", i)
    return long.select(F.col("Geneid").alias("geneid"), part(1).alias("target"), part(2).alias("category"), part(3).alias("region"), part(4).alias("strand"), "library", F.col("count").cast("double").alias("count"))


def pooled(counts: DataFrame) -> DataFrame:
    """Counts of all libraries together, and percent of their total."""
    g = counts.groupBy("geneid", "target", "category", "region", "strand").agg(F.sum("count").alias("count"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("count").alias("_t")))).withColumn("pct", 100 * F.col("count") / F.nullif("_t", F.lit(0.0))).drop("_t")


def read_quant(spark: SparkSession, path: str, value: str = "TPM") -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="Name string, Length double, EffectiveLength double, TPM double, NumReads double").select(F.col("Name").alias("name"), F.col("EffectiveLength").alias("efflen"), F.col(value).alias("value"))


def read_em_counts(spark: SparkSession, path: str, categories: list[str] = ["only", "3prunon"]) -> DataFrame:
    """uid, value: the sum of the given categories that the table has, per normalized id."""
    from helixmill.functions.seq import uid

    t = spark.read.csv(path, sep="\t", header=True)
    have = [c for c in categories if c in t.columns]
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in have), F.lit(0.0))
    return t.select(uid(F.col(t.columns[0])).alias("uid"), total.alias("v")).groupBy("uid").agg(F.sum("v").alias("value"))


def read_te_counts(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """uid, value of two-column tables: UID-* features added up, or (htseq) all but __ rows, the last of each."""
    from helixmill.functions.seq import uid

    t = _fields(spark, path).where(~F.col("value").startswith("#") & (F.size("f") >= 2)).select(F.regexp_replace(_at(0), '"', "").alias("name"), _at(1, "double").alias("v"), F.monotonically_increasing_id().alias("i")).where(F.col("v").isNotNull())
    if last_wins:
        return t.where(~F.col("name").startswith("__")).groupBy(uid(F.col("name")).alias("uid")).agg(F.max_by("v", "i").alias("value"))
    return t.where(F.col("name").startswith("UID-")).groupBy(uid(F.col("name")).alias("uid")).agg(F.sum("v").alias("value"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """qname, identity, aligned_frac, mid (1-based), strand, target; malformed lines go."""
    t = _fields(spark, path).where(F.size("f") >= 12)
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n = {i: _at(i, "bigint") for i in (1, 2, 3, 7, 8, 9, 10)}
    good = t.where(n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull() & n[7].isNotNull() & n[8].isNotNull() & n[9].isNotNull() & n[10].isNotNull())
    return good.select(_at(0).alias("qname"), zero(n[9], n[10]).alias("identity"), zero(n[3] - n[2], n[1]).alias("aligned_frac"), ((n[7] + n[8]) / 2 + 1).alias("mid"), _at(4).alias("strand"), _at(5).alias("target"), F.monotonically_increasing_id().alias("record_index"))


def best_hits(paf: DataFrame) -> DataFrame:
    """The hit of the largest identity x aligned share of each query; the first on ties."""
    rest = [c for c in paf.columns if c not in ("qname", "record_index")]
    return paf.groupBy("qname").agg(F.max_by(F.struct(*rest), F.struct(F.col("identity") * F.col("aligned_frac"), -F.col("record_index"))).alias("h")).select("qname", "h.*")


def read_kmer_dump(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(_at(0) != "")
    return t.select(_at(0).alias("kmer"), F.coalesce(_at(1, "bigint"), F.lit(1)).alias("count"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_at(0).alias("contig"), _at(1, "bigint").alias("length")).where("length is not null")


def read_assembly_names(spark: SparkSession, path: str) -> DataFrame:
    """accession, name of an assembly report; rows without either go."""
    t = _fields(spark, path).where(~F.col("value").startswith("#")).select(_at(6).alias("accession"), _at(9).alias("name"))
    return t.where(F.col("accession").isNotNull() & F.col("name").isNotNull() & (F.trim("accession") != "na") & (F.trim("name") != "na"))


def renamed(rows: DataFrame, names: DataFrame, keep_unmapped: bool, contig: str = "contig") -> DataFrame:
    """Contigs by their other name; unmapped ones go or stay as they are."""
    out = rows.join(F.broadcast(names.select(F.col("accession").alias("_a"), F.col("name").alias("_n"))), F.col(contig) == F.col("_a"), "left" if keep_unmapped else "inner")
    return out.withColumn(contig, F.coalesce("_n", contig)).drop("_a", "_n")


def read_named_bed(spark: SparkSession, path: str) -> DataFrame:
    """A BED whose names are family.category.region.strand."""
    b = read_bed(spark, path)
    return b.withColumn("n", parse_locus_name(F.col("uid"))).select("contig", "start", "end", "n.family", "n.category", "n.region", F.coalesce("strand", "n.strand").alias("strand"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """l1_id, count, and the cell that the file's path names as power_* and delprob_*; headers and short rows go."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.input_file_name().alias("p"))
    return t.select(_at(0).alias("l1_id"), _at(1, "bigint").alias("count"), *(F.regexp_extract("p", rf"{c}[_=]([0-9.]+[0-9])", 1).alias(c) for c in ("power", "delprob"))).where("count is not null")


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    """split, class, n: thousands separators are taken out."""
    t = spark.read.csv(path, header=True, quote='"')
    return t.unpivot([F.col(f"`{t.columns[0]}`")], [f"`{c}`" for c in t.columns[1:]], "class", "n").select(F.col(t.columns[0]).alias("split"), "class", F.regexp_replace("n", ",", "").cast("bigint").alias("n"))


def read_strata(spark: SparkSession, path: str, axis: str) -> DataFrame:
    """axis, method, stratum, value of a matrix with a method per row and a stratum per column."""
    t = spark.read.csv(path, header=True)
    return t.unpivot([F.col(f"`{t.columns[0]}`")], [f"`{c}`" for c in t.columns[1:]], "stratum", "value").select(F.lit(axis).alias("axis"), F.col(t.columns[0]).alias("method"), "stratum", F.col("value").cast("double").alias("value"))


def write_scores(scores: DataFrame, path: str, key: str, classes: list[str]) -> None:
    scores.select(F.col(key).cast("string").alias("id"), *(F.col(c).cast("float").alias(c) for c in classes)).write.mode("overwrite").parquet(path)


def write_logits(rows: DataFrame, path: str) -> None:
    rows.select(F.col("logits").cast("array<double>").alias("logits"), F.col("label").cast("int").alias("label"), F.lit(None).cast("array<string>").alias("classes") if "classes" not in rows.columns else F.col("classes")).write.mode("overwrite").parquet(path)


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """A result table in a fixed order, as Parquet and as one CSV file; for small tables, since one task writes the CSV."""
    out = rows.orderBy(*order)
    out.write.mode("overwrite").parquet(f"{path}/parquet")
    out.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)


def write_split_gff(gff: DataFrame, path: str, pattern: str | None = None) -> None:
    """The lines of each subfamily in a folder of its own."""
    rows = gff.where(F.col("subfamily").isNotNull())
    if pattern:
        rows = rows.where(F.col("subfamily").rlike(pattern))
    rows.select("subfamily", "value").write.mode("overwrite").partitionBy("subfamily").text(path)


def l1_bed(rmout: DataFrame, max_div: float | None = None, names: DataFrame | None = None) -> DataFrame:
    """BED lines of LINE-1 rows of at most max_div on primary chromosomes."""
    r = rmout.where(F.upper("family").startswith("LINE/L1") | F.upper("name").startswith("L1"))
    if max_div is not None:
        r = r.where(F.col("div") <= max_div)
    if names is not None:
        r = renamed(r, names, keep_unmapped=False)
    return r.where(is_primary(F.col("contig"))).select(F.concat_ws("\t", "contig", "start", "end", "name", "div", "strand").alias("value"))


def gff3(rmout: DataFrame, names: DataFrame | None = None) -> DataFrame:
    r = renamed(rmout, names, keep_unmapped=True) if names is not None else rmout
    return r.select(F.concat_ws("\t", "contig", F.lit("RepeatMasker"), F.lit("repeat"), F.col("start") + 1, "end", "div", "strand", F.lit("."), F.concat(F.lit("Name="), "name", F.lit(";family="), "family")).alias("value"))


def labelled_fasta(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """read_id, mate, value: records of labelled fragments with the label behind the mate's mark."""
    j = pairs.join(labels, "read_id")
    one = lambda n: F.struct(F.lit(n).alias("mate"), F.concat(F.lit(">"), "read_id", F.lit(f"/{n}|"), "label", F.lit("\n"), f"r{n}").alias("value"))
    return j.select("read_id", F.explode(F.array(one(1), one(2))).alias("x")).select("read_id", "x.*")


def arm_tables(counts: DataFrame, arms: DataFrame) -> DataFrame:
    """arm, Geneid, count: the libraries of each arm added up."""
    return counts.join(F.broadcast(arms), "library").groupBy("arm", F.concat_ws(".", "target", "category", "region", "strand").alias("Geneid")).agg(F.sum("count").alias("count"))


def write_arms(arm_counts: DataFrame, path: str) -> None:
    arm_counts.write.mode("overwrite").partitionBy("arm").csv(path, sep="\t", header=True)


def manifest(tables: dict[str, DataFrame], params: dict, path: str, spark: SparkSession) -> None:
    """Rows and an order-free fingerprint of each table, with the parameters, as one JSON row."""
    entries = {}
    for name, df in tables.items():
        r = df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("fingerprint")).first()
        entries[name] = {"rows": r["rows"], "fingerprint": r["fingerprint"] or 0}
    spark.createDataFrame([(json.dumps(params, sort_keys=True), json.dumps(entries, sort_keys=True))], "params string, tables string").coalesce(1).write.mode("overwrite").json(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores, such as one file of one row group, dealt to all cores; any other as it is. Rows stay the same.

    For plain scans and projections of them: it asks for the number of partitions, which a plan with a shuffle only knows once it runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
