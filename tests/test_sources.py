import gzip

import pytest
from pyspark.sql import functions as F

from helixmill.sources import fastx as X
from helixmill.sources import tables as S


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">r1 first read\nACTG\nNNNACTG\n>r2\nac\n>r3\nNNN\n")
    for split in (1, 5, 9, 1000):
        got = [(r.id, r.seq) for r in X.read_fastx(spark, p, split_bytes=split).orderBy("record_index").collect()]
        assert got == [("r1", "ACTGNNNACTG"), ("r2", "ac"), ("r3", "NNN")], split
    assert [(r.id, r.seq) for r in X.clean_reads(X.read_fastx(spark, p)).orderBy("id").collect()] == [("r1", "ACTGACTG"), ("r2", "AC")]
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">r1 first read\nACTG\n>r2\nac\n")
    assert X.read_fastx(spark, str(tmp_path / "b.fa.gz")).count() == 2
    assert X.read_fastx(spark, put(tmp_path, "e.fa", "")).count() == 0


def test_fastq_and_pairs(spark, tmp_path):
    recs = [(f"frag{i}", "ACGT" * 3, "@II+@IIIIII@") for i in range(20)]
    one = put(tmp_path, "r1.fq", "".join(f"@{i}/1\n{s}\n+\n{q}\n" for i, s, q in recs))
    two = put(tmp_path, "r2.fq", "".join(f"@{i}/2\n{s.lower()}\n+x\n{q}\n" for i, s, q in recs[:19]) + "@other/2\nAAAA\n+\nIIII\n")
    for split in (7, 41, 4096):
        a, b = (X.read_fastx(spark, p, split_bytes=split) for p in (one, two))
        assert (a.count(), b.count()) == (20, 20), split
        assert X.read_pairs(a, b).where("r1 = r2").count() == 19
    with pytest.raises(ValueError):
        from helixmill.operators.labels import require_empty, unpaired

        key = lambda df: df.select(F.regexp_replace("id", "/[12]$", "").alias("k"))
        require_empty(unpaired(key(a), key(b), "k"), "mates differ")


def test_alignments(spark, tmp_path):
    sam = S.read_sam(spark, put(tmp_path, "x.sam", "@HD\tVN:1\nq1\t0\tchr1\t11\t60\t3S5M2D4M1I\t*\t0\t0\tACGT\tIIII\nq1\t4\t*\t0\t0\t*\t*\t0\t0\tGGGG\tIIII\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"))
    assert [(r.qname, r.start, r.end) for r in sam.collect()] == [("q1", 10, 21), ("q1", -1, -1)]
    assert S.last_of_each(sam).first().seq == "GGGG"
    out = S.read_rmout(spark, put(tmp_path, "x.out", "   SW perc\nscore div\n\n 1504 1.3 0.4 1.3 chr1 10001 10468 (249) C L1PA2 LINE/L1 1 463 (0) 1\n 10 5 0 0 NC_1 1 50 (2) + AluY SINE/Alu 1 2 (0) 2\n"))
    assert [(r.contig, r.start, r.strand, r.family) for r in out.collect()] == [("chr1", 10000, "-", "LINE/L1"), ("NC_1", 0, "+", "SINE/Alu")]
    assert [r.value for r in S.l1_bed(out, 2.0).collect()] == ["chr1\t10000\t10468\tL1PA2\t1.3\t-"]
    names = S.read_assembly_names(spark, put(tmp_path, "rep.txt", "# x\n" + "\t".join(["a"] * 6 + ["NC_1", "b", "c", "chr9"]) + "\n" + "\t".join(["a"] * 6 + ["na", "b", "c", "chr8"]) + "\n"))
    assert {r.contig for r in S.renamed(out, names, True).collect()} == {"chr1", "chr9"} and S.renamed(out, names, False).count() == 1
    assert S.gff3(out, names).count() == 2
    paf = S.read_paf(spark, put(tmp_path, "x.paf", "r\t100\t0\t50\t+\tL1\t6000\t100\t150\t40\t50\t60\nr\t100\t0\t90\t-\tL1\t6000\t100\t190\t85\t90\t60\nbad\tline\nr2\tx\t0\t90\t-\tL1\t6000\t100\t190\t85\t90\t60\n"))
    best = S.best_hits(paf).collect()
    assert len(best) == 1 and best[0].strand == "-" and best[0].mid == 146.0


def test_annotation_tables(spark, tmp_path):
    bed = S.read_bed(spark, put(tmp_path, "x.bed", "track name=x\nchr1\t0\t1000\tL1HS.0.chr1:0-1000.+\t0\t+\nGL1\t0\t9\tu\t0\t+\nchr2\t0\t150\tb.1.c.-\t0\t-\n"), "t", 100, 100)
    assert [(r.contig, r.element_bp, r.track) for r in bed.collect()] == [("chr1", 900, "t")]
    gff = S.read_gff(spark, put(tmp_path, "x.gff", '# c\nchr1\ta\tb\t1\t9\t.\t+\t.\tTarget "Motif:L1HS" 1 100\nchr1\ta\tb\t1\t9\t.\t+\t.\tID=L1PA2;x=1\nchr1\ta\tb\t1\t9\t.\t+\t.\tx=1;family=L1M\nshort\tline\n'))
    assert [r.subfamily for r in gff.collect()] == ["L1HS", "L1PA2", "L1M"]
    S.write_split_gff(gff, str(tmp_path / "split"), "^L1P|^L1HS")
    assert {r.subfamily for r in spark.read.text(str(tmp_path / "split")).collect()} == {"L1HS", "L1PA2"}
    fc = S.read_feature_counts(spark, put(tmp_path, "fc.txt", "# cmd\nGeneid\tChr\tStart\tEnd\tStrand\tLength\ta.bam\tb.bam\nL1HS.0.chr1:0-9.+\tc\t1\t2\t+\t9\t3\t1\nL1PA2.1.chr2:0-9.-\tc\t1\t2\t+\t9\t4\t0\n"))
    assert fc.count() == 4 and {r.target: r.pct for r in S.pooled(fc).collect()} == {"L1HS": 50.0, "L1PA2": 50.0}
    arms = spark.createDataFrame([("a.bam", "x"), ("b.bam", "x")], "library string, arm string")
    assert {(r.Geneid, r["count"]) for r in S.arm_tables(fc, arms).collect()} == {("L1HS.0.chr1:0-9.+", 4.0), ("L1PA2.1.chr2:0-9.-", 4.0)}
    assert {r.contig: r.length for r in S.read_sizes(spark, put(tmp_path, "s.sizes", "chr1\t100\nbad\n")).collect()} == {"chr1": 100}
    assert S.read_named_bed(spark, str(tmp_path / "x.bed")).where("family = 'L1HS'").first().region == "chr1:0-1000"


def test_abundance_tables(spark, tmp_path):
    q = S.read_quant(spark, put(tmp_path, "quant.sf", "Name\tLength\tEffectiveLength\tTPM\tNumReads\nUID-1\t9\t8\t1.5\t3\n"), "NumReads").first()
    assert (q.name, q.efflen, q.value) == ("UID-1", 8.0, 3.0)
    em = S.read_em_counts(spark, put(tmp_path, "em.txt", "name\tonly\t3prunon\tpassive_sense\trunon\nUID-1.x\t1\t2\t9\t9\nUID-1:y\t1\t0\t9\t9\nUID-2\t5\t0\t0\t7\n"))
    assert {r.uid: r.value for r in em.collect()} == {"UID1": 4.0, "UID2": 5.0}
    te = put(tmp_path, "te.txt", '# c\n"UID-1:a"\t3\nUID-1.b\t4\nGENE\t9\n__no_feature\t8\n')
    assert {r.uid: r.value for r in S.read_te_counts(spark, te).collect()} == {"UID1": 7.0}
    assert {r.uid: r.value for r in S.read_te_counts(spark, te, True).collect()} == {"UID1": 4.0, "GENE": 9.0}
    assert [tuple(r) for r in S.read_kmer_dump(spark, put(tmp_path, "k.txt", "ACG 5\nTTT\n\n")).collect()] == [("ACG", 5), ("TTT", 1)]
    (tmp_path / "power_0.8_delprob_0.1").mkdir()
    t = S.read_truth(spark, put(tmp_path / "power_0.8_delprob_0.1", "counts.tsv", "l1_id\tcount\nUID1\t7\nshort\n")).collect()
    assert [(r.l1_id, r["count"], r.power, r.delprob) for r in t] == [("UID1", 7, "0.8", "0.1")]
    c = S.read_composition(spark, put(tmp_path, "c.csv", 'Split,L1HS,L1PA\ntrain,"1,234","5"\n')).collect()
    assert {(r.split, r["class"], r.n) for r in c} == {("train", "L1HS", 1234), ("train", "L1PA", 5)}
    assert S.read_strata(spark, put(tmp_path, "m.csv", ",s1,s2\nA,0.5,0.6\n"), "ins").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.25, 0.75), (1, 0.5, 0.5)], "id long, A double, B double")
    S.write_scores(df, str(tmp_path / "s"), "id", ["A", "B"])
    assert spark.read.parquet(str(tmp_path / "s")).dtypes == [("id", "string"), ("A", "float"), ("B", "float")]
    S.write_table(df, str(tmp_path / "t"), ["id"])
    assert [r.id for r in spark.read.csv(str(tmp_path / "t/csv"), header=True).collect()] == ["1", "2"]
    S.write_logits(df.selectExpr("array(A, B) AS logits", "1 AS label"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).first().logits in ([0.25, 0.75], [0.5, 0.5])
    pairs = spark.createDataFrame([("f1", "AC", "GT"), ("f2", "A", "G")], "read_id string, r1 string, r2 string")
    labels = spark.createDataFrame([("f1", "L1HS")], "read_id string, label string")
    assert sorted(r.value for r in S.labelled_fasta(pairs, labels).collect()) == [">f1/1|L1HS\nAC", ">f1/2|L1HS\nGT"]
    for n in ("m1", "m2"):
        S.manifest({"x": df.repartition(3) if n == "m2" else df}, {"seed": 1}, str(tmp_path / n), spark)
    assert spark.read.json(str(tmp_path / "m1")).first().tables == spark.read.json(str(tmp_path / "m2")).first().tables
