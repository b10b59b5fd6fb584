"""Queries on reads and k-mers; `documents` stands for reads (text kept to ACGT), `lang` for the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import seq as S
from helixmill.operators import kmers as K
from helixmill.plans.registry import query, table
from helixmill.sources.tables import spread

READS = "reads AS (SELECT doc_id, lang AS corpus, regexp_replace(upper(text), '[^ACTG]', '', 'g') AS seq FROM documents)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def km(k: int, canonical: bool = True, name: str = "km", cols: str = "doc_id, corpus", src: str = "reads") -> str:
    x = f"substr(seq, i, {k})"
    x = f"least({x}, {RC.format(x)})" if canonical else x
    return f"{name} AS (SELECT {cols}, i - 1 AS off, {x} AS kmer FROM {src}, unnest(range(1, length(seq) - {k - 2})) t(i))"


def summary(by: str, k: str, src: str) -> str:
    return f"""b AS (SELECT {by}, sum(c) AS n_kmers, count(*) AS n_types, count(*) FILTER (WHERE c = 1) AS singletons, CASE WHEN count(*) <= 1 THEN 0.0 ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END AS entropy FROM {src} GROUP BY {by}),
    b2 AS (SELECT *, 1 - singletons / n_kmers::DOUBLE AS coverage FROM b),
    a AS (SELECT {by}, -sum(pa * log2(pa) / CASE WHEN d > 0 THEN d ELSE 1 END) AS cs FROM (SELECT *, 1 - pow(1 - pa, n_kmers) AS d FROM (SELECT {src}.*, n_kmers, c / n_kmers::DOUBLE * coverage AS pa FROM {src} JOIN b2 USING ({by}) WHERE coverage > 0)) GROUP BY {by}),
    s AS (SELECT b2.*, CASE WHEN n_types <= 1 THEN 0.0 ELSE entropy + (n_types - 1) / (2 * n_kmers * ln(2)) END AS miller_madow, CASE WHEN n_types <= 1 THEN 0.0 ELSE coalesce(cs, entropy) END AS chao_shen,
      CASE WHEN n_types <= 1 THEN 0.0 ELSE greatest(log2(n_types) - entropy, 0) END AS kl_observed, greatest(2.0 * {k} - entropy, 0) AS kl_full, 1 - entropy / (2.0 * {k}) AS redundancy_shannon,
      CASE WHEN n_types <= 1 THEN 1.0 ELSE 1 - entropy / log2(n_types) END AS redundancy_observed, 1 - n_types / n_kmers::DOUBLE AS redundancy_duplication FROM b2 LEFT JOIN a USING ({by}))"""


MEASURES = ["coverage", "entropy", "miller_madow", "chao_shen", "kl_observed", "kl_full", "redundancy_shannon", "redundancy_observed", "redundancy_duplication"]
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def reads(spark, d):
    raw = spread(table(spark, d, "documents").select("doc_id", F.col("lang").alias("corpus"), "text"))
    return raw.select("doc_id", "corpus", S.standardize(F.col("text")).alias("seq"))


@query(f"WITH {READS} SELECT doc_id, seq, {RC.format('seq')} AS rc, length(seq)::BIGINT AS bases FROM reads")
def p01_p02_standardize(spark, d):
    return reads(spark, d).select("doc_id", "seq", S.reverse_complement(F.col("seq")).alias("rc"), F.length("seq").cast("bigint").alias("bases"))


@query(f"WITH {READS}, {km(7, False)} SELECT corpus, kmer, count(*) AS n, min(off)::BIGINT AS first_offset FROM km GROUP BY ALL")
def p03_kmer_split(spark, d):
    return S.explode_kmers(reads(spark, d), 7).groupBy("corpus", "kmer").agg(F.count("*").alias("n"), F.min("offset").cast("bigint").alias("first_offset"))


@query(f"""WITH {READS}, p AS (SELECT doc_id, i, 4 * (strpos('ACGT', substr(seq, i, 1)) - 1) + strpos('ACGT', substr(seq, i + 1, 1)) - 1 AS v FROM reads, unnest(range(1, length(seq), 2)) t(i))
SELECT doc_id, coalesce(string_agg(chr((19968 + v)::INT), '' ORDER BY i), '') AS packed FROM reads LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def p04_packed(spark, d):
    return reads(spark, d).select("doc_id", S.packed(F.col("seq"), 2).alias("packed"))


CODE = "list_sum([(strpos('ACGT', substr(kmer, j::INT, 1)) - 1) * (4::BIGINT ** ({k} - j))::BIGINT FOR j IN range(1, {k} + 1)])::BIGINT"


@query(f"WITH {READS}, {km(6)}, c AS (SELECT kmer, count(*) AS count FROM km GROUP BY kmer) SELECT {CODE.format(k=6)} AS code, count FROM c")
def p05_a01_canonical_counts(spark, d):
    return K.count_kmers(reads(spark, d), 6)


@query(f"""WITH {READS}, {km(5)}, c AS (SELECT kmer, count(*) AS count FROM km GROUP BY kmer), e AS (SELECT {CODE.format(k=5)} AS code, count FROM c),
m1 AS (SELECT code, count, xor(code, code >> 30)::UHUGEINT AS x FROM e), m2 AS (SELECT code, count, ((x * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM m1),
m3 AS (SELECT code, count, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM m2)
SELECT (xor(x, x >> 31) % 64)::BIGINT AS bucket, sum(count)::BIGINT AS n FROM m3 GROUP BY 1""")
def p06_splitmix_buckets(spark, d):
    return K.count_kmers(reads(spark, d), 5).groupBy(S.splitmix_bucket("code", F.lit(64)).alias("bucket")).agg(F.sum("count").alias("n"))


def _summary_query(k):
    return f"WITH {READS}, {km(k)}, c AS (SELECT corpus, kmer, count(*) AS c FROM km GROUP BY ALL), {summary('corpus', str(k), 'c')} SELECT corpus, n_kmers::BIGINT AS n_kmers, n_types, singletons, {ROUNDED} FROM s"


@query(_summary_query(7))
def a03_a09_entropy_summary(spark, d):
    return rounded(K.entropy_summary(K.count_kmers(reads(spark, d), 7, ["corpus"]), ["corpus"], 7), *MEASURES)


@query()
def a09_summary_with_interval(spark, d):
    """The whole summary row of each corpus with the interval of its entropy, from 200 replicates of the counts of counts."""
    return K.entropy_summary(K.count_kmers(reads(spark, d), 7, ["corpus"]), ["corpus"], 7, replicates=200, seed="1")


def unif(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13))::BIGINT / {16**13}.0)"


SAMPLED = f"""g AS (SELECT reads.*, replicate, {unif('doc_id::VARCHAR', 'replicate::VARCHAR', "'7'")} AS u FROM reads, unnest([0, 1]) t(replicate)),
r AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY u, doc_id) AS rk, count(*) OVER (PARTITION BY replicate) AS n FROM g),
sampled AS (SELECT r.*, fraction FROM r, unnest([0.5::DOUBLE, 1.0::DOUBLE]) t(fraction) WHERE rk <= round_even(fraction * n, 0))"""


def _counts(ks):
    return ", ".join(km(k, True, f"k{k}", f"corpus, fraction, replicate, {k} AS k", "sampled") for k in ks) + ", c AS (SELECT corpus, fraction, replicate, k, kmer, count(*) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in ks) + ") GROUP BY ALL)"


SPECTRUM = f"WITH {READS}, {SAMPLED}, {_counts([3, 4, 5])}, {summary('corpus, fraction, replicate, k', 'k', 'c')}"


def spectrum(spark, d):
    return K.spectrum(reads(spark, d), "doc_id", "corpus", [3, 4, 5], [0.5, 1.0], 2, "7")


@query(f"WITH {READS}, {SAMPLED} SELECT doc_id, replicate, fraction FROM sampled")
def x03_nested_sample(spark, d):
    return K.nested_sample(reads(spark, d), "doc_id", [0.5, 1.0], 2, "7").select("doc_id", "replicate", "fraction")


@query(f"{SPECTRUM} SELECT corpus, fraction, replicate, k, n_kmers::BIGINT AS n_kmers, n_types, singletons, {ROUNDED} FROM s")
def a10_spectrum(spark, d):
    return rounded(spectrum(spark, d), *MEASURES)


MEAN = f"""{SPECTRUM}, m AS (SELECT corpus, fraction, k, avg(entropy) AS entropy, avg(miller_madow) AS miller_madow, avg(chao_shen) AS chao_shen, avg(coverage) AS coverage, avg(redundancy_duplication) AS redundancy_duplication FROM s GROUP BY ALL),
me AS (SELECT *, miller_madow - entropy AS gap_mm, chao_shen - entropy AS gap_cs, coalesce(miller_madow - lag(miller_madow) OVER (PARTITION BY corpus, fraction ORDER BY k), 0) AS gain FROM m)"""
MEANS = ["entropy", "miller_madow", "chao_shen", "coverage", "redundancy_duplication", "gap_mm", "gap_cs", "gain"]


@query(f"{MEAN} SELECT corpus, fraction, k, {', '.join(f'round({m}, 6) AS {m}' for m in MEANS)} FROM me")
def a44_w03_mean_spectrum(spark, d):
    return rounded(K.mean_spectrum(spectrum(spark, d)), *MEANS)


GATES = f"""{MEAN}, gt AS (SELECT f.corpus, f.k, f.miller_madow AS h, f.gain, abs(f.miller_madow - h.miller_madow) / nullif(f.miller_madow, 0) AS drift, min(f.k) OVER (PARTITION BY f.corpus) AS least FROM me f LEFT JOIN me h ON f.corpus = h.corpus AND f.k = h.k AND h.fraction = 0.5 WHERE f.fraction = 1),
j AS (SELECT corpus, k, h, gain, drift, coalesce(drift < 0.01, false) AS saturated, gain < 0.05 AND k > least AS below_tau FROM gt)"""


@query(f"{GATES} SELECT corpus, k, round(h, 6) AS h, round(gain, 6) AS gain, round(drift, 6) AS drift, saturated, below_tau FROM j")
def m10_k_gates(spark, d):
    return rounded(K.k_gates(K.mean_spectrum(spectrum(spark, d))), "h", "gain", "drift")


@query(f"""{GATES}, o AS (SELECT corpus, max(k) FILTER (WHERE saturated) AS saturated_k, min(k) FILTER (WHERE below_tau) AS plateau_k, NULL::INT AS task_k FROM j GROUP BY corpus)
SELECT *, coalesce(plateau_k <= saturated_k, false) AS within_reliable, CASE WHEN plateau_k <= saturated_k THEN plateau_k ELSE coalesce(saturated_k, plateau_k) END AS recommended_k FROM o""")
def m10_choose_k(spark, d):
    return K.choose_k(K.mean_spectrum(spectrum(spark, d)))


@query(f"""WITH {READS}, {km(6, False)}, c AS (SELECT kmer AS raw, count(*) AS n FROM km GROUP BY 1), t AS (SELECT least(raw, {RC.format('raw')}) AS kmer FROM (SELECT * FROM c WHERE n >= 5 ORDER BY n DESC, raw LIMIT 200))
SELECT DISTINCT {CODE.format(k=6)} AS code FROM t""")
def a02_pinned_kmers(spark, d):
    raw = S.explode_kmers(reads(spark, d).select("seq"), 6).groupBy("kmer").count()
    return K.pinned_kmers(raw, 5, 200)


@query(f"""WITH {READS}, {km(6)}, ix AS (SELECT kmer, count(*) AS c FROM km WHERE corpus = 'en' GROUP BY kmer), p AS (SELECT doc_id, corpus, avg((coalesce(c, 0) >= 1)::INT) AS a, avg((coalesce(c, 0) >= 10)::INT) AS o FROM km LEFT JOIN ix USING (kmer) GROUP BY ALL)
SELECT corpus, count(*) AS n_reads, round(avg(a), 6) AS share_any, round(avg(o), 6) AS share_often FROM p GROUP BY corpus""")
def a38_index_overlap(spark, d):
    r = reads(spark, d)
    index = K.count_kmers(r.where("corpus = 'en'"), 6)
    return rounded(K.read_index_overlap(r, index, "doc_id", "corpus", 6, 10), "share_any", "share_often")


@query("SELECT lang, sum(length(text) - length(regexp_replace(upper(text), '[^ACTG]', '', 'g')))::BIGINT AS stripped, sum(length(text))::BIGINT AS total, round(sum(length(text) - length(regexp_replace(upper(text), '[^ACTG]', '', 'g'))) / sum(length(text)), 6) AS density, sum(length(text) - length(regexp_replace(upper(text), '[^ACTG]', '', 'g'))) / sum(length(text)) > 0.001 AS warn FROM documents GROUP BY lang")
def a39_stripped_density(spark, d):
    return rounded(K.stripped_density(table(spark, d, "documents"), "text", ["lang"]), "density")
