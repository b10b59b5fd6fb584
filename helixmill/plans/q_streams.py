"""Streaming queries over `documents`, run to the end of what is there, and tokens of reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from helixmill.functions import seq as S
from helixmill.operators import kmers as K
from helixmill.operators.ranks import quantiles
from helixmill.plans.q_kmers import CODE, READS, km, reads, rounded, unif
from helixmill.plans.registry import query, table
from helixmill.streaming import scoring as ST


def shared_folder(spark) -> str:
    """A new folder that all executors see: in the cluster's checkpoint folder, a local one only where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        top = tempfile.mkdtemp(prefix="helixmill-")
    return f"{top}/stream-{uuid.uuid4().hex}"


def scored(df):
    """Base shares of a read as its class scores."""
    s = S.standardize(F.col("text"))
    n = F.nullif(F.length(s), F.lit(0))
    share = lambda c: F.coalesce((F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))) / n, F.lit(0.0))
    return df.select(F.col("doc_id").alias("id"), share("A").alias("A"), share("C").alias("C"), (1 - share("A") - share("C")).alias("NEGATIVE"))


@query(f"WITH {READS}, s AS (SELECT doc_id AS id, coalesce((length(seq) - length(replace(seq, 'A', ''))) / nullif(length(seq), 0), 0) AS a, coalesce((length(seq) - length(replace(seq, 'C', ''))) / nullif(length(seq), 0), 0) AS c FROM reads) SELECT id, round(a, 6) AS A, round(1 - a - c, 6) AS NEGATIVE FROM s WHERE 1 - a - c < 0.5")
def st1_st2_streamed_scores(spark, d):
    """Scored as a stream into Parquet; the ids under the threshold are then read back."""
    top = shared_folder(spark)
    src = table(spark, d, "documents")
    stream = ST.stream_table(spark, f"{d}/documents.parque[t]", src.select("doc_id", "text").schema)
    ST.score_stream(stream, scored, f"{top}/out", f"{top}/cp").awaitTermination()
    return rounded(spark.read.schema(scored(src).schema).parquet(f"{top}/out").where("NEGATIVE < 0.5").select("id", "A", "NEGATIVE"), "A", "NEGATIVE")


@query(f"WITH {READS}, s AS (SELECT coalesce((length(seq) - length(replace(seq, 'A', ''))) / nullif(length(seq), 0), 0) AS a, coalesce((length(seq) - length(replace(seq, 'C', ''))) / nullif(length(seq), 0), 0) AS c, 1 - a - c AS n FROM reads) SELECT 'A' AS class, round(sum(a), 4) AS soft, count(*) FILTER (WHERE a >= c AND a >= n) AS hard FROM s UNION ALL SELECT 'C', round(sum(c), 4), count(*) FILTER (WHERE c > a AND c >= n) FROM s UNION ALL SELECT 'NEGATIVE', round(sum(n), 4), count(*) FILTER (WHERE n > a AND n > c) FROM s")
def st4_class_totals(spark, d):
    name = f"totals_{uuid.uuid4().hex}"
    src = table(spark, d, "documents")
    stream = ST.stream_table(spark, f"{d}/documents.parque[t]", src.select("doc_id", "text").schema)
    ST.to_memory(ST.class_totals(scored(stream), ["A", "C", "NEGATIVE"]), name).awaitTermination()
    return spark.table(name).withColumn("soft", F.round("soft", 4))


@query(f"""WITH {READS}, {km(6)}, c AS (SELECT doc_id, off, {CODE.format(k=6)} AS code FROM km), ix AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS rank FROM (SELECT code FROM c GROUP BY code HAVING count(*) * (SELECT count(DISTINCT code) FROM c) > (SELECT count(*) FROM c))), m AS (SELECT max(rank) + 1 AS m FROM ix)
SELECT doc_id, off::BIGINT AS off, coalesce(5 + rank, 5 + m + code % 32)::BIGINT AS token FROM c LEFT JOIN ix USING (code), m""")
def p07_token_ids(spark, d):
    """Codes of an index get their rank, others one of 32 shared ids; every k-mer of a read has one. The index is the codes that come more often than the average code in all reads."""
    rows = S.explode_kmers(reads(spark, d).select("doc_id", "seq"), 6, canonical=True).select("doc_id", F.col("offset").cast("bigint").alias("off"), S.base_code(F.col("kmer")).alias("code"))
    return K.token_ids(rows, K.common_codes(K.count_kmers(reads(spark, d), 6)), 6).select("doc_id", "off", "token")


@query("""WITH c AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY 1), x AS (SELECT conv_id, len(string_split(a, ' ')) AS la, len(string_split(b, ' ')) AS lb FROM c WHERE a IS NOT NULL AND b IS NOT NULL), t AS (SELECT *, CASE WHEN la + lb <= 29 THEN la ELSE least(la, greatest(14, 29 - lb)) END AS na FROM x)
SELECT conv_id, (na + CASE WHEN la + lb <= 29 THEN lb ELSE least(lb, 29 - na) END + 3)::BIGINT AS n_ids, (na + 2)::BIGINT AS first_side, (ceil((na + CASE WHEN la + lb <= 29 THEN lb ELSE least(lb, 29 - na) END + 3) / 8) * 8)::BIGINT AS n_padded FROM t""")
def p08_pair_encoding(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).where("a is not null and b is not null")
    ids = lambda t: F.transform(F.split(t, " "), lambda w: F.length(w).cast("bigint"))
    e = c.select("conv_id", S.pair_encoding(ids("a"), ids("b"), 32).alias("e"))
    return e.select("conv_id", F.size("e.input_ids").cast("bigint").alias("n_ids"), F.size(F.filter("e.token_type_ids", lambda x: x == 0)).cast("bigint").alias("first_side"), F.size(S.padded(F.col("e.input_ids"), 8)).cast("bigint").alias("n_padded"))


@query("WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), q AS (SELECT quantile_cont(n, [0.1, 0.5, 0.9, 0.95, 0.99]) AS q, avg(n) AS m, stddev_pop(n) AS s, min(n) AS lo, max(n) AS hi FROM n) SELECT round(m, 6) AS mean, round(s, 6) AS sd, q[1] AS p10, q[2] AS p50, q[3] AS p90, q[4] AS p95, q[5] AS p99, lo::BIGINT AS low, hi::BIGINT AS high, round((SELECT avg((w = 'the')::INT) FROM documents, unnest(string_split(text, ' ')) t(w)), 6) AS unk FROM q")
def a15_token_lengths(spark, d):
    t = table(spark, d, "documents").select(F.split("text", " ").alias("w"))
    t = t.select(F.size("w").alias("n"), F.size(F.filter("w", lambda x: x == "the")).alias("u"))
    q = t.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.min("n").cast("bigint").alias("low"), F.max("n").cast("bigint").alias("high"), (F.sum("u") / F.sum("n")).alias("unk"))
    q = q.join(quantiles(t, [], "n", [0.1, 0.5, 0.9, 0.95, 0.99]), how="left")
    return rounded(q.select("mean", "sd", *(F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90", "p95", "p99"))), "low", "high", "unk"), "mean", "sd", "unk")


@query(f"WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, len(w) AS n, len(list_filter(range(len(w)), lambda i: {unif('doc_id::VARCHAR', 'i::VARCHAR')} < 0.2)) AS masked FROM w")
def p24_masked_tokens(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"))
    m = x.select("doc_id", F.size("ids").alias("n"), S.masked_ids(F.col("ids"), F.col("doc_id").cast("string")).alias("m"))
    return m.select("doc_id", "n", F.size(F.filter("m.labels", lambda x: x != -100)).alias("masked"))


U = lambda name: unif("doc_id::VARCHAR", "i::VARCHAR", repr(f"0{name}"))


@query(f"""WITH {READS}, r AS (SELECT doc_id, seq, length(seq) AS n FROM reads WHERE length(seq) > 0), m AS (SELECT *, (trunc(150 + 10 * (sqrt(-2 * ln(1 - {U('a')})) * cos(2 * pi() * {U('b')}))))::BIGINT AS size FROM r, unnest(range(1, n * 3 // 150 + 1)) t(i) WHERE n >= 160),
s AS (SELECT *, floor({U('c')} * greatest(1, n - size + 1))::BIGINT AS start FROM m), e AS (SELECT *, CASE WHEN start + size > n THEN 50 + floor({U('d')} * (n - 50))::BIGINT ELSE start + size END AS stop FROM s),
f AS (SELECT doc_id, substring(seq, 1, 50) AS f, reverse(substring(seq, 1, 51)) AS b FROM r WHERE n < 160 UNION ALL SELECT doc_id, substring(seq, start + 1, 50), substring(seq, stop - 50 + 1, 50) FROM e)
SELECT doc_id, count(*) AS pairs, max(length(f)) AS longest, sum(length(f) - length(replace(f, 'A', '')))::BIGINT AS forward_a, sum(length(b) - length(replace(b, 'A', '')))::BIGINT AS reverse_a FROM f GROUP BY doc_id""")
def p16_long_read_fragments(spark, d):
    """Pairs of each read, and how many A their two ends hold."""
    f = S.long_read_fragments(reads(spark, d).where(F.length("seq") > 0), "doc_id", "seq", 50, 150, 10, 3)
    held = lambda c: F.sum(F.length(c) - F.length(F.replace(F.col(c), F.lit("A"), F.lit(""))))
    return f.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.max(F.length("forward")).alias("longest"), held("forward").alias("forward_a"), held("reverse").alias("reverse_a"))


@query("WITH x AS (SELECT o_orderpriority AS cell, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT cell, count(*) FILTER (WHERE month < '1997-01-01') AS n_months, max(month) FILTER (WHERE month < '1997-01-01') AS have, max(month) AS want FROM x GROUP BY cell) SELECT cell, n_months, have IS NULL OR have < want AS stale FROM c WHERE n_months > 0")
def st3_cached_cells(spark, d):
    """Monthly counts up to 1996 cached by priority, one cell written twice; a cell is stale if an order is newer than its cache."""
    top = shared_folder(spark)
    months = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cell"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    old = months.where("month < '1997-01-01'")
    ST.cached_cells(old, top, ["cell"])
    ST.cached_cells(old.where("cell = '1-URGENT'"), top, ["cell"])
    cached = spark.read.schema(old.schema).parquet(top)
    stale = ST.stale_cells(months, cached, ["cell"], "month").withColumn("stale", F.lit(True))
    return cached.groupBy("cell").agg(F.count("*").alias("n_months")).join(stale, "cell", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
