from pyspark.sql import functions as F

from helixmill.streaming import scoring as ST


def score(df):
    return df.select("id", "at", F.col("x").alias("A"), (1 - F.col("x")).alias("B"))


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "id long, x double, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode(mode).parquet(path)


def test_resume_writes_nothing_twice(spark, tmp_path):
    from datetime import datetime

    now = datetime(2024, 1, 1)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    write(spark, [(1, 0.2, now), (2, 0.8, now)], src)
    schema = spark.read.parquet(src).schema
    run = lambda: ST.score_stream(ST.stream_table(spark, src, schema, 1), score, out, cp).awaitTermination()
    run()
    run()
    write(spark, [(3, 0.9, now)], src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    scores = ST.stream_table(spark, out, spark.read.parquet(out).schema)
    ST.to_memory(ST.class_totals(scores, ["A", "B"]), "totals_a").awaitTermination()
    assert {r["class"]: r.hard for r in spark.table("totals_a").collect()} == {"A": 2, "B": 1}
    write(spark, [(3, 0.9, now), (4, 0.1, now)], src)
    twice = ST.class_totals(score(ST.stream_table(spark, src, schema)), ["A", "B"], ingested="at")
    ST.to_memory(twice, "totals_b").awaitTermination()
    assert {r["class"]: r.hard for r in spark.table("totals_b").collect()} == {"A": 2, "B": 2}


def test_cells(spark, tmp_path):
    p = str(tmp_path / "cells")
    row = lambda rows: spark.createDataFrame(rows, "power string, v int, stamp int")
    ST.cached_cells(row([("a", 1, 5), ("b", 1, 5)]), p, ["power"])
    ST.cached_cells(row([("b", 2, 7)]), p, ["power"])
    cached = spark.read.parquet(p)
    assert {(r.power, r.v) for r in cached.collect()} == {("a", 1), ("b", 2)}
    assert {r.power for r in ST.stale_cells(row([("a", 0, 6), ("b", 0, 6), ("c", 0, 1)]), cached, ["power"], "stamp").collect()} == {"a", "c"}
