"""Structured Streaming: reads scored as they come, and running class totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(reads: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scores each read once and appends Parquet. The checkpoint and the sink's log make a restarted run go on where the last commit was, and write nothing twice."""
    return score(reads).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def class_totals(scores: DataFrame, classes: list[str], key: str = "id", ingested: str | None = None, delay: str = "1 hour") -> DataFrame:
    """class, soft and hard total of scored reads, kept up to date; a read that comes again within the delay counts once."""
    if ingested:
        scores = scores.withWatermark(ingested, delay).dropDuplicatesWithinWatermark([key])
    top = F.greatest(*classes)
    first = F.lit(None).cast("string")
    for c in reversed(classes):
        first = F.when(F.col(c) == top, c).otherwise(first)
    long = scores.select(first.alias("_top"), F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).cast("double").alias("p")) for c in classes))).alias("x")).select("_top", "x.*")
    return long.groupBy("class").agg(F.sum("p").alias("soft"), F.count_if(F.col("_top") == F.col("class")).alias("hard"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def cached_cells(cells: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions of the cells that are in `cells` and leaves the others as they are."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def stale_cells(inputs: DataFrame, cached: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Cells that have no cached result, or inputs newer than it."""
    have = cached.groupBy(*keys).agg(F.max(stamp).alias("_have"))
    want = inputs.groupBy(*keys).agg(F.max(stamp).alias("_want"))
    return want.join(have, keys, "left").where(F.col("_have").isNull() | (F.col("_have") < F.col("_want"))).select(*keys)
