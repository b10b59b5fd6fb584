"""What several operators share: reading a table, folders that all executors see, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a checkpoint folder: the one that the session names, or on one machine (tests) a new one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixmill-checkpoint-"))


def release(spark: SparkSession) -> None:
    """Lets go of what nothing refers to any more: plans on both sides of the driver, and with them broadcasts and shuffle files, which Spark's cleaner removes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to a new folder `name`-... in the checkpoint folder and read again; the shuffle files of its plan go."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


#: How to empty what a Python worker keeps from task to task, by name; modules add to it when a worker loads them.
KEPT: dict[str, Callable[[], None]] = {}
#: Batches of a task's results after which freed memory is given back.
GIVE_BACK = 16
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def only_keep(name: str | None) -> None:
    """Empties what the worker keeps under other names than `name`."""
    for other, empty in KEPT.items():
        if other != name:
            empty()


def give_back() -> None:
    """Returns freed memory to the machine; else a worker holds as much as the largest task that it ran."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable, keeps: str | None = None) -> Callable:
    """`run` for mapInArrow. Spark's workers serve many tasks, so what other operators keep in this one goes first, and what the task has freed goes at its end and now and then before."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_keep(keeps)
        give_back()
        try:
            for i, out in enumerate(run(batches), 1):
                yield out
                del out
                if i % GIVE_BACK == 0:
                    give_back()
        finally:
            give_back()

    return own


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each text starts and ends (length + 1 offsets). Null: empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def int64s(column: pa.Array) -> np.ndarray:
    """Null: the smallest number."""
    return np.asarray(pa.compute.fill_null(column, np.iinfo(np.int64).min), dtype=np.int64)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with as many underscores behind it as it takes to be none of the columns (upper and lower case are alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "_id") -> DataFrame:
    """`docs` with a number for each pair of key and text, in order of the key (null first), then of the text's hash.

    Where each key stands for one text, the number is the key (null: the smallest number). Else numbers are dealt once, over
    ranges of (key, hash), so that many rows of one key or none do not meet in one task. The check of the keys runs at once.
    `name` is none of the columns (free_name finds one); the others stay whatever their names.
    """
    k, t = free_name([*docs.columns, name], "_key"), free_name([*docs.columns, name], "_text")
    own = docs.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), t: F.xxhash64(text, F.col(text).isNull())})
    shared = own.groupBy(k).agg((F.min(t) != F.max(t)).alias("many"))
    if shared.where("many").isEmpty():
        return own.withColumn(name, F.col(k)).drop(k, t)
    ensure_checkpoint_dir(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = own.select(k, t).distinct().repartitionByRange(n, k, t).sortWithinPartitions(k, t)
    ids = ids.withColumn(name, F.monotonically_increasing_id()).checkpoint()
    return own.join(ids, [k, t]).drop(k, t)


def texts_changed(docs: DataFrame, change, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of `docs` with the texts that `change` gives a frame of key, text and all other columns in one struct."""
    rest = [c for c in docs.columns if c not in (key, text)]
    if not rest:
        return change(docs).select(*docs.columns)
    done = change(docs.select(key, text, F.struct(*(docs[c] for c in rest)).alias("others")))
    return done.select(*(F.col("others").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns))
