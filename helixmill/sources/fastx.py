"""FASTA and FASTQ as a Spark data source.

Plain files are read in byte ranges, each range from its first record start on; compressed files are one partition each.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, record_index bigint, id string, seq string, qual string"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
    else:
        system = fs.LocalFileSystem()
    return system, path


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    infos = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(at)] if "://" in path else ""
    found = sorted((prefix + i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
    if not found:
        raise FileNotFoundError(path)
    return found


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "").lower()
        self.split = int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _files(self.path):
            whole = path.endswith((".gz", ".bgz"))
            step = max(1, size if whole else self.split)
            out += [Range(path, i, min(size, i + step)) for i in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.path:
            name = part.path.removesuffix(".gz").removesuffix(".bgz")
            fastq = self.kind == "fastq" if self.kind else name.endswith((".fastq", ".fq"))
            lines = _lines(part)
            stop = 1 << 62 if part.path != name else part.stop  # places in a compressed file are those of its content
            for at, id_, seq, qual in (_fastq if fastq else _fasta)(lines, stop):
                yield part.path, at, id_, seq, qual


def _lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """(where it starts, line) from the first line that starts in the range on; past its end too, for the last record."""
    system, path = _open(part.path)
    if path.endswith((".gz", ".bgz")):
        with system.open_input_stream(path, compression=None) as raw, gzip.open(io.BufferedReader(raw)) as f:
            at = 0
            for line in f:
                yield at, line.rstrip(b"\r\n")
                at += len(line)
        return
    with system.open_input_file(path) as raw:
        at = max(0, part.start - 1)
        raw.seek(at)
        f = io.BufferedReader(raw, 1 << 20)
        if part.start:
            at += len(f.readline())
        for line in f:
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def _fasta(lines, stop: int) -> Iterator[tuple]:
    own = None
    for at, line in lines:
        if line.startswith(b">"):
            if own:
                yield own[0], own[1], b"".join(own[2]).decode(), None
            if at >= stop:
                own = None
                break
            own = (at, _id(line), [])
        elif own:
            own[2].append(line.strip())
    if own:
        yield own[0], own[1], b"".join(own[2]).decode(), None


def _id(line: bytes) -> str:
    return (line[1:].split() or [b""])[0].decode()


def _fastq(lines, stop: int) -> Iterator[tuple]:
    """A record starts at a line with @ whose second next line has +; a quality line with @ is followed by a header, not by a + two lines on."""
    window: list[tuple[int, bytes]] = []
    for at, line in lines:
        if not window and not line:
            continue
        window.append((at, line))
        if len(window) < 4:
            continue
        if window[0][1].startswith(b"@") and window[2][1].startswith(b"+") and len(window[3][1]) == len(window[1][1]):
            if window[0][0] >= stop:
                return
            yield window[0][0], _id(window[0][1]), window[1][1].decode(), window[3][1].decode()
            window = []
        else:
            window.pop(0)


class FastxSource(DataSource):
    """spark.read.format("fastx").load(path); options kind (fasta or fastq, else by name) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, path: str, kind: str = "", split_bytes: int = 64 << 20) -> DataFrame:
    """file, record_index (where the record starts in the file), id (first word of the header), seq, qual (null for FASTA)."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("kind", kind).option("splitBytes", split_bytes).load(path)


def clean_reads(reads: DataFrame) -> DataFrame:
    """Standardized sequences; those left empty go."""
    from helixmill.functions.seq import standardize

    return reads.withColumn("seq", standardize(F.col("seq"))).where(F.length("seq") > 0)


def numbered(reads: DataFrame) -> DataFrame:
    """Adds n, the record's number in its file: ranks inside ranges of places plus the ranges' counts."""
    from pyspark.sql import Window

    r = reads.withColumn("_b", F.floor(F.col("record_index") / (1 << 24)))
    sizes = r.groupBy("file", "_b").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy("file", "_b").orderBy("record_index"))
    return r.withColumn("n", inside).join(sizes, ["file", "_b"]).withColumn("n", F.col("n") + F.col("_before") - 1).drop("_b", "_before")


def read_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """read_id, r1, r2: mates of the same number and id (less /1 and /2), upper-cased."""
    side = lambda df, c: numbered(df).select("n", F.regexp_replace("id", "/[12]$", "").alias("read_id"), F.upper("seq").alias(c))
    return side(first, "r1").join(side(second, "r2"), ["n", "read_id"]).select("read_id", "r1", "r2")
