import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from helixmill.llm import common, packing, quality_rules


class Worker:
    """Stands for a frame whose tasks run in this process, one batch of texts each."""

    def __init__(self, texts):
        row = pa.StructArray.from_arrays([pa.array(texts, pa.string())], ["text"])
        self.batch, self.schema = pa.RecordBatch.from_arrays([row], ["row"]), StructType().add("row", StructType().add("text", "string"))

    def mapInArrow(self, run, schema):  # noqa: N802
        return pa.Table.from_batches(run(iter([self.batch])))


def anonymous_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_task_frees_what_other_operators_keep():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own = packing.encoder(path)
    assert own.ids("a b").tolist() and packing.encoder.cache_info().currsize == 1
    got = quality_rules._measured(Worker(["one two three", None, ""]), "text", 8)
    assert got.column("n_words").to_pylist() == [3, 0, 0]
    assert packing.encoder.cache_info().currsize == 0


def test_an_operator_keeps_its_own():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own = packing.encoder(path)
    assert list(common.lean(iter, "encoder")([1, 2])) == [1, 2]
    assert packing.encoder(path) is own


@pytest.mark.skipif(getattr(common, "_trim", None) is None, reason="the C library has no malloc_trim")
def test_freed_memory_goes_back_also_when_the_task_is_left():
    pins = []

    def run(batches):
        for n in batches:
            pins.append([bytes(2000) for _ in range(n)][-1])  # the last block stays and holds the heap's end
            yield n

    before = anonymous_mb()
    list(run([50_000]))
    assert anonymous_mb() > before + 60
    tasks = common.lean(run)(iter([50_000, 50_000]))
    assert next(tasks) == 50_000
    tasks.close()
    assert anonymous_mb() < before + 30
