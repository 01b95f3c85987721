"""What a task of the pipeline leaves in its worker, and how much it hands on at once."""

import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
from tests.conftest import ROOT
from tidewave.llm import bpe, common, suffix_dedup
from tidewave.llm.queries import tokenizer_path


class Caught:
    """A table that gives the function it is mapped with."""

    columns = ("doc_id", "text")

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def batch(n, words=300):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(32):x}" for _ in range(words)) for _ in range(n)]
    texts[-1] = texts[0]
    return pa.RecordBatch.from_pydict({"doc_id": np.arange(n), "text": texts, "__tie": np.zeros(n, np.int64)})


def test_segments_are_handed_on_in_pieces():
    one = batch(1500)
    out = list(suffix_dedup._segment_table(Caught(), 100, 32)(iter([one])))
    assert len(out) > 1 and max(x.num_rows for x in out) <= 65_536
    # copies count over the whole batch, not over a piece or a step
    rows = pa.Table.from_batches(out)
    later = rows.column("later").to_numpy()
    assert set(rows.column("doc_id").to_numpy()[later]) == {1499} and later.sum() == (rows.column("doc_id").to_numpy() == 0).sum()


def test_a_worker_keeps_little_after_a_task(tmp_path):
    """The memory of a process that has run two tasks, without what it had before; tables of powers have 32 MB."""
    code = """
import re
from tests.llm.test_worker_memory import *

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

before = held()
task = suffix_dedup._segment_table(Caught(), 100, 32)
list(task(iter([batch(100)])))
for out in task(iter(pa.ipc.open_stream(open(sys.argv[1], "rb")))):
    pass
del out
print(held() - before)
"""
    one = batch(4000)
    with pa.ipc.new_stream(tmp_path / "batches", one.schema) as file:  # as Spark sends them
        for _ in range(4):
            file.write_batch(one)
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "batches")], cwd=ROOT, capture_output=True, text=True, check=True)
    assert float(re.findall(r"[-\d.]+", done.stdout)[-1]) < 95


def test_tables_of_other_operators_go():
    bpe.tree_pieces(tokenizer_path())
    assert bpe.vocabulary.cache_info().currsize
    list(common.lean(iter)(iter([])))
    assert not bpe.vocabulary.cache_info().currsize and not bpe.tree_pieces.cache_info().currsize
