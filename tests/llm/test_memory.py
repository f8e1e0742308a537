"""What the pipeline's Python workers hold: one step reads texts once, and an idle worker keeps little."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from plexicount.llm import common, decontaminate, near_dup


def held_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_decontamination_reads_texts_once(spark):
    """A filter by what the pass found made it run twice, with twice the workers."""
    passage = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([("a", passage)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " * 30 + passage + " y"), (2, passage), (3, None)], "doc_id bigint, text string")
    done = decontaminate.decontaminate(docs, benchmark)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert set(got) == {1, 3} and "seven" not in got[1] and got[1].endswith("y") and got[3] is None


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_idle_worker_gives_memory_back():
    kept = []

    @common.gives_back
    def task(batches):
        # Blocks too small to be mapped, below one that stays.
        blocks = [bytes(20_000) + b"x" for _ in range(5_000)]
        kept.append(bytes(20_000) + b"y")
        yield from batches
        blocks.clear()

    before = held_mb()
    run = task(iter([1, 2]))
    assert next(run) == 1 and held_mb() > before + 80
    assert list(run) == [2] and held_mb() < before + 30


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["a b c d e f", None])], ["doc_id", "text"])
    (out,) = near_dup._signed(iter([batch]))
    assert out.column(1).to_pylist() == [2, 0] and given == [1]
