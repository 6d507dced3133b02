"""What a Python worker holds after a task."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from memoquarry.llm.common import lean


def held_mb() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def step(batches):
    """Takes 240 MB in small arrays below one that stays."""
    for b in batches:
        arrays = [np.ones(7_500) for _ in range(4_000)]
        step.kept = np.ones(7_500)
        yield b.slice(0, len(arrays) // 4_000)


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads /proc")
def test_a_worker_gives_back_the_memory_of_a_task():
    before = held_mb()
    batches = [pa.RecordBatch.from_pydict({"x": [1, 2, 3]})]
    assert [b.num_rows for b in lean(step)(iter(batches))] == [1]
    assert held_mb() - before < 60


def test_memory_is_given_back_when_a_task_ends_early():
    rows = lean(step)(iter([pa.RecordBatch.from_pydict({"x": [1]})] * 3))
    before = held_mb()
    next(rows)
    rows.close()
    assert held_mb() - before < 60
