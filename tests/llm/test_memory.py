"""What executors hold: memory that a worker keeps between tasks, workers that a task takes, sizes of shuffled rows."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from revsight.llm import secrets, simhash

_WORKER = """
import re
from revsight.llm._common import lean

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

kept = []
def run(batches):
    texts = [bytearray(2000) for _ in range(100_000)]
    kept.append(bytearray(2000))  # the last one allocated keeps glibc from cutting off the rest
    yield from batches
    del texts

for wrap in (lambda x: x, lean):
    before = held()
    assert list(wrap(run)(iter([1, 2]))) == [1, 2]
    print(held() - before)
"""


def test_a_worker_gives_back_what_a_task_has_freed() -> None:
    out = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    plain, lean = map(int, out.stdout.split())
    assert plain > 100 and lean < -100


def test_secrets_are_replaced_by_one_python_step(spark) -> None:
    df = spark.createDataFrame([(1, "password = abcdefgh12 end", 25), (2, None, None), (3, "no secrets", 10)], "doc_id long, text string, n_chars int")
    out = secrets.redacted(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(1, "password = [SECRET] end", 23), (2, None, None), (3, "no secrets", 10)]


def test_rows_of_the_sketch_are_small_and_its_counts_whole(spark, monkeypatch) -> None:
    texts = [" ".join(f"w{(i * j) % 31}" for j in range(40)) for i in range(50)]
    want = Counter(int(h % np.uint64(simhash.SKETCH)) for t in texts for h in simhash._hashed(t, 5, {}))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rows = []
    kind = type(df)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: (rows.extend(self.collect()), plain(self, *a))[1])
    got = simhash.sketch(df, 5)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want
    assert rows and max(len(r["counts"]) for r in rows) <= 1 << 16
