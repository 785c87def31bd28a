"""Tags: a batch of long texts isn't held a second time as Python strings."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from shareflow.functions import rules


def test_texts_leave_the_batch_one_at_a_time(monkeypatch):
    kept = []
    monkeypatch.setattr(F, "arrow_udf", lambda scan, returns: lambda text: kept.append(scan))
    rules.literals_in(None, ["placing", "lacing of", "停牌"])
    batch = pa.array(["a placing of shares " + "é停" * 10_000 if k % 2 else "停牌" for k in range(1000)] + [None, ""])
    tracemalloc.start()
    found = kept[0](batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [sorted(x) for x in found[:2].to_pylist()] == [["停牌"], ["lacing of", "placing"]] and found[-2:].to_pylist() == [[], []]
    assert peak < 2_000_000 < batch.nbytes
