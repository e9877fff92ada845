"""Parts of a stream's aggregate: tries, failures and compactions leave the same sums."""

import os

import pytest
from traces import IDS, random_trace

from tracelake.functions.dims import syscall_dim
from tracelake.operators.aggregate import agg6, merge
from tracelake.plans.calls import enriched_calls
from tracelake.schema import AGG6
from tracelake.sources import parts
from tracelake.streaming import pairs


@pytest.fixture(scope="module")
def batches(spark):
    calls = [enriched_calls(random_trace(seed, 40).frame(spark), syscall_dim(spark, IDS)).coalesce(1) for seed in range(4)]
    for i, c in enumerate(calls):
        c.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/batches/{i}")
        calls[i] = spark.read.parquet(path)
    return calls


def sums(batches):
    rows = agg6(batches[0], with_bytes=True)
    for b in batches[1:]:
        rows = rows.unionByName(agg6(b, with_bytes=True))
    return sorted(merge(rows).collect())


def names(path):
    return sorted(n for n in os.listdir(path) if "=" in n)


def test_tries_failures_and_compactions_leave_the_same_sums(spark, tmp_path, batches):
    path = str(tmp_path / "saved")
    assert pairs.saved_aggregate(spark, path).collect() == [] and parts.compact(spark, path, AGG6, merge) is None
    sink = pairs.add_to_aggregate(path)
    for i in (0, 1, 1, 2):  # one batch is tried twice
        sink(batches[i], i)
    want = sums(batches[:3])
    got = lambda: sorted(pairs.saved_aggregate(spark, path).collect())
    assert got() == want and parts.layout(spark, path) == (None, [0, 1, 2])

    # A compaction that fails midway: files are there, the mark is not.
    sink(batches[3], 99)
    os.rename(f"{path}/batch=99", f"{path}/upto=2")
    os.remove(f"{path}/upto=2/_SUCCESS")
    assert got() == want and parts.layout(spark, path) == (None, [0, 1, 2])

    assert parts.compact(spark, path, AGG6, merge) == 2 and parts.compact(spark, path, AGG6, merge) is None
    assert got() == want and parts.layout(spark, path) == (2, [])
    sink(batches[2], 2)  # a batch that is tried again after it was compacted
    assert got() == want and parts.layout(spark, path) == (2, [])

    sink(batches[3], 3)
    assert got() == sums(batches) and parts.layout(spark, path) == (2, [3])
    # A part that is being written does not count, and no compaction goes past it.
    os.remove(f"{path}/batch=3/_SUCCESS")
    assert got() == want and parts.compact(spark, path, AGG6, merge) is None
    sink(batches[3], 3)
    assert parts.compact(spark, path, AGG6, merge) == 3 and got() == sums(batches)
    parts.vacuum(spark, path)
    assert names(path) == ["upto=3"] and got() == sums(batches)


def test_the_sink_compacts(spark, tmp_path, batches):
    path = str(tmp_path / "saved")
    sink = pairs.add_to_aggregate(path, compact_every=2)
    for i, b in enumerate(batches[:3]):
        sink(b, i)
    assert parts.layout(spark, path) == (1, [2]) and sorted(pairs.saved_aggregate(spark, path).collect()) == sums(batches[:3])
