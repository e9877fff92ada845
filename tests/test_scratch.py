"""Tables that cut a lineage, and whose they are."""

import os
import threading

from pyspark.sql import functions as F

from tracelake import scratch
from tracelake.plans.queries import QUERIES


def there(df):
    return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())


def test_an_owner_deletes_its_own_tables_only(spark):
    before = scratch.cut(spark.range(3))
    with scratch.Owner() as outer:
        a = scratch.cut(spark.range(4))
        with scratch.Owner() as inner:
            b, c = scratch.cut(spark.range(5)), scratch.cut(spark.range(6))
        d = scratch.cut(spark.range(7))
    inner.release(spark, keep=[c.where("id > 1")])
    assert not there(b) and all(map(there, (before, a, c, d))) and c.count() == 6
    scratch.drop(a)
    assert not there(a) and there(d)
    outer.release(spark)
    assert not there(d) and there(before) and there(c)
    inner.release(spark)
    inner.release(spark)
    assert not there(c) and there(before)
    scratch.drop(before)


def test_jobs_side_by_side_do_not_delete_each_other(spark):
    rounds, both, out = 4, threading.Barrier(2), {}

    def job(name):
        try:
            docs = spark.range(100).withColumn("x", F.lit(name))
            for _ in range(rounds):
                with scratch.Owner() as own:
                    made = scratch.cut(docs.withColumn("id", F.col("id") + 1))
                docs = scratch.cut(made)
                both.wait(60)  # the other's tables are there, and read below
                own.release(spark)
                both.wait(60)
            out[name] = docs.agg(F.sum("id"), F.min("x")).first()
        except BaseException as e:
            both.abort()
            out[name] = e

    threads = [threading.Thread(target=job, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert {n: tuple(r) for n, r in out.items()} == {n: (sum(range(100)) + 100 * rounds, n) for n in "ab"}


def test_a_registered_query_leaves_nothing(spark, data):
    base = scratch.shared_dir(spark).removeprefix("file://") + "/tracelake"
    had = set(os.listdir(base)) if os.path.exists(base) else set()
    with scratch.Owner() as own:
        assert QUERIES["collapsed_file"](spark, data).count() and QUERIES["rows_file"](spark, data).count()
    assert set(os.listdir(base)) - had
    own.release(spark)
    assert set(os.listdir(base)) == had
