"""Binary dumps, saved runs, sketches, stacks and run reports on small tables."""

import random

import pytest
from pyspark.sql import functions as F
from traces import IDS, Trace, random_trace

from tracelake.functions.dims import syscall_dim
from tracelake.operators import aggregate, pairing, profile, stacks
from tracelake.plans.calls import enriched_calls
from tracelake.sources import dump, raw
from tracelake.sources.sinks import load_aggregate, load_runs, save_aggregate, save_run


# binary dumps


def payloads(n=300, seed=1):
    """Records of all kinds, with small numbers everywhere: these look most like types of records."""
    r, out = random.Random(seed), []
    for _ in range(n):
        kind = r.choice(list(dump.SIZES))
        out.append(kind.to_bytes(4, "little") + b"".join(r.randint(0, 16).to_bytes(4, "little") for _ in range(dump.SIZES[kind] // 4 - 1)))
    return out


@pytest.mark.parametrize("size", [1, 7, 24, 400, 5_000, 10**6])
def test_ranges_give_every_record_once(tmp_path, size):
    made = payloads()
    path = str(tmp_path / "d.bin")
    open(path, "wb").write(b"".join(made))
    length = sum(map(len, made))
    found = [p for x in dump.cut_ranges(path, 0, 0, length, size, True) for b in dump.records(x) for p in b.column(1).to_pylist()]
    assert found == made


def test_border_agrees_with_the_chain_or_says_that_it_does_not_know():
    made = payloads(200, 2)
    data, edges = b"".join(made), [0]
    for p in made:
        edges.append(edges[-1] + len(p))
    unsure = 0
    for target in range(0, len(data), 97):
        true = max(e for e in edges if e <= target)
        for window in (100, 3_000, 10**6):
            origin = max(0, target - window)
            got = dump.border(data[origin : target + dump.LONGEST], origin, target)
            assert got in (true, None) and (got == true or origin > 0)
            unsure += got is None
    assert unsure  # so the window does have to grow


def test_dump_of_a_trace_reads_like_its_rows(spark, tmp_path):
    dump.register(spark)
    records = raw.encode_events(random_trace(3, 80).frame(spark))
    path = str(tmp_path / "dump")
    records.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.format("tracedump").mode("append").save(path)
    assert len(dump.listed(path)) == 3
    back = spark.read.format("tracedump").option("rangeBytes", 600).load(path)
    assert back.rdd.getNumPartitions() > 3
    want = [r["payload"] for r in records.orderBy("seq").collect()]
    assert [r["payload"] for r in back.orderBy("seq").collect()] == want
    columns = ("event_type", "time_ns", "tid", "fd", "path", "ret")
    assert sorted(map(str, raw.decode_events(back).select(*columns).collect())) == sorted(map(str, raw.decode_events(records).select(*columns).collect()))
    records.limit(2).coalesce(1).write.format("tracedump").mode("overwrite").save(path)
    assert spark.read.format("tracedump").load(path).count() == 2


def test_dump_cut_off_broken_and_empty(spark, tmp_path):
    dump.register(spark)
    made = payloads(20)
    path = tmp_path / "d"
    path.mkdir()
    (path / "a.bin").write_bytes(b"".join(made)[:-5])
    (path / "b.bin").write_bytes(b"")
    (path / ".c.bin").write_bytes(b"junk of a write that is not done")
    got = [bytes(r["payload"]) for r in spark.read.format("tracedump").load(str(path)).orderBy("seq").collect()]
    assert got == [*made[:-1], made[-1][:-5]]
    (path / "a.bin").write_bytes(made[0] + b"\xff" * 300)
    with pytest.raises(Exception, match="no record begins at byte"):
        spark.read.format("tracedump").load(str(path)).collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format("tracedump").load(str(empty)).collect() == []


def test_dump_as_a_stream_of_growing_files(spark, tmp_path):
    dump.register(spark)
    made, folder, out = payloads(60, 5), tmp_path / "d", []
    folder.mkdir()
    data = b"".join(made)

    def go():
        s = spark.readStream.format("tracedump").option("rangeBytes", 700).load(str(folder))
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend((r["seq"], bytes(r["payload"])) for r in df.collect())).start()
        q.awaitTermination()

    for upto in (1_003, 1_003, len(data) // 2 + 1, len(data)):
        (folder / "b.bin").write_bytes(data[:upto])
        go()
    (folder / "a.bin").write_bytes(made[0])
    go()
    assert [p for _, p in sorted(out)] == [*made, made[0]]


# saved runs and sketches


def test_a_run_saved_twice_counts_once_and_a_host_reads_its_own_files(spark, tmp_path):
    agg, path = aggregate.agg6(enriched_calls(random_trace(4, 60).frame(spark), syscall_dim(spark, IDS))), str(tmp_path / "runs")
    for host in ("h0", "h1", "h0"):
        save_aggregate(agg, path, host, "r", "1")
    one, all_ = aggregate.merge(load_aggregate(spark, path, "h0")), aggregate.merge(load_aggregate(spark, path))
    assert sorted(one.collect()) == sorted(agg.collect()) != []
    assert all_.agg(F.sum("count")).first()[0] == 2 * agg.agg(F.sum("count")).first()[0]
    assert all("host=h0" in f for f in files_read(load_aggregate(spark, path, "h0")))
    with pytest.raises(Exception, match="(?i)divi|raise|boom"):
        save_run(agg.withColumn("count", F.raise_error(F.lit("boom")).cast("bigint")), path, "h1", "r", "1")
    assert load_runs(spark, path, "h1", "r", "1").count() == agg.count()


def files_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).collect()}


def test_sketches_merge_within_the_error(spark):
    r = random.Random(7)
    data = [(g, r.choice((None, int(r.lognormvariate(8, 2)))), r.randint(0, 9)) for g in "ab" for _ in range(20_000)] + [("none", None, None)]
    rows = spark.createDataFrame(data, "g string, latency_ns bigint, bytes bigint").repartition(5)
    parts = None
    for k in range(4):
        part = profile.sketch_profile(rows.where(F.pmod(F.xxhash64("latency_ns", "bytes"), F.lit(4)) == k), ["g"], k=200)
        parts = part if parts is None else parts.unionByName(part)
    merged = profile.merge_sketches(parts, ["g"], k=200)
    assert max(len(x["latency_sketch"] or b"") for x in merged.collect()) < 10_000
    found = profile.sketch_quantiles(merged, ["g"], (0, 0.25, 0.5, 0.99, 1))
    assert {x["g"] for x in found.collect()} == {"a", "b"}
    for x in profile.rank_bounds(rows, found, ["g"]).collect():
        values = [d[1 if x["what"] == "latency" else 2] for d in data if d[0] == x["g"]]
        values = sorted(v for v in values if v is not None)
        assert x["count"] == len(values) and x["below"] == sum(v < x["value"] for v in values) / len(values)
        assert x["below"] <= x["q"] + 2 * profile.rank_error(200) and x["upto"] >= x["q"] - 2 * profile.rank_error(200)
        assert x["q"] not in (0, 1) or x["value"] in (values[0], values[-1])


# run reports, stacks, plans


def test_report_of_the_main_job_reads_the_events_once(spark, tmp_path):
    t = random_trace(9, 100).add("enter", "read", 5, fd=3).add("exit", "write", 5, ret=1)
    events = t.frame(spark)
    events.write.parquet(str(tmp_path / "events"))
    read = spark.read.parquet(str(tmp_path / "events"))
    report = pairing.RunReport()
    matched = report.matched(pairing.match(report.events(read)))
    calls = report.filtered(pairing.valid_calls(matched, syscall_dim(spark, IDS)))
    assert calls._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    calls.write.parquet(str(tmp_path / "calls"))
    plain = pairing.match(read)
    want = pairing.run_stats(read, plain, pairing.valid_calls(plain, syscall_dim(spark, IDS)), 10.0).first().asDict()
    assert report.row(spark, 10.0).first().asDict() == want and want["mismatches"] > 0


def test_the_dimension_is_the_side_that_is_built(spark, data):
    from tracelake.plans import queries

    for q in (queries.pair_calls, queries.durations_gaps, queries.comm_asof, queries.gaps_by_call):
        plan = q(spark, data)._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.splitlines() if "Join [" in x and "enter_trace_id" in x]
        assert lines and all("BroadcastHashJoin" in x and "BuildRight" in x for x in lines), plan


def test_stacks_with_looked_up_levels(spark):
    t = Trace(pid=10, tid=11).open(3, path="/a/b/x", comm="one").call("read", 7, fd=3).call("close", 0, fd=3).open(3, pid=20, tid=21, path="y", comm="two")
    calls = enriched_calls(t.frame(spark), syscall_dim(spark, IDS))
    tables = stacks.Tables(spark.createDataFrame([(10, "ann"), (10, "ann")], "pid bigint, user string"), spark.createDataFrame([("/", "sda"), ("/a", "sdb")], "mount string, device string"), [("B", "/b/")])
    got = {r["stack"]: r["value"] for r in stacks.stacks(calls, ("user", "device", "mount", "directory", "bucket", "transition"), tables=tables).collect()}
    assert got == {
        "ann;sdb;/a;/a/b;B;start->openat": 1, "ann;sdb;/a;/a/b;B;openat->read": 1, "ann;sdb;/a;/a/b;B;read->close": 1, "?;none;none;.;OTHER;start->openat": 1,
    }
    assert {r["stack"]: r["value"] for r in stacks.stacks(calls, ("comm",), "bytes").collect()} == {"one": 7, "two": 0}
    plain = aggregate.collapse(aggregate.agg6(calls), syscall_dim(spark, IDS), ("comm", "path", "flags", "tracepoint", "pid", "tid"), "duration")
    assert sorted(stacks.stacks(calls, ("comm", "path", "flags", "tracepoint", "pid", "tid"), "duration").collect()) == sorted(plain.collect())
    with pytest.raises(ValueError, match="no level"):
        stacks.stacks(calls, ("color",))
    with pytest.raises(ValueError, match="users"):
        stacks.stacks(calls, ("user",))


def test_tree_of_any_depth(spark):
    rows = [("a", 1), ("a;b", 2), ("a;b;c;d;e", 4), ("a;x", 8), ("z", 16), ("", 32), (None, 64), ("a;b", 128)]
    got = {r["node"]: (r["parent"], r["frame"], r["depth"], r["total"], r["self"]) for r in stacks.flame_tree(spark.createDataFrame(rows, "stack string, value bigint")).collect()}
    assert got == {
        "a": (None, "a", 1, 143, 1), "a;b": ("a", "b", 2, 134, 130), "a;b;c": ("a;b", "c", 3, 4, 0), "a;b;c;d": ("a;b;c", "d", 4, 4, 0), "a;b;c;d;e": ("a;b;c;d", "e", 5, 4, 4),
        "a;x": ("a", "x", 2, 8, 8), "z": (None, "z", 1, 16, 16), "": (None, "", 1, 32, 32),
    }


def test_calls_of_unknown_ids_are_kept_apart(spark):
    t = Trace().open(3).call("mkdir", 0, path="/m")
    dim = syscall_dim(spark, {k: v for k, v in IDS.items() if k != "mkdir"})
    assert [r["enter_trace_id"] for r in pairing.unknown_calls(pairing.match(t.frame(spark)), dim).collect()] == [IDS["mkdir"]]
    assert pairing.valid_calls(pairing.match(t.frame(spark)), dim).count() == 1


def test_approximate_profile(spark):
    rows = spark.range(1_000).select(F.lit("g").alias("g"), F.col("id").alias("latency_ns"), (F.col("id") % 10).alias("bytes"))
    r = profile.approx_profile(rows, ["g"]).first()
    assert r["count"] == 1_000 and r["latency_quantiles"] == pytest.approx([499, 949, 989], abs=2)


def test_dump_places_over_spans_of_many_files(spark, data, monkeypatch):
    """Files follow the session's partitions, and records are numbered in spans of bytes, not a file in one task."""
    import os

    from tracelake.plans import queries
    from tracelake.sources.trace import trace

    made, place = [], queries.place
    monkeypatch.setattr(queries, "place", lambda s: made.append(place(s)) or made[-1])
    monkeypatch.setattr(queries, "SPAN_BYTES", 10_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = [(r["place"], r["time_ns"]) for r in queries.dump_round_trip(spark, data).select("place", "time_ns").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([f for f in os.listdir(made[0].removeprefix("file://")) if f.endswith(".bin") and not f.startswith(".")]) == 9
    assert sorted(got) == list(enumerate(r[0] for r in trace(spark, data).orderBy("seq").select("time_ns").collect()))
