"""The stream gives the calls of the batch form, also for events that come in another order over several batches."""

import random

from pyspark.sql import functions as F
from test_calls import FOLD_DIM, fold
from traces import IDS, Trace, random_trace

from tracelake.streaming import pairs


def stream(spark, tmp_path, batches, **k):
    folder, out = tmp_path / "events", []
    t = Trace()
    for i, rows in enumerate(batches):
        t.rows = rows
        t.frame(spark).coalesce(1).write.mode("append").parquet(str(folder))
        calls = pairs.pair_stream(pairs.read_events(spark, str(folder), files_per_trigger=1), FOLD_DIM, delay="2 seconds", **k)
        pairs.run_once(calls, str(tmp_path / "checkpoint"), lambda df, _: out.extend(r.asDict(recursive=True) for r in df.collect()))
    return sorted(out, key=lambda r: (r["exit_time_ns"], r["exit_seq"]))


def spread(t, seed):
    """The rows with seconds between them, shuffled a little, and a late one of another process that moves the watermark on."""
    for r in t.rows:
        r["time_ns"] *= 1_000_000
    rows, r = sorted(t.rows, key=lambda e: (e["time_ns"], e["seq"])), random.Random(seed)
    end = Trace(pid=99, tid=99).add("enter", "read", fd=1).rows[0] | {"seq": 10_000, "time_ns": rows[-1]["time_ns"] + 60_000_000_000}
    parts = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    for p in parts:
        r.shuffle(p)
    return [*parts, [end], [end | {"seq": 10_001, "time_ns": end["time_ns"] + 1}]]


def test_stream_equals_fold(spark, tmp_path):
    t = random_trace(5, 60)
    batches = spread(t, 1)
    assert stream(spark, tmp_path, batches) == fold(t)


def test_stream_with_filters(spark, tmp_path):
    t = random_trace(6, 60)
    batches = spread(t, 2)
    assert stream(spark, tmp_path, batches, path="/a", comm="app1") == fold(t, path="/a", comm="app1")


def test_calls_of_hours_are_kept(spark, tmp_path):
    # spread() makes milliseconds of the nanoseconds: two hours between the events.
    t = Trace().add("enter", "read", fd=1).call("write", 5, dt=7_200_000, tid=12, fd=1).add("exit", "read", dt=7_200_000, ret=3)
    batches = spread(t, 3)
    want = fold(t)
    assert [r["name"] for r in want] == ["write", "read"] and want[1]["duration"] > 5 * 3_600_000_000_000
    assert stream(spark, tmp_path / "all", batches) == want
    assert [r["name"] for r in stream(spark, tmp_path / "limit", batches, max_pending_ns=3_600_000_000_000)] == ["write"]


def test_windowed_counts(spark):
    from tracelake.functions.dims import syscall_dim
    from tracelake.plans.calls import completed_calls

    t = Trace(time=0).open(3, dt=1_000_000_000).call("read", fd=3, dt=100_000_000_000)
    counts = pairs.window_counts(completed_calls(t.frame(spark), syscall_dim(spark, IDS)))
    assert {(r["window"]["start"].minute, r["count"]) for r in counts.withColumn("x", F.lit(1)).collect()} == {(0, 1), (3, 1)}


def test_stream_audit(spark, tmp_path):
    t = Trace().add("enter", "read", fd=1).call("write", 5, dt=1_000, tid=12, fd=1).add("enter", "read", fd=2, tid=13).add("exit", "write", ret=1, tid=13).add("exit", "read", dt=7_200_000, ret=3)
    rows = stream_rows(spark, tmp_path, spread(t, 3), max_pending_ns=3_600_000_000_000, audit=True)
    assert [(r["name"], r["tid"], r["outcome"], r["exit_seq"] is None) for r in sorted(rows, key=lambda r: r["tid"])] == [("read", 11, "expired", True), ("write", 12, "completed", False), ("read", 13, "mismatch", False)]


def stream_rows(spark, tmp_path, batches, **k):
    folder, out = tmp_path / "events", []
    t = Trace()
    for rows in batches:
        t.rows = rows
        t.frame(spark).coalesce(1).write.mode("append").parquet(str(folder))
        calls = pairs.pair_stream(pairs.read_events(spark, str(folder), files_per_trigger=1), FOLD_DIM, delay="2 seconds", **k)
        pairs.run_once(calls, str(tmp_path / "checkpoint"), lambda df, _: out.extend(r.asDict(recursive=True) for r in df.collect()))
    return out


def test_stream_from_raw_records_with_snapshots_equals_batch(spark, tmp_path):
    from tracelake.functions.dims import syscall_dim
    from tracelake.operators.aggregate import agg6
    from tracelake.plans.calls import Options, completed_calls, enriched_calls
    from tracelake.sources.raw import encode_events
    from tracelake.sources.trace import proc_exe_snapshot, proc_fd_snapshot

    t = random_trace(8, 60)
    batches = spread(t, 4)
    fds = proc_fd_snapshot(spark.createDataFrame([(10, f, f"/a/snap{f}", "02") for f in range(3, 8)], "pid bigint, fd int, name string, flags_octal string"))
    exes = proc_exe_snapshot(spark.createDataFrame([(100, "/bin/app1"), (201, "/bin/x")], "tid bigint, exe string"))
    folder, own = tmp_path / "raw", Trace()
    for i, rows in enumerate(batches):
        own.rows = rows
        encode_events(own.frame(spark)).coalesce(1).write.mode("append").parquet(str(folder))
        calls = pairs.pair_stream(pairs.read_raw(spark, str(folder), 1), FOLD_DIM, "2 seconds", path="/a", proc_fd=fds, proc_exe=exes)
        pairs.run_once(calls, str(tmp_path / "checkpoint"), pairs.add_to_aggregate(str(tmp_path / "saved")))
    o = Options(path="/a", filter_first=True)
    events = raw_again(spark, t)
    want = agg6(enriched_calls(events, syscall_dim(spark, IDS), o, fds, exes), with_bytes=True)
    assert sorted(pairs.saved_aggregate(spark, str(tmp_path / "saved")).collect()) == sorted(want.collect()) != []
    assert completed_calls(events, syscall_dim(spark, IDS), o, fds, exes).count() > 10


def raw_again(spark, t):
    from tracelake.sources.raw import decode_events, encode_events

    return decode_events(encode_events(t.frame(spark)))


def test_two_hosts_with_initial_state_equal_batch(spark, tmp_path):
    from tracelake.functions.dims import syscall_dim
    from tracelake.operators.aggregate import agg6
    from tracelake.plans.calls import Options, enriched_calls
    from tracelake.schema import EVENTS
    from tracelake.sources.trace import proc_exe_snapshot, proc_fd_snapshot

    run, traces = ("host",), {"h0": random_trace(11, 60), "h1": random_trace(12, 60)}
    parts = {h: spread(t, 5) for h, t in traces.items()}
    schema = EVENTS + ", host string"
    columns = [c.split(" ")[0] for c in EVENTS.split(", ")]
    frame = lambda rows: spark.createDataFrame([(*(r[c] for c in columns), h) for h, r in rows], schema)
    fds = proc_fd_snapshot(spark.createDataFrame([("h0", 10, f, f"/a/h0-{f}", "02") for f in range(3, 8)] + [("h1", 10, 3, "/b/h1", None)], "host string, pid bigint, fd int, name string, flags_octal string"), run)
    exes = proc_exe_snapshot(spark.createDataFrame([("h0", 10, 100, "/bin/app1"), ("h1", 20, 201, "/bin/x")], "host string, pid bigint, tid bigint, exe string"), run)
    for k in range(4):
        frame([(h, r) for h in parts for r in parts[h][k]]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        calls = pairs.pair_stream(pairs.read_events(spark, str(tmp_path / "in"), 1, "host string"), FOLD_DIM, "2 seconds", path="/a", proc_fd=fds, proc_exe=exes, run=run)
        pairs.run_once(calls, str(tmp_path / "checkpoint"), pairs.add_to_aggregate(str(tmp_path / "saved")))
    assert calls.columns[:2] == ["host", "pid"] and "Join" not in calls._jdf.queryExecution().analyzed().toString()
    events = frame([(h, r) for h, t in traces.items() for r in t.rows])
    want = agg6(enriched_calls(events, syscall_dim(spark, IDS), Options(path="/a", filter_first=True, run=run), fds, exes), with_bytes=True)
    assert sorted(pairs.saved_aggregate(spark, str(tmp_path / "saved")).collect()) == sorted(want.collect()) != []


def test_what_is_kept_of_a_process_ends(spark, tmp_path):
    t = Trace().open(3, path="/a/x", comm="one").call("read", 5, fd=3).add("enter", "write", fd=3).open(4, pid=20, tid=21, comm="two")
    batches = spread(t, 7)
    far = batches[-1][0]
    later = [far | {"seq": 10_002, "time_ns": far["time_ns"] + 7_200_000_000_000}, far | {"seq": 10_003, "time_ns": far["time_ns"] + 7_200_000_000_001}]
    rows = stream_rows(spark, tmp_path, [*batches, *[[x] for x in later]], audit=True, idle_ns=3_600_000_000_000)
    done = [(r["pid"], r["name"]) for r in rows if r["outcome"] == "completed"]
    assert sorted(done) == [(10, "openat"), (10, "read"), (20, "openat")]
    gone = sorted((r["pid"], r["outcome"], r["comm"] or (r["file"] or {}).get("name") or r["name"]) for r in rows if r["outcome"] != "completed")
    assert gone[:5] == [(10, "expired", "write"), (10, "forgotten", "/a/x"), (10, "forgotten", "one"), (20, "forgotten", "testfile.txt"), (20, "forgotten", "two")]
    left = spark.read.format("statestore").option("stateVarName", "files").load(str(tmp_path / "checkpoint"))
    assert left.count() == 0 and spark.read.format("statestore").option("stateVarName", "comms").load(str(tmp_path / "checkpoint")).count() == 0


def with_late(t, seed):
    """Batches of ``spread`` and, between them, events of the first half that come when the watermark has long passed them."""
    first, second, *ends = spread(t, seed)
    held, first = [e for e in first if e["seq"] % 9 == 0], [e for e in first if e["seq"] % 9]
    pause = Trace(pid=98, tid=98).add("enter", "read", fd=1).rows[0] | {"seq": 9_000, "time_ns": max(e["time_ns"] for e in first + held) + 2_500_000_000}
    # The watermark of a batch comes from those before it.
    shift = 120_000_000_000
    for e in (*second, *(x for b in ends for x in b)):
        e["time_ns"] += shift
    return [first, [pause], held, second, *ends], {e["seq"] for e in held}


def test_windows_chained_to_the_pairing_with_late_rows(spark, tmp_path):
    t = random_trace(21, 80)
    for e in t.rows:
        e["time_ns"] *= 40  # the windows of a minute get several rows
    batches, held = with_late(t, 8)
    folder, own, out, late = tmp_path / "events", Trace(), [], []
    for rows in batches:
        own.rows = rows
        own.frame(spark).coalesce(1).write.mode("append").parquet(str(folder))
        for name, to in (("windows", out), ("audit", late)):
            calls = pairs.pair_stream(pairs.read_events(spark, str(folder), 1), FOLD_DIM, "2 seconds", audit=True, event_time=True)
            result = pairs.window_counts(calls) if name == "windows" else calls.where("outcome = 'late'").drop("ts")
            pairs.run_once(result, str(tmp_path / f"checkpoint-{name}"), lambda df, _, to=to: to.extend(r.asDict(recursive=True) for r in df.collect()))
    behind = {r["enter_seq"] or r["exit_seq"] for r in late}
    assert behind and behind <= held
    t.rows = [e for e in t.rows if e["seq"] not in behind]
    want = {}
    for c in fold(t):
        k = (c["exit_time_ns"] // 60_000_000_000, c["enter_trace_id"], c["comm"].strip(), c["pid"], c["tid"])
        n, d, g = want.get(k, (0, 0, 0))
        want[k] = (n + 1, d + c["duration"], g + c["gap"])
    got = {}
    for r in out:
        k = (int(r["window"]["start"].timestamp()) // 60, r["trace_id"], r["comm"], r["pid"], r["tid"])
        n, d, g = got.get(k, (0, 0, 0))
        got[k] = (n + r["count"], d + r["duration"], g + r["duration_to_prev"])
    assert got == want and len({k[0] for k in want}) > 1


def test_report_of_the_stream(spark, tmp_path):
    from tracelake.streaming.report import StreamReport

    t = random_trace(31, 40)
    folder, own, out, report = tmp_path / "events", Trace(), [], StreamReport()
    batches = spread(t, 9)
    n = sum(map(len, batches))
    batches.append([batches[0][0] | {"seq": 20_000}])  # an event that comes far too late
    for rows in batches:
        own.rows = rows
        own.frame(spark).coalesce(1).write.mode("append").parquet(str(folder))
    spark.streams.addListener(report)
    try:
        events = pairs.read_events(spark, str(folder), 1)
        calls = report.calls(pairs.pair_stream(report.events(events), FOLD_DIM, "2 seconds", audit=True))
        pairs.run_once(calls, str(tmp_path / "checkpoint"), lambda df, _: out.extend(r["outcome"] for r in df.collect()))
        row = report.row(spark, 2.0, wait=30).first()
    finally:
        spark.streams.removeListener(report)
    assert (row["tracepoints"], row["late"]) == (n + 1, 1) and out.count("late") == 1
    assert row["syscalls_after_filter"] == out.count("completed") == len(fold(t)) > 0
    assert row["mismatches"] == out.count("mismatch") and row["syscalls"] == row["mismatches"] + row["syscalls_after_filter"]
    assert row["tracepoints_per_second"] == (n + 1) / 2


def test_a_batch_that_is_tried_again_counts_once(spark):
    from types import SimpleNamespace

    from pyspark.sql import Row

    from tracelake.streaming.report import StreamReport

    report = StreamReport()
    for batch, n in ((0, 5), (1, 7), (1, 6), (2, 1)):
        report.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(observedMetrics={report._events: Row(tracepoints=n)}, runId="r", batchId=batch)))
    assert report.row(spark, 1.0).first()["tracepoints"] == 12
