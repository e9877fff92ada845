"""Text of flags, files and calls; aggregates and stacks; profiles and patterns; raw records; sinks."""

import datetime

import pytest
from pyspark.sql import functions as F
from traces import IDS, Trace

from tracelake.functions import dims, text
from tracelake.functions.render import HEADER, pair_text
from tracelake.operators import aggregate, patterns, profile, views
from tracelake.plans.calls import completed_calls, enriched_calls
from tracelake.schema import AGG6
from tracelake.sources import raw, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("flags", "want"),
    [(0, "O_RDONLY"), (1, "O_WRONLY"), (2, "O_RDWR"), (3, "O_WRONLY|O_RDWR|O_ACCMODE"), (577, "O_WRONLY|O_CREAT|O_TRUNC"), (0x101000, "O_RDONLY|O_DSYNC|O_SYNC"), (-1, "O_NONE")],
)
def test_flags_text(spark, flags, want):
    assert one(spark, text.flags_text(F.lit(flags))) == want


def test_scalars(spark):
    assert one(spark, text.path_stack(F.lit("/a/b"))) == ";/a;/b"
    assert one(spark, text.nul_text(F.lit(b"test string" + bytes(117)))) == "test string"
    assert one(spark, text.trim_comm(F.lit("\t app "))) == "app"
    assert one(spark, text.octal(F.lit("0100002"))) == 0o100002
    assert one(spark, text.basename(F.lit("/usr/bin/tool"))) == "tool"
    assert one(spark, text.has_flags(F.lit(-1), 1)) is False and one(spark, text.has_flags(F.lit(0x402), 0x400)) is True


def test_dimension(spark):
    assert sum(len(n.split()) for n in dims.KINDS.values()) == 109
    assert [dims.io_class(n) for n in ("read", "readahead", "preadv2", "vmsplice", "write", "pwrite64", "close")] == ["read", "none", "read", "transfer", "write", "write", "none"]
    listing = spark.createDataFrame([(700, "sys_enter_openat"), (699, "sys_exit_openat"), (1, "sched_switch")], "id int, tracepoint string")
    assert sorted(dims.listing_dim(listing).collect()) == [(699, "openat", "exit", "ret", "none"), (700, "openat", "enter", "open", "none")]


def test_row_stream_of_all_calls(spark, data):
    from tracelake.plans.calls import completed_calls
    from tracelake.plans.oracle import NAMES
    from tracelake.plans.queries import QUERIES
    from tracelake.sources.trace import trace

    def line(r):
        f = r["file"]
        head = f"{r['gap']:08d},{r['duration']:08d},{r['comm'] or ''}@{r['pid']}.{r['tid']},{r['name']}=>{'' if r['ret'] is None else r['ret']},"
        if f is None:
            return head + "N:file"
        flags = "O_NONE" if f["flags"] == -1 else "|".join(["O_RDONLY"] * (f["flags"] & 3 == 0) + [n for n, m in NAMES.items() if f["flags"] & m == m])
        name = f["name"] or ""
        if f["kind"] == "fd":
            return f"{head}{name or 'E:name'}%({f['fd']},{flags})"
        return f"{head}old:{f['oldname']} ->new:{name}%({flags})" if f["kind"] == "name" else f"{head}pathname:{name}%({flags})"

    calls = completed_calls(trace(spark, data)).collect()
    got = {r["exit_seq"]: r["value"] for r in QUERIES["render_pairs_full"](spark, data).collect()}
    assert got == {r["exit_seq"]: line(r) for r in calls} and {r["name"] for r in calls} >= {"read", "write", "dup", "close", "fcntl"}
    assert any(",read=>" in v and "/" in v for v in got.values()) and any(",read=>" in v and "E:name%(" in v for v in got.values())


def test_rows(spark, tmp_path):
    t = Trace().open(42).call("rename", 0, oldname="a", newname="b").call("newstat", -2, path="/x").call("sync").call("read", 7, fd=9)
    calls = completed_calls(t.frame(spark), dims.syscall_dim(spark, IDS))
    rows = [r[0] for r in calls.orderBy("exit_seq").select(pair_text()).collect()]
    assert rows == [
        "00000000,00000100,testcomm@10.11,openat=>42,testfile.txt%(42,O_RDWR)",
        "00000100,00000100,testcomm@10.11,rename=>0,old:a ->new:b%(O_NONE)",
        "00000100,00000100,testcomm@10.11,newstat=>-2,pathname:/x%(O_NONE)",
        "00000100,00000100,testcomm@10.11,sync=>0,N:file",
        "00000100,00000100,testcomm@10.11,read=>7,E:name%(9,O_NONE)",
    ]
    sinks.write_rows(calls, str(tmp_path / "rows"))
    lines = [x for p in sorted((tmp_path / "rows").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0] == HEADER and [x for x in lines if x != HEADER] == rows


def agg(spark, *rows):
    return spark.createDataFrame([(p, 858, "c", 1, 2, f, n, d, g, 0) for p, f, n, d, g in rows], AGG6)


def test_merge_is_associative(spark):
    a, b, c = agg(spark, ("p1", 2, 1, 1000, 100)), agg(spark, ("p1", 2, 2, 2000, 200), ("p2", 0, 5, 1, 1)), agg(spark, ("p2", 0, 55, 9, 9))
    left, right = aggregate.merge(aggregate.merge(a, b), c), aggregate.merge(a, aggregate.merge(b, c))
    assert sorted(left.collect()) == sorted(right.collect())
    assert {(r["path"], r["count"], r["duration"], r["duration_to_prev"]) for r in left.collect()} == {("p1", 3, 3000, 300), ("p2", 60, 10, 10)}


def test_collapse_and_sinks(spark, tmp_path):
    t = Trace().open(42, path="/a/b", comm=" app ").call("read", 5, fd=42).call("read", -1, fd=42)
    dim = dims.syscall_dim(spark, IDS)
    calls = enriched_calls(t.frame(spark), dim)
    a = aggregate.agg6(calls, with_bytes=True)
    assert {(r["trace_id"], r["count"], r["bytes"], r["comm"]) for r in a.collect()} == {(798, 1, 0, "app"), (858, 2, 5, "app")}
    stacks = aggregate.collapse(a, dim)
    assert {tuple(r) for r in stacks.collect()} == {("10;;/a;/b;enter_openat", 1), ("10;;/a;/b;enter_read", 2)}
    assert {r[0] for r in aggregate.lines(aggregate.collapse(a, dim, ("comm", "flags"), "duration")).collect()} == {"app;O_RDWR 300"}
    for call in (lambda: aggregate.collapse(a, dim, ("nope",)), lambda: aggregate.measure("nope")):
        with pytest.raises(ValueError):
            call()
    assert a.agg(F.sum("duration")).first() == aggregate.collapse(a, dim, count="duration").agg(F.sum("value")).first()
    for run in ("r1", "r2"):
        sinks.save_aggregate(a, str(tmp_path / "agg"), "h", run, "t")
    assert {r["count"] for r in aggregate.merge(sinks.load_aggregate(spark, str(tmp_path / "agg"))).collect()} == {2, 4}
    first = sinks.write_collapsed(stacks, str(tmp_path / "run"), ("pid", "path"), "count")
    assert sinks.write_collapsed(stacks.limit(0), str(tmp_path / "run"), ("pid", "path"), "count") == first and spark.read.text(first).count() == 2
    remote = sinks.write_collapsed(stacks, f"file://{tmp_path}/uri", ("pid", "path"), "count")
    assert remote.startswith("file:///") and list(tmp_path.glob("uri.pid_path-by-count.collapsed/part-*")) and spark.read.text(remote).count() == 2
    nodes = aggregate.rollup_paths(a, 2)
    assert {(r["level1"], r["level2"], r["count"]) for r in nodes.collect()} == {(None, None, 3), ("a", None, 3), ("a", "b", 3)}


def series(spark, values, step=1):
    t0 = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("g", t0 + datetime.timedelta(seconds=i * step), v, v * 2) for i, v in enumerate(values)], "g string, ts timestamp_ntz, bytes bigint, latency_ns bigint")


@pytest.mark.parametrize("n", [1, 2, 20, 100])
def test_quantile_places(spark, n):
    r = profile.io_profile(series(spark, [*range(n)]), ["g"]).first()
    assert (r["bytes_median"], r["bytes_p95"], r["bytes_p99"]) == (n // 2, min(n - 1, int(n * 0.95)), min(n - 1, int(n * 0.99)))
    assert (r["count"], r["total_bytes"], r["latency_mean"]) == (n, n * (n - 1) // 2, n * (n - 1) // n)
    assert profile.io_profile(series(spark, [*range(n)]), ["g"], split=7).first() == r
    m = profile.stats_map(profile.io_profile(series(spark, [*range(n)]), ["g"]), ["g"]).first()
    assert m["latency"]["max"] == 2 * (n - 1) and m["bytes"]["p95"] == r["bytes_p95"]


def test_bursts(spark):
    def run(*values):
        whole, spread = (tuple(patterns.bursts(series(spark, values), ["g"], split_us=s).select("burst_count", "burst_us").first()) for s in (None, 2_000_000))
        assert whole == spread
        return whole

    assert run(2000, 3000, 1, 1, 5000, 1000) == (2, 3_000_000)
    assert run(1, 2000, 2000) == (0, 0) and run(2000) == (0, 0)


def test_periodicity(spark):
    def run(values, **k):
        whole, spread = (tuple(patterns.periodicity(series(spark, values), ["g"], split_us=s, **k).select("is_periodic", "best_lag", "period_us").first()) for s in (None, 3_000_000))
        assert whole == spread
        return whole

    assert run([0, 0, 9] * 8) == (True, 3, 3_000_000) and run([0, 0, 9] * 8, max_lag=2) == (False, 0, 0)
    assert run([1, 2, 3]) == (False, 0, 0) and run([5] * 10, normalized=True) == (False, 0, 0)
    assert run([0, 0, 9] * 8, normalized=True) == (True, 3, 3_000_000)


def test_trend(spark):
    def run(values, **k):
        return tuple(patterns.trend(series(spark, values), ["g"], **k).select("slope", "direction").first())

    assert run([1, 3, 5], unit="s") == (pytest.approx(2.0), "increasing") and run([5, 3, 1], unit="s")[1] == "decreasing"
    assert run([1, 3, 5])[1] == "stable" and run([4]) == (0.0, "") and run([1, 2], unit="s", threshold=2.0)[1] == "stable"
    assert patterns.trend(series(spark, [1, 9], step=0), ["g"]).first()["direction"] == "stable"
    assert patterns.analyze(series(spark, [1, 9]), ["g"]).first()["burst_count"] == 0


def test_raw_records(spark):
    payload = bytes.fromhex("01000000" "1e030000" "87d6120000000000" "0a000000" "0b000000" "02000000") + b"testfile.txt".ljust(256, b"\0") + b"testcomm".ljust(16, b"\0")
    ret = bytes.fromhex("08000000" "1d030000" "88d6120000000000" "feffffffffffffff" "0a000000" "0b000000" "00000000")
    frame = spark.createDataFrame([(1, payload), (2, ret), (3, b""), (4, b"\x07" + payload[1:]), (5, ret[:20])], "seq bigint, payload binary")
    a, b = sorted(raw.decode_events(frame).collect())
    assert (a["event_type"], a["phase"], a["trace_id"], a["time_ns"], a["pid"], a["tid"], a["flags"], a["path"], a["comm"]) == (1, "enter", 798, 1234567, 10, 11, 2, "testfile.txt", "testcomm")
    assert (b["phase"], b["trace_id"], b["ret"], b["pid"], b["tid"], b["ret_type"]) == ("exit", 797, -2, 10, 11, 0)
    assert {(r["seq"], r["reason"]) for r in raw.quarantine(frame).collect()} == {(4, "unknown type"), (5, "too short")}
    t = Trace().open(42).call("dup3", 5, fd=42, flags=0x80000).call("fcntl", -1, fd=5, cmd=4, arg=1 << 40).call("rename", oldname="a", newname="ü")
    back = raw.decode_events(raw.encode_events(t.frame(spark))).orderBy("seq").collect()
    assert [r["arg"] for r in back if r["cmd"] == 4] == [1 << 40] and back[6]["newname"] == "ü" and back[1]["ret"] == 42


def test_views(spark):
    t = Trace().open(42, path="/a/b/f").call("read", 5, fd=42).call("read", 5, fd=42).call("sync")
    calls = enriched_calls(t.frame(spark), dims.syscall_dim(spark, IDS))
    a = aggregate.agg6(calls)
    assert {(r[0], r[1]) for r in views.transitions(calls).collect()} == {("openat->read", 1), ("read->read", 1), ("read->sync", 1)}
    assert {(r[0], r[1]) for r in views.path_buckets(calls, "b/").collect()} == {("PATHMATCH", 3), ("OTHER", 1)}
    assert {(r[0], r[1]) for r in views.by_directory(a).collect()} == {("/a/b", 3), (".", 1)}
    mounts = spark.createDataFrame([("/", "d0"), ("/a", "d1"), ("/a/b/f/x", "d2")], "mount string, device string")
    assert {(r[0], r[1], r[2]) for r in views.by_mount(a, mounts).collect()} == {("/a", "d1", 3), ("none", "none", 1)}
    assert {(r[0], r[1]) for r in views.with_user(a, spark.createDataFrame([(10, "root")], "pid bigint, user string")).collect()} == {("root", 4)}
    assert {(r["name"], r["count"]) for r in views.call_times(calls).collect()} == {("openat", 1), ("read", 2), ("sync", 1)} == {(r["name"], r["count"]) for r in views.gaps_by_call(calls).collect()}


HUGE = 1 << 62


def huge_calls(spark):
    """Four threads' calls of 2^62 ns each."""
    t = Trace()
    for i in range(4):
        t.open(3, path="/a/b", pid=10 + i, tid=11 + i).call("read", 1, fd=3, pid=10 + i, tid=11 + i)
    return enriched_calls(t.frame(spark), dims.syscall_dim(spark, IDS)).withColumn("duration", F.lit(HUGE)).withColumn("gap", F.lit(-HUGE))


def test_sums_of_paths_beyond_64_bits(spark):
    from tracelake.plans.queries import _fitted

    nodes = aggregate.rollup_paths(aggregate.agg6(huge_calls(spark).where("name = 'read'")), 1)
    got = {r["level1"]: (r["count"], r["duration"], r["duration_to_prev"]) for r in nodes.collect()}
    assert got == {"a": (4, 4 * HUGE, -4 * HUGE), None: (4, 4 * HUGE, -4 * HUGE)}
    kept = _fitted(nodes)
    assert (kept.schema["count"].dataType.simpleString(), kept.schema["duration"].dataType.simpleString()) == ("bigint", "decimal(38,0)")
    assert {r["level1"]: r["duration"] for r in kept.collect()} == {"a": 4 * HUGE, None: 4 * HUGE}
    assert _fitted(nodes.select((F.col("duration") / 8).cast("decimal(38,0)").alias("x"))).schema.simpleString() == "struct<x:bigint>"


def test_stacks_beyond_64_bits(spark):
    dim = dims.syscall_dim(spark, IDS)
    stacked = aggregate.collapse(aggregate.agg6(huge_calls(spark).where("name = 'read'")), dim, ("comm", "tracepoint"), "durationToPrev")
    assert [tuple(r) for r in stacked.collect()] == [("testcomm;enter_read", -4 * HUGE)]
    assert [r[0] for r in aggregate.lines(stacked).collect()] == [f"testcomm;enter_read {-4 * HUGE}"]


def one_row(df):
    (row,) = df.collect()
    return tuple(row)


def test_sums_by_directory_beyond_64_bits(spark):
    assert one_row(views.by_directory(aggregate.agg6(huge_calls(spark).where("name = 'read'")))) == ("/a", 4, 4 * HUGE)


def test_sums_by_mount_beyond_64_bits(spark):
    mounts = spark.createDataFrame([("/a", "d1")], "mount string, device string")
    assert one_row(views.by_mount(aggregate.agg6(huge_calls(spark).where("name = 'read'")), mounts)) == ("/a", "d1", 4, 4 * HUGE)


def test_gaps_beyond_64_bits(spark):
    assert one_row(views.gaps_by_call(huge_calls(spark).where("name = 'read'"))) == ("read", 4, -4 * HUGE, -HUGE)


def test_transitions_beyond_64_bits(spark):
    assert one_row(views.transitions(huge_calls(spark))) == ("openat->read", 4, -4 * HUGE)


def test_path_buckets_beyond_64_bits(spark):
    assert one_row(views.path_buckets(huge_calls(spark), "/a")) == ("PATHMATCH", 8, 8 * HUGE)


def test_flame_tree_beyond_64_bits(spark):
    from tracelake.operators import stacks

    top = stacks.flame_tree(stacks.stacks(huge_calls(spark), ("comm", "tracepoint"), "duration")).where("depth = 1")
    assert one_row(top.select("node", "total", "self")) == ("testcomm", 8 * HUGE, 0)


def test_bursts_among_equal_rows(spark):
    for values in ((1, 0), (0, 1)):
        rows = [("g", datetime.datetime(2024, 1, 1, 0, 0, s), k, 2_000 * v) for s, k, v in ((0, 0, 0), (1, 1, values[0]), (1, 1, values[1]), (2, 2, 0), (3, 3, 1), (4, 4, values[0]), (4, 4, values[1]), (5, 5, 0))]
        df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, k int, bytes bigint").coalesce(1)
        for split in (None, 2_000_000):
            assert tuple(patterns.bursts(df, ["g"], tie=["k"], split_us=split).select("burst_count", "burst_us").first()) == (2, 1_000_000)
