"""Pairing, files and comms: scenarios, and the batch form against the fold on random traces."""

import pytest
from traces import IDS, KINDS, Trace, random_trace

from tracelake.functions.dims import syscall_dim
from tracelake.functions.text import O_CLOEXEC
from tracelake.operators import fdtable, pairing
from tracelake.plans.calls import Options, completed_calls
from tracelake.streaming.fold import ProcessState, step


@pytest.fixture(scope="module")
def dim(spark):
    return syscall_dim(spark, IDS)


FOLD_DIM = {i: (n, KINDS.get(n, "fd")) for n, i in IDS.items()}


def run(spark, dim, t, **options):
    rows = completed_calls(t.frame(spark), dim, Options(**options)).orderBy("exit_time_ns", "exit_seq").collect()
    return [r.asDict(recursive=True) for r in rows]


def fold(t, by_pid=True, **options):
    states, out = {}, []
    for e in sorted(t.rows, key=lambda e: (e["time_ns"], e["seq"])):
        if (made := step(states.setdefault(e["pid"] if by_pid else 0, ProcessState()), e, FOLD_DIM, **options)) is not None:
            out.append(made)
    return sorted(out, key=lambda r: (r["exit_time_ns"], r["exit_seq"]))


def test_open_with_equal_times(spark, dim):
    (r,) = run(spark, dim, Trace().open(dt=0))
    assert (r["file"]["name"], r["comm"], r["ret"], r["duration"], r["gap"]) == ("testfile.txt", "testcomm", 42, 0, 0)


def test_pairing_edges(spark, dim):
    t = Trace().add("exit", "read", ret=1).add("enter", "read", fd=1).add("enter", "read", 5, fd=2).add("exit", "read", 5, ret=3).add("exit", "read", ret=4)
    (r,) = run(spark, dim, t)
    assert (r["file"]["fd"], r["duration"]) == (2, 5)
    assert run(spark, dim, Trace().add("exit", "read", ret=0).add("exit", "openat", ret=0)) == []
    assert run(spark, dim, Trace().add("enter", "openat", path="a", comm="b", flags=0)) == []


def test_mismatched_ids_are_kept_for_the_audit(spark, dim):
    t = Trace().add("enter", "read", fd=3).add("exit", "write", ret=1).add("enter", "openat").add("exit", "read", ret=1)
    matched = pairing.match(t.frame(spark))
    assert pairing.mismatches(matched).count() == 2 and run(spark, dim, t) == []
    stats = pairing.run_stats(t.frame(spark), matched, pairing.valid_calls(matched, dim), 2.0).first()
    assert (stats["tracepoints"], stats["mismatches"], stats["syscalls"], stats["syscalls_after_filter"], stats["tracepoints_per_second"]) == (4, 2, 2, 0, 2.0)


def test_two_threads(spark, dim):
    t = Trace()
    for phase, tid, f in (("enter", 11, {"path": "a", "comm": "c", "flags": 0}), ("enter", 12, {"path": "b", "comm": "c", "flags": 0}), ("exit", 12, {"ret": 4}), ("exit", 11, {"ret": 3})):
        t.add(phase, "openat", 10, tid=tid, **f)
    assert [r["file"]["name"] for r in run(spark, dim, t)] == ["b", "a"]


def test_names_of_files(spark, dim):
    t = Trace().call("mkdir", path="/d").call("rename", oldname="/o", newname="/n").call("creat", 47, path="/c").call("read", fd=47).call("sync").call("read", fd=99).call("creat", -1, path="/e")
    r = run(spark, dim, t)
    assert [x["file"] and x["file"]["name"] for x in r] == ["/d", "/n", "/c", "/c", None, "", None]
    assert r[3]["file"]["flags"] == 577 and r[5]["file"] == {"kind": "fd", "fd": 99, "name": "", "oldname": None, "flags": -1, "from_snapshot": True}


def test_duplicates_and_close(spark, dim):
    t = Trace().open(42).call("dup3", 43, fd=42, flags=O_CLOEXEC).call("read", fd=43).call("close", fd=42).call("read", fd=43).call("read", fd=42).call("dup2", 50, fd=43)
    t.call("read", fd=50).call("close", -1, fd=43).call("read", fd=43)
    r = run(spark, dim, t)
    assert [x["file"]["name"] for x in r] == ["testfile.txt"] * 5 + [""] + ["testfile.txt"] * 3 + [""]
    assert r[2]["file"]["flags"] == 2 | O_CLOEXEC == r[7]["file"]["flags"] and r[3]["file"]["flags"] == 2


def test_fcntl(spark, dim):
    t = Trace().open(42, flags=2).call("fcntl", fd=42, cmd=4, arg=0xC00).call("fcntl", fd=42, cmd=4, arg=0x4401).call("fcntl", 60, fd=42, cmd=1030, arg=0).call("read", fd=60).call("fcntl", -1, fd=42, cmd=4, arg=0x800).call("read", fd=42)
    t.call("fcntl", -22, fd=42, cmd=4, arg=0x800).call("read", fd=42)
    r = run(spark, dim, t)
    assert [x["file"]["flags"] for x in r[1:5]] == [0xC00, 0x4400, 0x4400, 0x4400 | O_CLOEXEC] and [x["file"]["flags"] for x in r[5:]] == [0x4400] * 4
    assert run(spark, dim, t, strict_minus_one=True)[-1]["file"]["flags"] == 0x800


def test_long_chain_of_duplicates(spark, dim):
    t = Trace().open(100)
    for i in range(20):
        t.call("dup", 101 + i, fd=100 + i)
    assert run(spark, dim, t.call("read", fd=120))[-1]["file"]["name"] == "testfile.txt"


def test_comm_goes_to_the_thread(spark, dim):
    t = Trace().open(comm="testapp").call("read", fd=42).call("newstat", path="/x").call("read", fd=42, tid=111).open(-2, comm="other").call("read", fd=42)
    assert [r["comm"] for r in run(spark, dim, t)] == ["testapp", "testapp", "testapp", "", "", "other"]
    exe = spark.createDataFrame([(111, "/usr/bin/tool")], "tid bigint, exe string")
    from tracelake.sources.trace import proc_exe_snapshot

    rows = completed_calls(t.frame(spark), dim, proc_exe=proc_exe_snapshot(exe)).where("tid = 111").collect()
    assert [r["comm"] for r in rows] == ["tool"]


def test_snapshot_of_open_files(spark, dim):
    from tracelake.sources.trace import proc_fd_snapshot

    snap = proc_fd_snapshot(spark.createDataFrame([(10, 7, "/snap", "0100002"), (10, 8, "/none", None)], "pid bigint, fd int, name string, flags_octal string"))
    t = Trace().call("read", fd=7).call("dup", 9, fd=7).call("read", fd=9).call("read", fd=8).call("read", fd=7, pid=20, tid=21)
    r = [x["file"] for x in completed_calls(t.frame(spark), dim, proc_fd=snap).orderBy("exit_seq").collect()]
    assert [(f["name"], f["flags"], f["from_snapshot"]) for f in r] == [("/snap", 0o100002, True)] * 3 + [("/none", -1, True), ("", -1, True)]


def test_filters_and_gate(spark, dim):
    t = Trace().open(3, path="/var/log/a", comm="nginx-w").open(4, path="/etc/n", comm="nginx").open(5, path="/var/log/b", comm="apache", tid=12)
    assert [r["file"]["name"] for r in run(spark, dim, t, comm="nginx", path="/var/log")] == ["/var/log/a"]
    assert run(spark, dim, Trace().call("read", fd=3), comm="test") == [] and len(run(spark, dim, Trace().call("read", fd=3))) == 1
    t = Trace().call("rename", oldname="/tmp/a", newname="/x").call("rename", oldname="/x", newname="/tmp/a").call("rename", oldname="/x", newname="/y").call("sync").call("newstat", path="/tmp")
    assert [r["name"] for r in run(spark, dim, t, path="/tmp")] == ["rename", "rename", "newstat"]
    with pytest.raises(ValueError):
        Options(comm="x" * 17) and run(spark, dim, t, comm="x" * 17)


def test_gap_counts_kept_calls_only(spark, dim):
    t = Trace().open(3, path="/a", comm="app").call("sync").call("read", fd=3)
    assert [r["gap"] for r in run(spark, dim, t)] == [0, 100, 100]
    assert [r["gap"] for r in run(spark, dim, t, path="/a")] == [0, 300]


@pytest.mark.parametrize("options", [{}, {"path": "/a"}])
def test_batch_equals_fold_on_random_traces(spark, dim, options):
    # Filters on calls come after the table of files in the batch form.
    for seed in range(4):
        t = random_trace(seed)
        want, got = fold(t, **options, filter_first=False), run(spark, dim, t, **options)
        assert got == want
        assert run(spark, dim, t, **options, split_ns=500) == want


def test_scope_over_all_processes(spark, dim):
    t = Trace().open(42, pid=10, tid=11).call("read", fd=42, pid=20, tid=21)
    assert run(spark, dim, t)[1]["file"]["name"] == "" and run(spark, dim, t, scope="fd")[1]["file"]["name"] == "testfile.txt"


def test_empty(spark, dim):
    from tracelake.schema import EVENTS

    assert completed_calls(spark.createDataFrame([], EVENTS), dim).collect() == []
    assert fdtable.resolve(fdtable.versions(pairing.valid_calls(pairing.match(spark.createDataFrame([], EVENTS)), dim)), spark.createDataFrame([], fdtable.NO_FDS)).collect() == []


@pytest.mark.parametrize("options", [{"path": "/a"}, {"comm": "app1"}, {"path": "/a", "comm": "app1"}])
def test_filter_first_equals_fold_on_random_traces(spark, dim, options):
    for seed in (1, 5):
        t = random_trace(seed, 150)
        assert run(spark, dim, t, **options, filter_first=True) == fold(t, **options, filter_first=True)


def test_hosts_do_not_meet(spark, dim):
    from pyspark.sql import functions as F

    a, b = random_trace(2), random_trace(3)
    both = a.frame(spark).withColumn("host", F.lit("a")).unionByName(b.frame(spark).withColumn("host", F.lit("b"))).unionByName(b.frame(spark).withColumn("host", F.lit(None).cast("string")))
    for options in ({"split_ns": 500}, {"comm": "app1", "path": "/a", "filter_first": True}):
        rows = [r.asDict(recursive=True) for r in completed_calls(both, dim, Options(run=("host",), **options)).orderBy("exit_time_ns", "exit_seq").collect()]
        for host, t in (("a", a), ("b", b), (None, b)):
            k = {x: v for x, v in options.items() if x in ("comm", "path", "filter_first")}
            assert [{x: v for x, v in r.items() if x != "host"} for r in rows if r["host"] == host] == fold(t, **{"filter_first": False} | k)


def test_filter_first_with_a_long_chain_of_duplicates_that_fail(spark, dim):
    t = Trace().open(42, path="/a")
    for i in range(70):
        t.call("dup", 101 + i, fd=100 + i)
    t.call("dup", 100, fd=42)
    for i in range(70):
        t.call("dup", 101 + i, fd=100 + i)
    got = run(spark, dim, t.call("read", fd=170), path="/a", filter_first=True)
    assert got == fold(t, path="/a", filter_first=True) and len(got) == 73 and got[-1]["file"]["name"] == "/a"


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_duplicates_that_fail_over_chunks(spark, chunks):
    """The fold in chunks against a plain one, over few processes, null ones too, whose duplicates meet the snapshot."""
    import random

    from tracelake.operators import passing

    r, rows, states, want = random.Random(chunks), [], {}, set()
    for i in range(400):
        host, scope, fd, src, snap = r.choice(("a", None)), r.choice((1, 1, 1, None)), r.choice((3, 4, 5, 6, None)), r.choice((3, 4, 5, 6)), r.random() < 0.3
        what = r.choice((passing.LOST, passing.NO, passing.YES, *[passing.LINK] * 7))
        rows.append((host, scope, i, i // 2, i, fd, src, what, snap))
        own = states.setdefault((host, scope), {})
        if what != passing.LINK:
            own[fd] = what
        elif own.get(src, passing.LOST) == passing.YES or (own.get(src, passing.LOST) == passing.LOST and snap):
            own[fd] = passing.YES
        else:
            want.add((host, i))
    df = spark.createDataFrame(rows, "host string, scope bigint, vid bigint, exit_time_ns bigint, exit_seq bigint, fd int, src int, what int, snap boolean").repartition(3)
    got = [tuple(x) for x in passing.failing(df, ("host",), chunks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
