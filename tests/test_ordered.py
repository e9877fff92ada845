"""Looking back and numbering over spans of equal rows."""

import random

import pytest
from pyspark.sql import functions as F

from traces import IDS, random_trace
from tracelake.functions.dims import syscall_dim
from tracelake.operators import fdtable, ordered, pairing
from tracelake.operators.ordered import Rows, look_back, look_backs, places
from tracelake.plans.calls import Options, completed_calls
from tracelake.scratch import cut

SCHEMA = "k bigint, time_ns bigint, seq bigint, v string"


def crowd(n, times=1):
    """``n`` rows, nine in ten of one key, all at ``times`` times; the rest of few keys, null too."""
    r = random.Random(n + times)
    return [(1 if r.random() < 0.9 else r.choice((2, 3, None)), r.randrange(times), i, r.choice((None, None, None, f"v{i}"))) for i in range(n)]


def by_hand(rows, current):
    out, last, at = {}, {}, {}
    for k, t, s, v in sorted(rows, key=lambda x: (x[1], x[2])):
        seen = v if current and v is not None else last.get(k)
        out[s] = (seen, at.get(k, 0))
        last[k], at[k] = v if v is not None else last.get(k), at.get(k, 0) + 1
    return out


@pytest.mark.parametrize("times, most, current", [(1, 50, False), (1, 1, True), (3, 64, True), (5_000, 100, False), (7, 10_000, False)])
def test_spans_of_equal_rows(spark, times, most, current):
    n = 60 if most == 1 else 2_000
    rows = crowd(n, times)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_hand(rows, current)
    found = look_back(df, ["k"], F.col("v"), "found", split_ns=Rows(most), current=current)
    assert found.columns == [*df.columns, "found"] and {r["seq"]: r["found"] for r in found.collect()} == {s: x[0] for s, x in want.items()}
    placed = places(df, ["k"], ("time_ns", "seq"), "i", Rows(most))
    assert {r["seq"]: r["i"] for r in placed.collect()} == {s: x[1] for s, x in want.items()}


def test_no_span_holds_more(spark):
    """One thread has nine in ten rows, all in one second, half of them at one time."""
    most = 500
    rows = [(k, t if i % 2 else 0, i, v) for i, (k, t, _, v) in enumerate(crowd(20_000, 1_000_000_000))]
    crowded, rest = Rows(most).parts(spark.createDataFrame(rows, SCHEMA), ["k"], ("time_ns", "seq"))
    spans = crowded.groupBy("k", "__span").agg(F.count("*").alias("n"), F.min(F.struct("time_ns", "seq")).alias("a"), F.max(F.struct("time_ns", "seq")).alias("b")).orderBy("k", "__span").collect()
    assert max(s["n"] for s in spans) <= most and sum(s["n"] for s in spans) + rest.count() == len(rows)
    # The spans of a key follow the order.
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False) if x["k"] == y["k"])
    # The tasks of the sort: the files of the table that it wrote.
    assert max(r[0] for r in crowded.groupBy(F.input_file_name()).count().select("count").collect()) <= 1.5 * most
    # Keys without many rows stay whole and are not copied.
    assert {r[0] for r in rest.select("k").distinct().collect()} <= {2, 3, None}


def test_nothing_is_written_without_crowded_keys(spark):
    df = spark.createDataFrame(crowd(200), SCHEMA)
    crowded, rest = Rows(1_000).parts(df, ["k"], ("time_ns", "seq"))
    assert crowded is None and rest is df
    assert look_back(spark.createDataFrame([], SCHEMA), ["k"], F.col("v"), "found", split_ns=Rows()).collect() == []
    with pytest.raises(ValueError, match="one row"):
        Rows(0)


def test_calls_are_the_same(spark):
    dim = syscall_dim(spark, IDS)
    for seed, extra in ((1, {}), (3, {"path": "/a", "comm": "app1", "filter_first": True})):
        events = random_trace(seed, 150).frame(spark)
        whole, cut_up = (completed_calls(events, dim, Options(split_ns=s, **extra)).orderBy("exit_time_ns", "exit_seq").collect() for s in (None, Rows(12)))
        assert whole == cut_up and whole


def test_small_spans_do_not_make_a_task_each(spark):
    rows = [(1, i % 7, i, None) for i in range(3_000)]
    crowded, _ = Rows(1).parts(spark.createDataFrame(rows, SCHEMA), ["k"], ("time_ns", "seq"))
    assert crowded.select("__span").distinct().count() == len(rows) and len(crowded.inputFiles()) <= 200
    assert [Rows(2_000).tasks(n) for n in (10_000, 1_000_000, 100_000_000, 1_000_000_000)] == [10, 200, 200, 1_000] and Rows().tasks(1_000_000_000) == 1_000


@pytest.mark.parametrize("split", [None, 7, Rows(40)])
def test_several_values_and_kept_rows(spark, split):
    rows = [(k, t, i, v) for i, (k, t, _, v) in enumerate(crowd(600, 300))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {s: x[0] for s, x in by_hand(rows, False).items()}
    before = {}
    for (k, _, s, _), last in zip(sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])), [(None, 0, None, None), *sorted(rows, key=lambda x: (str(x[0]), x[1], x[2]))], strict=False):
        before[s] = last[2] if last[0] == k else None
    both = look_backs(df, ["k"], {"found": F.col("v"), "before": "seq"}, split_ns=split).collect()
    assert {r["seq"]: (r["found"], r["before"]) for r in both} == {s: (want[s], before[s]) for s in want}
    # What is found decides whether a row is kept; rows that do not ask are kept if they may be.
    kept = look_back(df, ["k"], F.col("v"), "found", split_ns=split, keep=(F.col("seq") % 2 == 0) & F.col("found").endswith("7")).collect()
    assert {r["seq"]: r["found"] for r in kept} == {s: f for s, f in want.items() if s % 2 == 0 and f and f.endswith("7")}
    some = look_back(df, ["k"], F.col("v"), "found", split_ns=split, keep=F.col("seq") % 3 > 0, asks=F.col("seq") % 3 == 1).collect()
    assert {r["seq"] for r in some} == {s for s in want if s % 3} and all(r["found"] == want[r["seq"]] for r in some if r["seq"] % 3 == 1)


def test_spans_of_time_write_what_is_kept(spark, monkeypatch):
    """Pairing reads its events once and writes the calls and the last row of each span, not the events; a thread's comm and gap are one look back."""
    written = []
    monkeypatch.setattr(ordered, "cut", lambda df: written.append(cut(df)) or written[-1])
    events, day = random_trace(5, 300).frame(spark), 500
    calls = pairing.match(events, split_ns=day)
    spans = events.select("tid", F.floor(F.col("time_ns") / day)).distinct().count()
    assert [t.count() <= calls.count() + 2 * spans for t in written] == [True] and "path" not in written[0].columns
    written.clear()
    completed_calls(events, syscall_dim(spark, IDS), Options(split_ns=day))
    assert len(written) == 3


def test_files_run_as_machine_code(spark, monkeypatch):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    sizes = []

    def watched(df):
        parts = df._jdf.queryExecution().debug().codegenToSeq()
        sizes.extend(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))
        return cut(df)

    monkeypatch.setattr(ordered, "cut", watched)
    monkeypatch.setattr(fdtable, "cut", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans are whole before they run
    try:
        for split in (None, 500):
            completed_calls(random_trace(2, 60).frame(spark), syscall_dim(spark, IDS), Options(split_ns=split))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8_000
