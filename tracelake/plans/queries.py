"""The registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.dims import syscall_dim
from tracelake.functions.render import HEADER, file_flags, file_name
from tracelake.functions.text import basename, flags_text, octal, path_stack, trim_comm
from tracelake.operators import aggregate, fdtable, filters, pairing, patterns, profile, stacks, views
from tracelake.operators.ordered import Rows, places
from tracelake.plans.calls import Options, completed_calls, enriched_calls, selected
from tracelake.scratch import cut, place
from tracelake.sources import dump, raw
from tracelake.sources.sinks import load_aggregate, load_runs, row_stream, save_aggregate, save_run, write_collapsed, write_rows
from tracelake.sources.trace import HOSTS_IDS, hosts_trace, trace

Query = Callable[[SparkSession, str], DataFrame]
#: Filters of the registered queries.
COMM, PATH = "app1", "/data/view"
#: Series of few groups are spread over spans of 30 days.
SPAN_US = 30 * 86_400_000_000
#: And their values over spans of this width.
SPAN_VALUES = 4_096
#: Records of a dump are numbered over spans of so many bytes.
SPAN_BYTES = 16 << 20
CALL_COLUMNS = ("tid", "enter_seq", "exit_seq", "enter_trace_id", "exit_trace_id", "ret")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fitted(sums: DataFrame) -> DataFrame:
    """``sums`` with its wide sums as bigint, as in the SQL, where all rows fit; a column that does not keeps its type, and so its numbers."""
    wide = [f.name for f in sums.schema if f.dataType.simpleString() == aggregate.WIDE]
    done = cut(sums)
    most = done.agg(*[F.max(F.abs(c)).alias(c) for c in wide]).first()
    return done.withColumns({c: F.col(c).cast("bigint") for c in wide if most[c] is None or most[c] < 1 << 63})


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.match(trace(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.valid_calls(_matched(spark, sf_dir), syscall_dim(spark))


def _flat(calls: DataFrame) -> DataFrame:
    file = F.col("file")
    return calls.select("exit_seq", "name", F.coalesce("comm", F.lit("")).alias("comm"), file_name(file).alias("file_name"), file_flags(file).alias("file_flags"), "duration", "gap")


def pair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select(*CALL_COLUMNS, "name")


def pair_calls_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every thread's history cut into days."""
    split = pairing.match(trace(spark, sf_dir), split_ns=86_400_000_000_000)
    return pairing.valid_calls(split, syscall_dim(spark)).select(*CALL_COLUMNS, "name")


def calls_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with comm, duration and gap when nine in ten threads are one, which holds most of the trace: its history is cut into spans of equal rows."""
    crowded, split = F.col("tid") % 10 < 9, Rows(2_000)
    events = trace(spark, sf_dir).withColumn("tid", F.when(crowded, F.lit(1)).otherwise(F.col("tid")).cast("bigint"))
    calls = fdtable.attach_comm(pairing.valid_calls(pairing.match(events, split_ns=split), syscall_dim(spark)), split_ns=split)
    return pairing.durations(calls, split_ns=split).select("tid", "exit_seq", "name", F.coalesce("comm", F.lit("")).alias("comm"), "duration", "gap")


def pair_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.mismatches(_matched(spark, sf_dir)).select(*CALL_COLUMNS)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, matched = trace(spark, sf_dir), _matched(spark, sf_dir)
    return pairing.run_stats(events, matched, pairing.valid_calls(matched, syscall_dim(spark)), 60.0)


def durations_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.durations(_valid(spark, sf_dir)).select("tid", "exit_seq", "duration", "gap")


def comm_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fdtable.attach_comm(_valid(spark, sf_dir)).select("tid", "exit_seq", "comm")


def fd_asof_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of descriptors where only opens and closes change the table."""
    calls = _valid(spark, sf_dir).where("name not in ('dup', 'fcntl')")
    return fdtable.attach_files(calls).select("exit_seq", file_name(F.col("file")).alias("file_name"), file_flags(F.col("file")).alias("file_flags"))


def fd_asof_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fdtable.attach_files(_valid(spark, sf_dir))
    return done.select("exit_seq", file_name(F.col("file")).alias("file_name"), file_flags(F.col("file")).alias("file_flags"), F.coalesce("file.from_snapshot", F.lit(False)).alias("from_snapshot"))


def calls_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(completed_calls(trace(spark, sf_dir)))


def calls_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed calls under filters on comm and path: gate, filters on events and filters on calls."""
    return _flat(completed_calls(trace(spark, sf_dir), o=Options(comm=COMM, path="/k")))


def filters_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).where("phase = 'enter' and event_type = 1")
    return t.where(filters.raw_filter(F.lit("open"), COMM, "k3")).select("seq", "comm", "path")


def filters_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).where("phase = 'enter' and event_type = 11")
    return t.where(filters.raw_filter(F.lit("path"), path=PATH)).select("seq", "path")


def filters_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).where("phase = 'enter' and event_type = 9")
    return t.where(filters.raw_filter(F.lit("name"), path="7.tmp")).select("seq", "oldname", "newname")


def filters_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filters.by_process(trace(spark, sf_dir), pid=1007, exclude_pids=(1008,))
    return filters.by_time(t, 1704067200000000000, 30 * 86_400).select("seq", "pid", "tid")


def comm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(trace(spark, sf_dir), syscall_dim(spark), Options(comm=COMM)).where("phase = 'enter'").select("seq", "tid")


def tracepoint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filters.by_tracepoint(trace(spark, sf_dir), syscall_dim(spark), include=("read$", "open"), exclude=("exit_open",))
    return t.select("seq", "trace_id")


def is_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.is_call(_valid(spark, sf_dir), "rename").select("exit_seq", "oldname", "newname")


def flags_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and paths as text, over numbers and paths that the table gives."""
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 2097152).cast("int").alias("flags"), F.concat(F.lit("/data/"), "event_type", F.lit("/x")).alias("path"))
    return e.select("event_id", flags_text(F.col("flags")).alias("flags_text"), path_stack(F.col("path")).alias("stack"))


def render_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = completed_calls(trace(spark, sf_dir).where("trace_id in (798, 797, 874, 873, 884, 883, 1040, 1039)"))
    return row_stream(calls).select("exit_seq", "value")


def render_pairs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row stream of all calls, those on tracked descriptors and on descriptors from before the trace too."""
    return row_stream(completed_calls(trace(spark, sf_dir))).select("exit_seq", "value")


def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.agg6(enriched_calls(trace(spark, sf_dir)))


def agg6_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.agg6(enriched_calls(trace(spark, sf_dir)), with_bytes=True)


def rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs (halves of the calls) aggregated each and merged: the aggregate of all."""
    calls = enriched_calls(trace(spark, sf_dir))
    even, odd = (aggregate.agg6(calls.where(F.pmod("exit_seq", F.lit(4)) == r)) for r in (1, 3))
    return aggregate.merge(even, odd)


def collapse_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(aggregate.collapse(aggregate.agg6(enriched_calls(trace(spark, sf_dir))), syscall_dim(spark), count="duration"))


def collapse_comm_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(aggregate.collapse(aggregate.agg6(enriched_calls(trace(spark, sf_dir))), syscall_dim(spark), ("comm", "tracepoint", "flags"), "durationToPrev"))


def rollup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(aggregate.rollup_paths(aggregate.agg6(enriched_calls(trace(spark, sf_dir)))).drop("bytes"))


def _events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_type", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("bytes"), F.round(F.col("value") * 1000).cast("bigint").alias("latency_ns"))


def _lineitem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    return t.select("l_returnflag", F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", F.round("l_extendedprice").cast("bigint").alias("bytes"), F.col("l_quantity").cast("bigint").alias("latency_ns"))


def io_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.io_profile(_events_series(spark, sf_dir), ["event_type"], split=SPAN_VALUES)


def io_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.io_profile(_lineitem_series(spark, sf_dir), ["l_returnflag"], split=SPAN_VALUES)


def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.time_series(_events_series(spark, sf_dir), ["event_type"], tie=["event_id"], split_us=SPAN_US)


def bursts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.bursts(_events_series(spark, sf_dir), ["event_type"], tie=["event_id"], threshold=5000, split_us=SPAN_US)


def bursts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.bursts(_lineitem_series(spark, sf_dir), ["l_returnflag"], tie=["l_orderkey", "l_linenumber"], threshold=30_000, split_us=SPAN_US)


def periodicity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patterns.periodicity(_events_series(spark, sf_dir), ["event_type"], tie=["event_id"], max_lag=24, split_us=SPAN_US)
    return p.withColumn("correlation", F.round("correlation", 0))


def trend_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").alias("ts"), F.round("o_totalprice").cast("bigint").alias("bytes"))
    return patterns.trend(o, ["o_orderpriority"], unit="s").withColumn("slope", F.round("slope", 9))


def patterns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patterns.analyze(_events_series(spark, sf_dir), ["event_type"], tie=["event_id"], max_lag=8, split_us=SPAN_US)
    return p.select("event_type", "burst_count", "burst_us", "is_periodic", "best_lag", "period_us", "direction")


def decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace as raw records and decoded again."""
    done = raw.decode_events(cut(raw.encode_events(trace(spark, sf_dir))))
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fd", "flags", "cmd", "arg", "ret")]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("path", "oldname", "newname", "comm")]
    return done.select("seq", "event_type", "phase", "trace_id", "time_ns", "pid", "tid", *numbers, *texts)


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of which every 50th has an unknown type and every 70th is cut off."""
    r = cut(raw.encode_events(trace(spark, sf_dir)))
    spoilt = F.when(F.pmod("seq", F.lit(50)) == 0, F.concat(F.unhex(F.lit("07")), F.expr("substring(payload, 2)"))).when(F.pmod("seq", F.lit(70)) == 0, F.expr("substring(payload, 1, 20)"))
    return raw.quarantine(r.withColumn("payload", F.coalesce(spoilt, F.col("payload")))).select("seq", "event_type", "reason")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(views.transitions(pairing.durations(_valid(spark, sf_dir)), split_ns=86_400_000_000_000))


def gaps_by_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(views.gaps_by_call(pairing.durations(_valid(spark, sf_dir))))


def call_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(views.call_times(pairing.durations(_valid(spark, sf_dir))))


def path_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(views.path_buckets(enriched_calls(trace(spark, sf_dir)), "/k[0-4]"))


def by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(views.by_directory(aggregate.agg6(enriched_calls(trace(spark, sf_dir)))))


def by_mount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mount points: the root, and one for each event type with an even length of its name."""
    return _fitted(views.by_mount(aggregate.agg6(enriched_calls(trace(spark, sf_dir))), _mounts(spark, sf_dir)))


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(views.with_user(aggregate.agg6(enriched_calls(trace(spark, sf_dir))), _users(spark, sf_dir)))


HOSTS = ("host",)
#: Filters of the queries over the trace of two hosts.
HOSTS_COMM, HOSTS_PATH = "app", "/k1"


def _hosts(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    events, fds, exes = hosts_trace(spark, sf_dir)
    return enriched_calls(events, syscall_dim(spark, HOSTS_IDS), Options(run=HOSTS, **options), fds, exes)


def _hosts_flat(calls: DataFrame) -> DataFrame:
    return _flat_with(calls, "host", "pid", F.coalesce("file.from_snapshot", F.lit(False)).alias("from_snapshot"))


def _flat_with(calls: DataFrame, *more) -> DataFrame:
    file = F.col("file")
    return calls.select(*more, "exit_seq", "name", F.coalesce("comm", F.lit("")).alias("comm"), file_name(file).alias("file_name"), file_flags(file).alias("file_flags"), "duration", "gap")


def calls_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed calls of two hosts whose processes, threads and numbers are the same, with snapshots of one of them."""
    return _hosts_flat(_hosts(spark, sf_dir))


def calls_hosts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every history cut into days."""
    return _hosts_flat(_hosts(spark, sf_dir, split_ns=86_400_000_000_000))


def calls_filter_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls under filters that come before the table of open files: what they drop changes no descriptor."""
    return _hosts_flat(_hosts(spark, sf_dir, path=HOSTS_PATH, filter_first=True))


def filters_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_process(trace(spark, sf_dir), tid=10071).select("seq", "pid", "tid")


def stats_map_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with its figures in a struct for each column."""
    m = profile.stats_map(io_profile_events(spark, sf_dir), ["event_type"])
    return m.select("event_type", "count", "total_bytes", "total_latency", *[F.col(f"{c}.{n}").alias(f"{c}_{n}") for c in ("latency", "bytes") for n in ("min", "max", "mean", "median", "p95", "p99")])


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's aggregate saved as a run, loaded again, merged, and collapsed by bytes."""
    calls, path = cut(_hosts(spark, sf_dir).select("host", "file", "enter_trace_id", "comm", "pid", "tid", "duration", "gap", "io_class", "ret")), place(spark)
    for host in ("h0", "h1"):
        save_aggregate(aggregate.agg6(calls.where(F.col("host") == host), with_bytes=True), path, host, "run", "1")
    merged = aggregate.merge(load_aggregate(spark, path))
    return _fitted(aggregate.collapse(merged, syscall_dim(spark, HOSTS_IDS), ("comm", "tracepoint", "tid"), "bytes"))


def collapsed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks by count as written to compressed text, the second writing left out as the first is there."""
    stacks = aggregate.collapse(aggregate.agg6(_hosts(spark, sf_dir)), syscall_dim(spark, HOSTS_IDS), ("path", "flags"), "count")
    base = f"{place(spark)}/stacks"
    path = write_collapsed(stacks, base, ("path", "flags"), "count")
    write_collapsed(stacks.limit(0), base, ("path", "flags"), "count")
    return spark.read.text(path).withColumnRenamed("value", "line")


def rows_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row stream as written to text, without its header."""
    path = place(spark)
    write_rows(completed_calls(trace(spark, sf_dir)), path)
    return spark.read.text(path).where(F.col("value") != HEADER)


def decode_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of which every 60th is empty: those are skipped, neither decoded nor quarantined."""
    r = raw.encode_events(trace(spark, sf_dir))
    r = cut(r.withColumn("payload", F.when(F.pmod("seq", F.lit(60)) == 0, F.unhex(F.lit(""))).otherwise(F.col("payload"))))
    return raw.decode_events(r).select("seq", F.lit("decoded").alias("what")).unionByName(raw.quarantine(r).select("seq", F.lit("quarantined").alias("what")))


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octal numbers, last parts of paths and trimmed names, over values that the table gives."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.conv(F.col("c_custkey").cast("string"), 10, 8).alias("digits"), F.concat(F.lit("/usr/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"), F.concat(F.lit("\t "), "c_mktsegment", F.lit(" \n")).alias("comm"))
    return c.select("c_custkey", octal(F.col("digits")).alias("number"), basename(F.col("path")).alias("last"), trim_comm(F.col("comm")).alias("comm"))


def periodicity_every_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all lags below half of each group's rows; the correlation in six significant digits."""
    p = patterns.periodicity(_events_series(spark, sf_dir), ["event_type"], tie=["event_id"], split_us=SPAN_US)
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.greatest("correlation", F.lit(1e-300)))))
    return p.withColumn("correlation", F.when(F.col("correlation") > 0, F.round(F.col("correlation") * scale)).otherwise(0.0).cast("bigint"))


def sketch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from the sketches of two saved runs, one of them saved twice, and whether their exact places are as near as is promised.

    Sketches are random: a place is held to twice the error that 99 of 100 keep.
    """
    rows, path = _events_series(spark, sf_dir), place(spark)
    for host, rest in (("even", 0), ("odd", 1), ("even", 0)):
        save_run(profile.sketch_profile(rows.where(F.pmod("event_id", F.lit(2)) == rest), ["event_type"]), path, host, "events", "1")
    found = profile.sketch_quantiles(profile.merge_sketches(load_runs(spark, path), ["event_type"]), ["event_type"])
    e = 2 * profile.rank_error()
    near = (F.col("below") <= F.col("q") + e) & (F.col("upto") >= F.col("q") - e)
    return profile.rank_bounds(rows, cut(found), ["event_type"]).select("event_type", "what", "q", "count", near.alias("near"))


def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace as a binary dump of several files, read again by ranges that cut records, and decoded; ``place`` is that of the record in the trace."""
    dump.register(spark)
    path = place(spark)
    files = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = raw.encode_events(trace(spark, sf_dir).repartitionByRange(files, "seq").sortWithinPartitions("seq"))
    records.write.format(dump.NAME).mode("append").save(path)
    done = cut(raw.decode_events(spark.read.format(dump.NAME).option("rangeBytes", 1_000_003).load(path)))
    at = places(done, [], ("seq",), "place", SPAN_BYTES)  # the files' numbers lead those of their records
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("path", "oldname", "newname", "comm")]
    return at.select("place", "event_type", "phase", "trace_id", "time_ns", "pid", "tid", F.coalesce("ret", F.lit(0)).alias("ret"), *texts)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of ``run_stats`` from the one job that writes the calls."""
    report = pairing.RunReport()
    matched = report.matched(pairing.match(report.events(trace(spark, sf_dir))))
    cut(report.filtered(pairing.valid_calls(matched, syscall_dim(spark))))
    return report.row(spark, 60.0)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("bigint").alias("pid"), F.col("c_name").alias("user"))


def _mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _table(spark, sf_dir, "events").select("event_type").distinct()
    some = types.where("length(event_type) % 2 = 0").select(F.concat(F.lit("/data/"), "event_type").alias("mount"), F.concat(F.lit("dev-"), "event_type").alias("device"))
    return some.unionByName(types.select(F.lit("/").alias("mount"), F.lit("root").alias("device")).distinct())


def stacks_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, programs, processes, threads, and each call behind the one before it."""
    calls = enriched_calls(trace(spark, sf_dir))
    return _fitted(stacks.stacks(calls, ("user", "comm", "pid", "tid", "transition"), "durationToPrev", stacks.Tables(users=_users(spark, sf_dir)), split_ns=86_400_000_000_000))


def stacks_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices, mount points, directories, a bucket of paths, and the call, by bytes."""
    tables = stacks.Tables(mounts=_mounts(spark, sf_dir), buckets=(("PATHMATCH", "/k[0-4]"),))
    return _fitted(stacks.stacks(enriched_calls(trace(spark, sf_dir)), ("device", "mount", "directory", "bucket", "call"), "bytes", tables))


def flame_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the flame graph of programs, paths and calls, by duration."""
    return _fitted(stacks.flame_tree(stacks.stacks(enriched_calls(trace(spark, sf_dir)), ("comm", "path", "tracepoint"), "duration")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        pair_calls, pair_calls_split, calls_crowded, pair_mismatches, run_stats, durations_gaps, comm_asof, fd_asof_roots, fd_asof_full, calls_full, calls_filtered, filters_open, filters_path,
        filters_name, filters_process, comm_gate, tracepoint_select, is_call, flags_path_text, render_pairs, render_pairs_full, agg6, agg6_bytes, rollup_merge, collapse_default, collapse_comm_flags,
        rollup_paths, io_profile_events, io_profile_lineitem, time_series, bursts_events, bursts_lineitem, periodicity_events, trend_orders, patterns_events, decode_round_trip,
        quarantined, transitions, gaps_by_call, calls_hosts, calls_hosts_split, calls_filter_first, filters_thread, stats_map_events, saved_runs, collapsed_file,
        rows_file, decode_present, scalar_text, periodicity_every_lag, call_times, path_buckets, by_directory, by_mount, by_user, sketch_runs, dump_round_trip, run_report, stacks_user, stacks_device, flame_tree,
    )
}
