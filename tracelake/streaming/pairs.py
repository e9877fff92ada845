"""Pairing as a stream: events come in any order within the watermark, completed calls go out once.

Each process keeps its events in a buffer until the watermark has passed them, sorts what is due by (time, number), and folds it
into its state. A process has one timer, for the earliest thing that it waits for; when it fires, the seconds that are due are read, and of
the rest of the state only what their events touch. Pending enters wait for their exits without limit; with ``max_pending_ns`` they are
dropped when the watermark has left them behind by more than that, and their later exits complete nothing. With ``idle_ns`` all that is
kept of a process goes when the watermark has left its last event behind by more than that. With ``audit`` every row has an
``outcome``: completed, mismatch (the ids of enter and exit do not fit), expired (an enter), forgotten (a name or an open file of
a process that went), or late (an event that came behind the watermark and takes no part). With ``event_time`` the watermark goes on with the
result, so that windows (``window_counts``) can be chained to it in the same query. Needs the RocksDB state store provider.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.functions.dims import KINDS, MORE_KINDS, io_class
from tracelake.functions.render import file_flags, file_name
from tracelake.functions.text import trim_comm
from tracelake.operators.aggregate import agg6, merge, moved_bytes
from tracelake.schema import AGG6, EVENTS, KEYS6, PAIRS
from tracelake.sources import parts
from tracelake.sources.raw import decode_events
from tracelake.streaming.fold import ProcessState, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [c.split(" ")[0] for c in EVENTS.split(", ")]
OUT = PAIRS
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
#: What a snapshot of the process table says of an enter's thread.
HELD = ("exe_comm",)
#: The rows of the initial state: an open file (fd, name, flags) or the program of a thread (tid, exe_comm) of a process each.
KNOWN = "tid bigint, fd int, name string, flags int, exe_comm string"
SECOND, MILLI, MICRO = 1_000_000_000, 1_000_000, 1_000


def passed(watermark_ms: int) -> int:
    """The first time in nanoseconds that the watermark has not passed: Spark compares microseconds, and what equals it counts as passed."""
    return watermark_ms * MILLI + MICRO if watermark_ms > 0 else 0


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None, more: str = "") -> DataFrame:
    """A stream over the Parquet files of typed events in a folder; ``more``: columns that they have besides, such as ``host string``."""
    reader = spark.readStream.schema(", ".join(filter(None, (EVENTS, more))))
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def read_raw(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same over files of raw records (seq, payload), decoded on the way; records that no layout fits are left out."""
    reader = spark.readStream.schema("seq bigint, payload binary")
    return decode_events((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path))


class Held:
    """A map state as the fold sees it: a value is read when it is asked for, and what has changed is written once."""

    def __init__(self, state, load: Callable, store: Callable):
        self.state, self.load, self.store, self.known, self.changed = state, load, store, {None: None}, set()

    def get(self, k, default=None):
        if k not in self.known:
            found = self.state.getValue((k,))
            self.known[k] = None if found is None else self.load(found)
        return default if self.known[k] is None else self.known[k]

    def __contains__(self, k) -> bool:
        return self.get(k) is not None

    def __setitem__(self, k, value) -> None:
        self.known[k] = value
        self.changed.add(k)

    def pop(self, k, default=None):
        found = self.get(k)
        if found is not None:
            self[k] = None
        return default if found is None else found

    def items(self) -> list[tuple]:
        """All of it, in no order."""
        for k, v in self.state.iterator():
            self.known.setdefault(k[0], self.load(v))
        return [(k, v) for k, v in self.known.items() if v is not None]

    def write(self) -> None:
        for k in self.changed - {None}:
            if self.known[k] is not None:
                self.state.updateValue((k,), self.store(self.known[k]))
            elif self.state.containsKey((k,)):
                self.state.removeKey((k,))


class PairProcessor(StatefulProcessor):
    def __init__(self, dim: Mapping[int, tuple[str, str]], comm: str, path: str, max_pending_ns: int | None, filter_first: bool, audit: bool, run: tuple[str, ...], idle_ns: int | None, snapshots: bool, event_time: bool = False):
        self.dim, self.comm, self.path, self.max_pending_ns, self.filter_first, self.audit = dict(dim), comm, path, max_pending_ns, filter_first, audit
        self.run, self.idle_ns, self.snapshots, self.event_time = run, idle_ns, snapshots, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Small values under many keys, so that one event reads and writes only what it touches.
        self.buffer = handle.getMapState("buffer", "second bigint", "rows string")
        self.pending = handle.getMapState("pending", "tid bigint", "row string")
        self.comms = handle.getMapState("comms", "tid bigint", "comm string")
        self.files = handle.getMapState("files", "fd int", "name string, flags int, snap boolean")
        self.last = handle.getMapState("last", "tid bigint", "time_ns bigint")
        self.snap_files = handle.getMapState("snap_files", "fd int", "name string, flags int")
        self.snap_comms = handle.getMapState("snap_comms", "tid bigint", "comm string")
        self.clock = handle.getValueState("clock", "timer bigint, seen_ns bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for pdf in [initialState] if isinstance(initialState, pd.DataFrame) else initialState:
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if r["fd"] is not None:
                    self.snap_files.updateValue((int(r["fd"]),), (r["name"], None if r["flags"] is None else int(r["flags"])))
                elif r["tid"] is not None:
                    self.snap_comms.updateValue((int(r["tid"]),), (r["exe_comm"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[int, list[dict]] = {}
        late, passed_ns = [], passed(timerValues.getCurrentWatermarkInMs())
        for pdf in rows:
            own = pdf[[c for c in (*COLUMNS, *HELD) if c in pdf.columns]]
            for r in own.astype(object).where(own.notna(), None).to_dict("records"):
                row = {k: v if v is None or isinstance(v, str) else int(v) for k, v in r.items()}
                if self.audit and row["time_ns"] < passed_ns:
                    late.append(self._late(row))
                else:
                    came.setdefault(row["time_ns"] // SECOND, []).append(row)
        for second, new in came.items():
            old = self.buffer.getValue((second,))
            self.buffer.updateValue((second,), (json.dumps((json.loads(old[0]) if old else []) + new),))
        if times := [r["time_ns"] for new in came.values() for r in new]:
            timer, seen = self.clock.get() or (None, None)
            self._wake(timer, min(times), max(times) if seen is None else max(seen, *times), keep=True)
        yield self._frame(key, late, passed_ns) if late else pd.DataFrame()

    def _wake(self, timer: int | None, at_ns: int | None, seen_ns: int, keep: bool = False) -> None:
        """Set the one timer to when the watermark is past ``at_ns``; with ``keep`` an earlier one stays. Timers are whole milliseconds."""
        want = None if at_ns is None else -(at_ns // MICRO // -1_000)
        if keep and timer is not None and (want is None or timer <= want):
            want = timer
        if timer is not None and timer != want:
            self.handle.deleteTimer(timer)
        if want is not None and timer != want:
            self.handle.registerTimer(want)
        self.clock.update((want, seen_ns))

    def _due(self, due_ns: int) -> tuple[list[dict], int | None]:
        """The waiting events before ``due_ns`` in order, which leave the buffer, and when the next is due at the earliest."""
        due, later = [], []
        for (second,) in list(self.buffer.keys()):
            if second * SECOND >= due_ns:
                later.append(second * SECOND)
                continue
            rows = json.loads(self.buffer.getValue((second,))[0])
            due += [r for r in rows if r["time_ns"] < due_ns]
            if rest := [r for r in rows if r["time_ns"] >= due_ns]:
                self.buffer.updateValue((second,), (json.dumps(rest),))
                later.append(min(r["time_ns"] for r in rest))
            else:
                self.buffer.removeKey((second,))
        return sorted(due, key=lambda r: (r["time_ns"], r["seq"])), min(later, default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due_ns = passed(timerValues.getCurrentWatermarkInMs())
        due, next_ns = self._due(due_ns)
        timer, seen_ns = self.clock.get()
        out = []
        s = ProcessState(
            Held(self.pending, lambda v: json.loads(v[0]), lambda e: (json.dumps(e),)), Held(self.comms, lambda v: v[0], lambda c: (c,)),
            Held(self.files, tuple, tuple), Held(self.last, lambda v: v[0], lambda t: (t,)),
        )
        snap_files, snap_comms = Held(self.snap_files, tuple, tuple), Held(self.snap_comms, lambda v: v[0], lambda c: (c,))
        for event in due:
            if self.snapshots and event["phase"] == "enter":
                event["snap_name"], event["snap_flags"] = snap_files.get(event["fd"], (None, None))
                event["exe_comm"] = snap_comms.get(event["tid"], event.get("exe_comm"))
            if (made := step(s, event, self.dim, self.comm, self.path, self.filter_first)) is not None:
                out.append(made | {"outcome": "completed"})
            elif self.audit and s.mismatched is not None:
                out.append(self._lost(s.mismatched, event) | {"outcome": "mismatch"})
        waits = [] if next_ns is None else [next_ns]
        if self.max_pending_ns is not None:
            for tid, enter in s.pending.items():
                if enter["time_ns"] < due_ns - self.max_pending_ns:
                    s.pending.pop(tid)
                    out.append(self._lost(enter) | {"outcome": "expired"})
                else:
                    waits.append(enter["time_ns"] + self.max_pending_ns)
        for held in (s.pending, s.comms, s.files, s.last_exit):
            held.write()
        ends_ns = None if self.idle_ns is None else seen_ns + self.idle_ns
        if ends_ns is not None and next_ns is None and ends_ns < due_ns:
            out += self._forget(key)
            self.handle.deleteTimer(timer)
        else:
            self._wake(timer, min(waits + ([] if ends_ns is None else [ends_ns]), default=None), seen_ns)
        yield self._frame(key, out, due_ns)

    def _forget(self, key) -> list[dict]:
        """Drop all that is kept of the process, and say what that was."""
        none = dict.fromkeys(NAMES) | {"pid": key[-1], "outcome": "forgotten"}
        out = [self._lost(json.loads(v[0])) | {"outcome": "expired"} for _, v in self.pending.iterator()]
        out += [none | {"tid": k[0], "comm": v[0]} for k, v in self.comms.iterator()]
        out += [none | {"file": {"kind": "fd", "fd": k[0], "name": v[0], "oldname": None, "flags": v[1], "from_snapshot": v[2]}} for k, v in self.files.iterator()]
        for state in (self.pending, self.comms, self.files, self.last, self.snap_files, self.snap_comms, self.clock):
            state.clear()
        return out

    def _frame(self, key, out: list[dict], passed_ns: int) -> pd.DataFrame:
        own = dict(zip(self.run, key[:-1], strict=True))
        names = [*self.run, *NAMES]
        if self.audit:
            whole = pd.DataFrame([dict.fromkeys(names) | own | r for r in out], columns=[*names, "outcome"], dtype=object)
            made = whole.where(whole.notna(), None)
        else:
            out = [r for r in out if r["outcome"] == "completed"]
            made = pd.DataFrame([own | r for r in out], columns=names)
        if self.event_time:
            # A call is as old as its exit, which the watermark has just passed; what is older than that counts as of now.
            at = [r["exit_time_ns"] if r["outcome"] in ("completed", "mismatch") else passed_ns for r in out]
            made["ts"] = pd.to_datetime(pd.Series(at, dtype="int64") // 1_000, unit="us", utc=True)
        return made

    def _late(self, event: dict) -> dict:
        """An event that came too late, as a call without its other half."""
        half = "enter" if event["phase"] == "enter" else "exit"
        row = dict.fromkeys(NAMES) | {"outcome": "late", "pid": event["pid"], "tid": event["tid"], "ret": event["ret"]}
        return row | {f"{half}_seq": event["seq"], f"{half}_time_ns": event["time_ns"], f"{half}_trace_id": event["trace_id"]}

    def _lost(self, enter: dict, end: dict | None = None) -> dict:
        """An enter that completes nothing, with the exit that consumed it, if any."""
        end = end or dict.fromkeys(COLUMNS)
        row = {"pid": enter["pid"], "tid": enter["tid"], "enter_seq": enter["seq"], "exit_seq": end["seq"], "enter_time_ns": enter["time_ns"], "exit_time_ns": end["time_ns"]}
        return row | {"enter_trace_id": enter["trace_id"], "exit_trace_id": end["trace_id"], "name": self.dim.get(enter["trace_id"], ("",))[0], "ret": end["ret"]}

    def close(self) -> None:
        pass


def _known(proc_fd: DataFrame | None, proc_exe: DataFrame | None, run: Sequence[str]) -> DataFrame | None:
    """The snapshots as rows of the initial state, by process."""
    columns = [c.split(" ") for c in KNOWN.split(", ")]
    out = None
    for table in (proc_fd, proc_exe):
        if table is not None:
            some = table.where("pid is not null").select(*run, F.col("pid").cast("bigint"), *[(F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])
            out = some if out is None else out.unionByName(some)
    return out


def pair_stream(
    events: DataFrame, dim: Mapping[int, tuple[str, str]], delay: str = "10 seconds", comm: str = "", path: str = "", max_pending_ns: int | None = None, filter_first: bool = True, audit: bool = False,
    proc_fd: DataFrame | None = None, proc_exe: DataFrame | None = None, run: Sequence[str] = (), idle_ns: int | None = None, event_time: bool = False,
) -> DataFrame:
    """A stream of completed calls from a stream of typed events, with the state kept by process.

    ``run`` names the columns of the events (host, run) that tell traces apart, as for the batch form; they come first in the result. With
    ``filter_first`` a call that the filters drop does not change the table of open files; the batch form's option of
    that name is off by default. ``proc_fd`` and ``proc_exe`` are snapshots as for the batch form, with the columns of ``run``. They become
    the initial state of their processes, once, when the query first starts; a ``proc_exe`` without a ``pid`` is joined to the events.
    Events later than the watermark are dropped by Spark, or with ``audit`` are rows of their own. With ``event_time`` there is a column
    ``ts``, the time of the exit, which carries the watermark on.
    """
    if proc_exe is not None and "pid" not in proc_exe.columns:
        events, proc_exe = events.join(proc_exe.select(*run, "tid", "exe_comm"), [*run, "tid"], "left"), None
    timed = events.withColumn("ts", F.timestamp_micros(F.expr("time_ns div 1000"))).withWatermark("ts", delay)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in events.schema if f.name in run]
    out = ", ".join([*kinds, OUT] + ["outcome string"] * audit + ["ts timestamp"] * event_time)
    if audit:
        timed = timed.drop("ts")  # the watermark moves on as before, but Spark drops nothing behind it
    known = _known(proc_fd, proc_exe, run)
    made = PairProcessor(dim, comm, path, max_pending_ns, filter_first, audit, tuple(run), idle_ns, known is not None, event_time)
    keys = [*run, "pid"]
    return timed.groupBy(*keys).transformWithStateInPandas(made, out, "append", "eventTime", initialState=None if known is None else known.groupBy(*keys), eventTimeColumnName="ts" if event_time else "")


def dim_map(dim: DataFrame) -> dict[int, tuple[str, str]]:
    """The enters of the dimension, a few hundred rows, as a dictionary."""
    return {r[0]: (r[1], r[2]) for r in dim.where("phase = 'enter'").select("trace_id", "name", "record_kind").collect()}


def _with_class(calls: DataFrame) -> DataFrame:
    """``calls`` with ``io_class``, from the names of the calls."""
    if "io_class" in calls.columns:
        return calls
    of = {n: io_class(n) for kinds in (KINDS, MORE_KINDS) for names in kinds.values() for n in names.split()}
    known = F.create_map(*[F.lit(x) for n, k in of.items() if k != "none" for x in (n, k)])
    return calls.withColumn("io_class", F.coalesce(known[F.col("name")], F.lit("none")))


def window_counts(calls: DataFrame, width: str = "1 minute", delay: str = "10 seconds", run: Sequence[str] = ()) -> DataFrame:
    """The six-key aggregate in windows of the exit's time, from completed calls: a table, a stream of them, or ``pair_stream`` itself.

    With its option ``event_time`` the windows are chained to the pairing in one query: its watermark closes them, and ``delay`` is not used. Of a stream
    with outcomes completed calls count. ``run`` are further keys.
    """
    chained = "ts" in calls.columns
    if "outcome" in calls.columns:
        calls = calls.where("outcome = 'completed'")
    rows = _with_class(calls).select(
        F.col("ts") if chained else F.timestamp_micros(F.expr("exit_time_ns div 1000")).alias("ts"), file_name(F.col("file")).alias("path"), F.col("enter_trace_id").alias("trace_id"),
        trim_comm(F.col("comm")).alias("comm"), "pid", "tid", file_flags(F.col("file")).alias("flags"), "duration", "gap", moved_bytes().alias("moved"), *run,
    )
    sums = [F.count("*").alias("count"), F.sum("duration").alias("duration"), F.sum("gap").alias("duration_to_prev"), F.sum("moved").alias("bytes")]
    return (rows if chained else rows.withWatermark("ts", delay)).groupBy(F.window("ts", width), *run, *KEYS6).agg(*sums)


def add_to_aggregate(path: str, compact_every: int | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``run_once``: each batch's six-key aggregate, bytes included, as a part of the table at ``path``.

    A batch that is tried again replaces its part, so every call counts once. ``saved_aggregate`` merges the parts; with ``compact_every`` the sink does so
    itself after that many batches, so that a reader meets few parts however long the stream runs.
    """

    def sink(calls: DataFrame, batch: int) -> None:
        spark = calls.sparkSession
        parts.add_part(agg6(_with_class(calls), with_bytes=True), path, batch)
        if compact_every and len(parts.layout(spark, path)[1]) >= compact_every:
            parts.compact(spark, path, AGG6, merge)

    return sink


def saved_aggregate(spark: SparkSession, path: str) -> DataFrame:
    """The aggregate of all batches so far."""
    return merge(parts.read_parts(spark, path, AGG6))


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", timeout: float | None = None) -> None:
    """Work off all that is there and stop (or stop at the deadline); each batch of results goes to ``sink``."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
