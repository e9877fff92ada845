"""From typed events to completed calls, in the order that gives the right results.

Filters on events, the gate on comm, pairing, the check of ids, comm and files, the filter on calls, durations and gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.dims import syscall_dim
from tracelake.operators import fdtable, filters, pairing
from tracelake.operators.ordered import Rows
from tracelake.schema import PAIRS


@dataclass(frozen=True)
class Options:
    """What a run is asked for.

    ``split_ns`` cuts long histories of a thread into spans of that many nanoseconds, or with ``Rows`` those of crowded threads and descriptors into spans of so many rows. ``run`` names the columns of the
    events (host, run) that tell traces apart: equal threads, processes and numbers of two of them have nothing to do
    with each other; the dimension and the snapshots may have them too. With ``filter_first`` a call that the filters
    drop does not change the table of open files, as in the stream; without, files are looked up before the filters.
    """

    pid: int | None = None
    tid: int | None = None
    exclude_pids: tuple[int, ...] = ()
    comm: str | None = None
    path: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    scope: str = "pid"
    strict_minus_one: bool = False
    keep_access_mode: bool = False
    split_ns: int | Rows | None = None
    run: tuple[str, ...] = ()
    filter_first: bool = False


def selected(events: DataFrame, dim: DataFrame, o: Options) -> DataFrame:
    """The events that take part in pairing, with ``record_kind``."""
    out = filters.by_process(events, o.pid, o.tid, o.exclude_pids)
    if o.include or o.exclude:
        out = filters.by_tracepoint(out, dim, o.include, o.exclude, o.run)
    ids = ["trace_id", *(k for k in o.run if k in dim.columns)]
    out = out.join(dim.where("phase = 'enter'").select(*ids, "record_kind"), ids, "left")
    out = out.where((F.col("phase") == "exit") | filters.raw_filter(F.col("record_kind"), o.comm, o.path))
    return pairing.comm_gate(out, (*o.run, "tid"), o.split_ns) if o.comm else out


def enriched_calls(events: DataFrame, dim: DataFrame | None = None, o: Options = Options(), proc_fd: DataFrame | None = None, proc_exe: DataFrame | None = None) -> DataFrame:
    """Completed calls with comm, file, duration and gap, and all columns that the operators use."""
    dim = dim if dim is not None else syscall_dim(events.sparkSession)
    by, filtered = (*o.run, "tid"), bool(o.comm or o.path)
    chosen = selected(events, dim, o) if filtered else _chosen(events, dim, o)
    calls = pairing.valid_calls(pairing.match(chosen, by, o.split_ns), dim, o.run)
    calls = fdtable.attach_comm(calls, proc_exe, o.split_ns, o.run, {} if filtered else pairing.BEFORE)
    if not filtered:
        calls = pairing.timed(calls)
    calls = fdtable.attach_files(calls, proc_fd, o.scope, o.strict_minus_one, o.keep_access_mode, o.split_ns, o.run, (o.comm, o.path) if o.filter_first else None)
    if not filtered:
        return calls
    return pairing.durations(calls.where(filters.pair_filter(o.comm, o.path)), by, o.split_ns)


def _chosen(events: DataFrame, dim: DataFrame, o: Options) -> DataFrame:
    """``selected`` without filters on comm and path, which needs no record kinds."""
    out = filters.by_process(events, o.pid, o.tid, o.exclude_pids)
    return filters.by_tracepoint(out, dim, o.include, o.exclude, o.run) if o.include or o.exclude else out


def completed_calls(events: DataFrame, dim: DataFrame | None = None, o: Options = Options(), proc_fd: DataFrame | None = None, proc_exe: DataFrame | None = None) -> DataFrame:
    """Completed calls in the columns of ``PAIRS``, after those of ``run``."""
    return enriched_calls(events, dim, o, proc_fd, proc_exe).select(*o.run, *[c.split(" ")[0] for c in PAIRS.split(", ")])
