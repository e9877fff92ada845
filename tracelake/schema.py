"""Schemas of events, completed calls, aggregates and snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENTS = (
    "seq bigint, event_type int, phase string, trace_id int, time_ns bigint, pid bigint, tid bigint, fd int, flags int, path string, "
    "oldname string, newname string, comm string, cmd bigint, arg bigint, ret bigint, ret_type int"
)
FILE = "struct<kind:string,fd:int,name:string,oldname:string,flags:int,from_snapshot:boolean>"
PAIRS = (
    "pid bigint, tid bigint, enter_seq bigint, exit_seq bigint, enter_time_ns bigint, exit_time_ns bigint, enter_trace_id int, exit_trace_id int, "
    f"name string, comm string, file {FILE}, ret bigint, duration bigint, gap bigint"
)
AGG6 = "path string, trace_id int, comm string, pid bigint, tid bigint, flags int, count bigint, duration bigint, duration_to_prev bigint, bytes bigint"
PROC_EXE = "tid bigint, exe string"
PROC_FD = "pid bigint, fd int, name string, flags_octal string"
KEYS6 = ("path", "trace_id", "comm", "pid", "tid", "flags")
MEASURES = ("count", "duration", "duration_to_prev", "bytes")
#: Flags that are not known.
UNKNOWN = -1


def file_struct(kind: Column, fd: Column, name: Column, oldname: Column, flags: Column, from_snapshot: Column) -> Column:
    return F.struct(
        kind.cast("string").alias("kind"), fd.cast("int").alias("fd"), name.cast("string").alias("name"), oldname.cast("string").alias("oldname"),
        flags.cast("int").alias("flags"), from_snapshot.cast("boolean").alias("from_snapshot"),
    )
