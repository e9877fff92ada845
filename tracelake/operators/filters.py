"""Filters on events, before pairing, and on completed calls, after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.render import file_name

#: Longest filters, in characters.
MOST_COMM, MOST_PATH = 16, 256
#: Calls whose completed pairs are tested again, with what was joined to them.
TESTED_KINDS = ("fd", "dup3", "null", "fcntl")


def check_filters(comm: str | None, path: str | None) -> None:
    if comm and len(comm) > MOST_COMM:
        raise ValueError(f"the comm filter has more than {MOST_COMM} characters")
    if path and len(path) > MOST_PATH:
        raise ValueError(f"the path filter has more than {MOST_PATH} characters")


def by_process(events: DataFrame, pid: int | None = None, tid: int | None = None, exclude_pids: Sequence[int] = ()) -> DataFrame:
    """Events of one process and thread, without those of the given processes (the tracer's own); reaches the scan."""
    out = events
    if pid is not None and pid >= 0:
        out = out.where(F.col("pid") == pid)
    if tid is not None and tid >= 0:
        out = out.where(F.col("tid") == tid)
    return out.where(~F.col("pid").isin(list(exclude_pids))) if exclude_pids else out


def by_time(events: DataFrame, start_ns: int, seconds: float = 60) -> DataFrame:
    """The first ``seconds`` from ``start_ns`` on."""
    return events.where((F.col("time_ns") >= start_ns) & (F.col("time_ns") < int(start_ns + seconds * 1_000_000_000)))


def by_tracepoint(events: DataFrame, dim: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), run: Sequence[str] = ()) -> DataFrame:
    """Events whose tracepoint's full name (sys_enter_read) no pattern of ``exclude`` finds and some of ``include``; none: all.

    Patterns are not anchored. A choice of enters alone leaves no exits and so no pairs.
    """
    name = F.concat(F.lit("sys_"), F.col("phase"), F.lit("_"), F.col("name"))
    wanted = F.lit(True)
    for p in exclude:
        wanted = wanted & ~name.rlike(p)
    if include:
        any_of = F.lit(False)
        for p in include:
            any_of = any_of | name.rlike(p)
        wanted = wanted & any_of
    ids = ["trace_id", *(k for k in run if k in dim.columns)]
    return events.join(dim.where(wanted).select(*ids).distinct(), ids, "left_semi")


def raw_filter(kind: Column, comm: str | None = None, path: str | None = None) -> Column:
    """Whether an event of the record kind passes: opens by comm and path, path calls by path, renames by either name."""
    check_filters(comm, path)
    opened, named, other = F.lit(True), F.lit(True), F.lit(True)
    if comm:
        opened = opened & F.coalesce(F.col("comm").contains(comm), F.lit(False))
    if path:
        has = F.coalesce(F.col("path").contains(path), F.lit(False))
        opened, other = opened & has, has
        named = F.coalesce(F.col("oldname").contains(path), F.lit(False)) | F.coalesce(F.col("newname").contains(path), F.lit(False))
    return F.when(kind == "open", opened).when(kind == "path", other).when(kind == "name", named).otherwise(F.lit(True))


def pair_filter(comm: str | None = None, path: str | None = None) -> Column:
    """Whether a completed call passes. With a path filter, calls without a file (sync and the like) never do."""
    check_filters(comm, path)
    keep = F.lit(True)
    if comm:
        keep = keep & F.coalesce(F.col("comm").contains(comm), F.lit(False))
    if path:
        keep = keep & F.col("file").isNotNull() & file_name(F.col("file")).contains(path)
    return F.when(F.col("record_kind").isin(list(TESTED_KINDS)), keep).otherwise(F.lit(True))


def is_call(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.where(F.col("name") == name)
