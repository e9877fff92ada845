"""Stacks whose levels need more than the six keys, and flame-graph trees of any depth.

A level says what it needs: columns of calls, a look at the thread's call before, or a small table to join. All levels of a stack are planned at
once: windows over the calls first, then one aggregate by what the levels need, and joins with its few rows after it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.render import file_flags, file_name
from tracelake.functions.text import flags_text, path_stack, trim_comm
from tracelake.operators.aggregate import measure, moved_bytes, total
from tracelake.operators.ordered import Rows, look_back
from tracelake.operators.views import directory, mounts_of
from tracelake.schema import MEASURES

#: What calls can be summed up by, as columns of calls.
KEYS: dict[str, Callable[[], Column]] = {
    "path": lambda: file_name(F.col("file")), "comm": lambda: trim_comm(F.coalesce("comm", F.lit(""))), "name": lambda: F.col("name"), "pid": lambda: F.col("pid"), "tid": lambda: F.col("tid"),
    "flags": lambda: file_flags(F.col("file")), "previous": lambda: F.col("previous"),
}


@dataclass(frozen=True)
class Tables:
    """What levels may be looked up in: ``users`` (pid, user) and ``mounts`` (mount, device), with the columns of a run if they have any; ``buckets``: names and patterns of
    paths, the first that is found counts."""

    users: DataFrame | None = None
    mounts: DataFrame | None = None
    buckets: Sequence[tuple[str, str]] = ()


@dataclass(frozen=True)
class Level:
    """A level of a stack: the ``keys`` that it is made from, the frame as a column, and ``add``, which joins what the frame needs to the sums."""

    keys: tuple[str, ...]
    frame: Callable[[Tables], Column]
    add: str = ""


def _bucket(t: Tables) -> Column:
    out = F.lit("OTHER")
    for name, pattern in reversed(t.buckets):
        out = F.when(F.col("path").rlike(pattern), F.lit(name)).otherwise(out)
    return out


LEVELS: dict[str, Level] = {
    "path": Level(("path",), lambda t: path_stack(F.col("path"))),
    "comm": Level(("comm",), lambda t: F.col("comm")),
    "tracepoint": Level(("name",), lambda t: F.concat(F.lit("enter_"), F.col("name"))),
    "call": Level(("name",), lambda t: F.col("name")),
    "pid": Level(("pid",), lambda t: F.col("pid").cast("string")),
    "tid": Level(("tid",), lambda t: F.col("tid").cast("string")),
    "flags": Level(("flags",), lambda t: flags_text(F.col("flags"))),
    "directory": Level(("path",), lambda t: directory(F.col("path"))),
    "bucket": Level(("path",), _bucket),
    "user": Level(("pid",), lambda t: F.coalesce("user", F.lit("?")), "users"),
    "mount": Level(("path",), lambda t: F.coalesce("mount", F.lit("none")), "mounts"),
    "device": Level(("path",), lambda t: F.coalesce("device", F.lit("none")), "mounts"),
    "transition": Level(("name", "previous"), lambda t: F.concat(F.coalesce("previous", F.lit("start")), F.lit("->"), F.col("name"))),
}


def _with_users(sums: DataFrame, t: Tables) -> DataFrame:
    return sums.join(t.users.dropDuplicates(["pid"]).select("pid", "user"), "pid", "left")


def _with_mounts(sums: DataFrame, t: Tables) -> DataFrame:
    found = mounts_of(sums.select("path").distinct(), t.mounts)
    return sums.join(found.select(F.col("path").alias("its_path"), "mount", "device"), F.col("path").eqNullSafe(F.col("its_path")), "left").drop("its_path")


ADD = {"users": _with_users, "mounts": _with_mounts}


def stacks(calls: DataFrame, levels: Sequence[str], count: str = "count", tables: Tables = Tables(), by: Sequence[str] = ("tid",), split_ns: int | Rows | None = None) -> DataFrame:
    """``stack`` and ``value``: the levels, joined by semicolons, of enriched calls, and the chosen measure.

    ``by`` are the columns of a thread and ``split_ns`` cuts its history, for levels that look at the call before. Unknown levels, and levels whose table is
    missing, are a ValueError. Null frames are left out of the stack. The calls are read once.
    """
    value = measure(count)
    if unknown := [n for n in levels if n not in LEVELS]:
        raise ValueError(f"no level {unknown[0]!r}; there are {', '.join(LEVELS)}")
    chosen = [LEVELS[n] for n in levels]
    adds = list(dict.fromkeys(x.add for x in chosen if x.add))
    for a in adds:
        if getattr(tables, a) is None:
            raise ValueError(f"the levels {', '.join(levels)} need a table of {a}")
    keys = list(dict.fromkeys(k for x in chosen for k in x.keys))
    if "previous" in keys:
        calls = look_back(calls, by, F.col("name"), "previous", order=("exit_time_ns", "exit_seq"), split_ns=split_ns)
    wanted = calls.select(*[KEYS[k]().alias(k) for k in keys], F.lit(1).cast("bigint").alias("count"), "duration", F.col("gap").alias("duration_to_prev"), *([moved_bytes().alias("bytes")] if count == "bytes" else []))
    sums = wanted.groupBy(*keys).agg(*[(F.sum(m) if m == "count" else total(m)).alias(m) for m in MEASURES if m in wanted.columns])
    for a in adds:
        sums = ADD[a](sums, tables)
    return sums.select(F.concat_ws(";", *[x.frame(tables) for x in chosen]).alias("stack"), value.alias("value")).groupBy("stack").agg(total("value").alias("value"))


def flame_tree(stacked: DataFrame) -> DataFrame:
    """The nodes of a flame graph, of all depths: ``node`` (the frames from the root on), ``parent`` (null for the first frames), ``frame``, ``depth`` from 1, ``total`` and
    ``self`` (what is not in a node below).

    Every stack offers its beginnings as keys; equal ones are summed up before the shuffle, so that a node near the root, which nearly all stacks share, comes
    from each task once. Null stacks have no node, the empty stack is one empty frame.
    """
    frames = F.split("stack", ";", -1)
    each = stacked.where("stack is not null").select("value", F.size(frames).alias("n"), F.posexplode(frames).alias("at", "frame"), frames.alias("frames"))
    node = F.array_join(F.slice("frames", 1, F.col("at") + 1), ";")
    rows = each.select(node.alias("node"), (F.col("at") + 1).alias("depth"), "value", F.when(F.col("at") + 1 == F.col("n"), F.col("value")).otherwise(F.lit(0)).alias("own"))
    sums = rows.groupBy("node", "depth").agg(total("value").alias("total"), total("own").alias("self"))
    parts = F.split("node", ";", -1)
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice(parts, 1, F.col("depth") - 1), ";"))
    return sums.select("node", parent.alias("parent"), F.element_at(parts, -1).alias("frame"), "depth", "total", "self")
