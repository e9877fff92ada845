"""The six-key aggregate of completed calls, its merging, and stacks for flame graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.render import file_flags, file_name
from tracelake.functions.text import flags_text, path_stack, trim_comm
from tracelake.schema import KEYS6, MEASURES

DEFAULT_FIELDS = ("pid", "path", "tracepoint")
#: The names of the measures as users give them.
COUNTS = {"count": "count", "duration": "duration", "durationToPrev": "duration_to_prev", "bytes": "bytes"}


#: Sums over many threads: nanoseconds of thousands of threads over a month pass 2^63. A thread's own calls follow each other, so sums by thread stay within a bigint.
WIDE = "decimal(38,0)"


def total(column: str) -> Column:
    """The sum of a column of whole numbers, however large."""
    return F.sum(F.col(column).cast(WIDE))


def moved_bytes() -> Column:
    """The bytes that a call read, wrote or moved: its result, where the call's class counts bytes."""
    return F.when((F.col("io_class") != "none") & (F.col("ret") > 0), F.col("ret")).otherwise(F.lit(0)).cast("bigint")


def agg6(calls: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Counts and sums by path, tracepoint, trimmed comm, process, thread and flags; partial sums run before the shuffle."""
    rows = calls.select(
        file_name(F.col("file")).alias("path"), F.col("enter_trace_id").alias("trace_id"), trim_comm(F.coalesce("comm", F.lit(""))).alias("comm"), "pid", "tid",
        file_flags(F.col("file")).alias("flags"), F.lit(1).cast("bigint").alias("count"), "duration", F.col("gap").alias("duration_to_prev"),
        (moved_bytes() if with_bytes else F.lit(0).cast("bigint")).alias("bytes"),
    )
    return merge(rows)


def merge(*aggregates: DataFrame) -> DataFrame:
    """One aggregate from several, by the same sums; associative, so runs can be rolled up step by step."""
    every = aggregates[0].select(*KEYS6, *MEASURES)
    for a in aggregates[1:]:
        every = every.unionByName(a.select(*KEYS6, *MEASURES))
    return every.groupBy(*KEYS6).agg(*[F.sum(m).alias(m) for m in MEASURES])


def field(name: str) -> Column:
    """A frame of a stack from an aggregate's row (with ``tracepoint`` from the dimension)."""
    fields = {
        "path": path_stack(F.col("path")), "comm": F.col("comm"), "tracepoint": F.col("tracepoint"), "pid": F.col("pid").cast("string"), "tid": F.col("tid").cast("string"),
        "flags": flags_text(F.col("flags")),
    }
    if name not in fields:
        raise ValueError(f"no field {name!r}; there are {', '.join(fields)}")
    return fields[name]


def measure(name: str) -> Column:
    if name not in COUNTS:
        raise ValueError(f"no measure {name!r}; there are {', '.join(COUNTS)}")
    return F.col(COUNTS[name])


def collapse(aggregate: DataFrame, dim: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, count: str = "count") -> DataFrame:
    """``stack`` and ``value``: the chosen fields joined by semicolons, equal stacks added up."""
    frames, value = [field(f) for f in fields], measure(count)
    names = dim.select("trace_id", F.concat_ws("_", "phase", "name").alias("tracepoint"))
    named = aggregate.join(names, "trace_id", "left").withColumn("tracepoint", F.coalesce("tracepoint", F.col("trace_id").cast("string")))
    return named.select(F.concat_ws(";", *frames).alias("stack"), value.alias("value")).groupBy("stack").agg(total("value").alias("value"))


def lines(stacks: DataFrame) -> DataFrame:
    return stacks.select(F.concat_ws(" ", "stack", F.col("value").cast("string")).alias("line"))


def rollup_paths(aggregate: DataFrame, levels: int = 3) -> DataFrame:
    """The inner nodes of a flame graph over directories: sums for every beginning of the paths, up to ``levels`` parts."""
    parts = F.split("path", "/", -1)
    named = aggregate.select(*[F.get(parts, F.lit(i + 1)).alias(f"level{i + 1}") for i in range(levels)], *MEASURES)
    names = [f"level{i + 1}" for i in range(levels)]
    return named.rollup(*names).agg(*[(F.sum(m) if m == "count" else total(m)).alias(m) for m in MEASURES], F.grouping_id().alias("depth_mask"))
