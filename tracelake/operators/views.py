"""Further views of completed calls: transitions, buckets of paths, mount points, gaps, times alone, users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.render import file_name
from tracelake.operators.aggregate import total
from tracelake.operators.ordered import Rows, look_back


def transitions(calls: DataFrame, by: Sequence[str] = ("tid",), split_ns: int | Rows | None = None) -> DataFrame:
    """How often one call of a thread follows another, and the time between them; ``split_ns`` cuts long histories."""
    steps = look_back(calls, by, F.col("name"), "previous", order=("exit_time_ns", "exit_seq"), split_ns=split_ns).where("previous is not null")
    return steps.groupBy(F.concat_ws("->", "previous", "name").alias("transition")).agg(F.count("*").alias("count"), total("gap").alias("duration_to_prev"))


def path_buckets(calls: DataFrame, pattern: str) -> DataFrame:
    """Calls whose path a pattern finds against all others."""
    bucket = F.when(file_name(F.col("file")).rlike(pattern), F.lit("PATHMATCH")).otherwise(F.lit("OTHER"))
    return calls.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"), total("duration").alias("duration"))


def directory(path: Column) -> Column:
    """The directory of a path; a dot for paths without one."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), F.lit(".")).when(folder == "", F.lit("/")).otherwise(folder)


def by_directory(aggregate: DataFrame) -> DataFrame:
    """The aggregate by the directory of its paths; paths without one are under a dot."""
    return aggregate.groupBy(directory(F.col("path")).alias("directory")).agg(F.sum("count").alias("count"), total("duration").alias("duration"))


def mounts_of(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Distinct ``paths`` (path and sums that go with it) with ``mount`` and ``device``: the longest mount point that is a beginning of the path, else null.

    Every path offers its beginnings as keys, as many as it has parts, so this is an equi-join.
    """
    parts = F.split("path", "/", -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    keys = paths.withColumn("mount", F.explode_outer(F.when(F.col("path").startswith("/"), F.array_distinct(starts))))
    met = keys.join(mounts.select("mount", "device", F.length("mount").alias("length")), "mount", "left")
    rest = [c for c in paths.columns if c != "path"]
    best = met.groupBy("path").agg(F.max_by(F.struct("mount", "device"), "length").alias("m"), *[F.first(c).alias(c) for c in rest])
    return best.select("path", *rest, "m.mount", "m.device")


def by_mount(aggregate: DataFrame, mounts: DataFrame) -> DataFrame:
    """The aggregate by mount point (``mount``, ``device``): the longest that is a beginning of the path. The sums of a path go with
    it, so the aggregate is read once."""
    best = mounts_of(aggregate.groupBy("path").agg(F.sum("count").alias("count"), total("duration").alias("duration")), mounts)
    return best.groupBy(F.coalesce("mount", F.lit("none")).alias("mount"), F.coalesce("device", F.lit("none")).alias("device")).agg(F.sum("count").alias("count"), total("duration").alias("duration"))


def gaps_by_call(calls: DataFrame) -> DataFrame:
    """The time between calls as a view of its own."""
    return calls.groupBy("name").agg(F.count("*").alias("count"), total("gap").alias("duration_to_prev"), F.max("gap").alias("longest_gap"))


def call_times(calls: DataFrame) -> DataFrame:
    """Counts and times of every call, without files."""
    return calls.groupBy("name", "pid").agg(F.count("*").alias("count"), total("duration").alias("duration"), total("gap").alias("duration_to_prev"))


def with_user(aggregate: DataFrame, users: DataFrame) -> DataFrame:
    """The aggregate by user name, from ``users`` (pid, user); unknown processes are under a question mark."""
    j = aggregate.join(users.select("pid", "user"), "pid", "left")
    return j.groupBy(F.coalesce("user", F.lit("?")).alias("user")).agg(F.sum("count").alias("count"), total("duration").alias("duration"))
