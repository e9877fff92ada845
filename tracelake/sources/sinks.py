"""Where completed calls, aggregates and stacks are written, and aggregates read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.render import HEADER, pair_text
from tracelake.operators.aggregate import lines
from tracelake.schema import KEYS6, MEASURES


def row_stream(calls: DataFrame) -> DataFrame:
    """The lines of completed calls in the order of their exits, as ``value``."""
    return calls.select("exit_time_ns", "exit_seq", pair_text().alias("value"))


def write_rows(calls: DataFrame, path: str) -> None:
    """The row stream as text, sorted over all files by exit, after one line with the header."""
    head = calls.sparkSession.createDataFrame([(-(1 << 63), -(1 << 63), HEADER)], "exit_time_ns bigint, exit_seq bigint, value string")
    head.unionByName(row_stream(calls)).orderBy("exit_time_ns", "exit_seq").select("value").write.text(path)


RUN = ("host", "run_name", "run_ts")


def save_run(rows: DataFrame, path: str, host: str, run_name: str, run_ts: str) -> None:
    """A run's rows (an aggregate, sketches) as the run's part of a table partitioned by host, run and time.

    Saving a run again, or after a try that failed, replaces its part and no other; a failure midway leaves what was there.
    """
    tagged = rows.withColumns(dict(zip(RUN, map(F.lit, (host, run_name, run_ts)), strict=True)))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*RUN).parquet(path)


def load_runs(spark: SparkSession, path: str, host: str | None = None, run_name: str | None = None, run_ts: str | None = None) -> DataFrame:
    """The rows of the runs of these names (all, where none is given), with the columns of ``RUN`` as text; only their folders are read."""
    found = spark.read.parquet(path)
    found = found.withColumns({c: F.col(c).cast("string") for c in RUN})
    for column, value in zip(RUN, (host, run_name, run_ts), strict=True):
        found = found if value is None else found.where(F.col(column) == value)
    return found


def save_aggregate(aggregate: DataFrame, path: str, host: str, run_name: str, run_ts: str) -> None:
    """``save_run`` of a six-key aggregate."""
    save_run(aggregate.select(*KEYS6, *MEASURES), path, host, run_name, run_ts)


def load_aggregate(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    return load_runs(spark, path, host)


def collapsed_path(base: str, fields: Sequence[str], count: str) -> str:
    """``base``, which may name a file system, and a suffix without a colon, which cannot stand in the last part of a Hadoop path."""
    return f"{base}.{'_'.join(fields)}-by-{count}.collapsed"


def write_collapsed(stacks: DataFrame, base: str, fields: Sequence[str], count: str) -> str:
    """The lines of the stacks as compressed text under a name that tells fields and measure; kept as it is if it exists."""
    path = collapsed_path(base, fields, count)
    lines(stacks).write.mode("ignore").option("compression", "gzip").text(path)
    return path
