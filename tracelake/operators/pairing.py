"""Enter and exit of a call: pairing, its check, durations and gaps, and the statistics of a run.

A thread has one pending enter at most: a later enter takes its place, an exit consumes it. So the enter of an exit is
the row just before it in the thread, if that row is an enter. Filters on events come first, as an event that is
filtered out does not take a pending enter's place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.ordered import Rows, look_back, look_backs, null_safe

#: What ``durations`` looks back at, in the order of exits.
BEFORE = {"__before": "exit_time_ns"}
ENTER_FIELDS = ("seq", "time_ns", "trace_id", "pid", "fd", "flags", "path", "oldname", "newname", "comm", "cmd", "arg")


def match(events: DataFrame, by: Sequence[str] = ("tid",), split_ns: int | Rows | None = None) -> DataFrame:
    """Every exit that consumes an enter, with ``valid``: the exit's id is the enter's less one.

    Columns: those of ``by``, the enter's fields as ``enter_*`` or under their own names, ``exit_seq``, ``exit_time_ns``, ``exit_trace_id``,
    ``ret``. Rows with a null thread id are a thread of their own.
    """
    enter = F.struct(*[F.col(c) for c in ENTER_FIELDS], F.col("phase"))
    own = events.select(*dict.fromkeys((*by, "time_ns", "seq", "phase", "trace_id", "ret")), enter.alias("__enter"))
    hit = look_back(own, by, F.col("__enter"), "prev", split_ns=split_ns, keep=(F.col("phase") == "exit") & (F.col("prev.phase") == "enter"))
    renamed = {"seq": "enter_seq", "time_ns": "enter_time_ns", "trace_id": "enter_trace_id"}
    return hit.select(
        *[c for c in by if c != "pid"], *[F.col(f"prev.{c}").alias(renamed.get(c, c)) for c in ENTER_FIELDS], F.col("seq").alias("exit_seq"), F.col("time_ns").alias("exit_time_ns"),
        F.col("trace_id").alias("exit_trace_id"), "ret", F.coalesce(F.col("prev.trace_id") - 1 == F.col("trace_id"), F.lit(False)).alias("valid"),
    )


def valid_calls(matched: DataFrame, dim: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """The calls whose ids fit, with the name and the record kind of the call; ids that the dimension lacks are left out.

    Columns of ``run`` that the dimension has belong to its ids, as kernels number their calls differently.
    """
    both = [k for k in run if k in dim.columns]
    names = dim.where("phase = 'enter'").select(*both, F.col("trace_id").alias("enter_trace_id"), "name", "record_kind", "io_class")
    return matched.where("valid").drop("valid").join(names, [*both, "enter_trace_id"])


def mismatches(matched: DataFrame) -> DataFrame:
    """The pairs whose ids do not fit: the audit of what was dropped."""
    return matched.where("not valid")


def unknown_calls(matched: DataFrame, dim: DataFrame) -> DataFrame:
    """Calls whose ids fit but are not in the dimension."""
    return matched.where("valid").join(dim.where("phase = 'enter'").select(F.col("trace_id").alias("enter_trace_id")), "enter_trace_id", "left_anti")


def comm_gate(events: DataFrame, by: Sequence[str] = ("tid",), split_ns: int | Rows | None = None) -> DataFrame:
    """With a filter on comm, only opens count until a thread has completed one: then its comm is known.

    The first completed open of each thread comes from pairing opens and exits alone; enters up to it are dropped.
    """
    opens = F.col("record_kind") == "open"
    early = events.where((F.col("phase") == "exit") | opens)
    done = match(early, by, split_ns).where("valid").groupBy(*by).agg(F.min(F.struct("exit_time_ns", "exit_seq")).alias("__known"))
    done = done.withColumnsRenamed({k: f"__{k}" for k in by})
    gated = events.join(done, null_safe(events, done, by), "left").drop(*[f"__{k}" for k in by])
    after = F.coalesce(F.struct(F.col("time_ns").alias("exit_time_ns"), F.col("seq").alias("exit_seq")) > F.col("__known"), F.lit(False))
    return gated.where((F.col("phase") == "exit") | opens | after).drop("__known")


def durations(calls: DataFrame, by: Sequence[str] = ("tid",), split_ns: int | Rows | None = None) -> DataFrame:
    """``duration``, and ``gap`` to the exit of the thread's previous call among ``calls`` (0 where there is none).

    Apply it to the calls that are left after all filters. An exit time of 0 counts as none. A negative duration
    stays negative.
    """
    return timed(look_backs(calls, by, BEFORE, order=("exit_time_ns", "exit_seq"), split_ns=split_ns))


def timed(seen: DataFrame) -> DataFrame:
    """``durations`` of calls that have looked back at ``BEFORE`` already."""
    gap = F.when(F.coalesce(F.col("__before"), F.lit(0)) == 0, F.lit(0)).otherwise(F.col("enter_time_ns") - F.col("__before"))
    return seen.withColumn("duration", F.col("exit_time_ns") - F.col("enter_time_ns")).withColumn("gap", gap.cast("bigint")).drop("__before")


def run_stats(events: DataFrame, matched: DataFrame, filtered: DataFrame, seconds: float) -> DataFrame:
    """One row: tracepoints, mismatches, calls and calls after the filters, with rates a second."""
    a = events.agg(F.count("*").alias("tracepoints"))
    b = matched.agg(F.count("*").alias("syscalls"), F.coalesce(F.sum((~F.col("valid")).cast("bigint")), F.lit(0)).alias("mismatches"))
    c = filtered.agg(F.count("*").alias("syscalls_after_filter"))
    # Three one-row tables.
    return rates(a.join(b, F.lit(True)).join(c, F.lit(True)), seconds)


def rates(one: DataFrame, seconds: float) -> DataFrame:
    out = one.withColumn("mismatch_percent", F.when(F.col("tracepoints") > 0, 100.0 * F.col("mismatches") / F.col("tracepoints")).otherwise(0.0))
    for name in ("tracepoints", "syscalls", "syscalls_after_filter"):
        out = out.withColumn(f"{name}_per_second", F.col(name) / F.lit(float(seconds)))
    return out


class RunReport:
    """The same figures from the main job itself, which reads nothing more: each step is watched as its rows pass.

        report = RunReport()
        matched = report.matched(match(report.events(events)))
        calls = report.filtered(valid_calls(matched, dim))
        calls.write.parquet(path)
        report.row(spark, 60.0)

    Steps must be read whole, once, by the first job over the result. A step that is never watched counts as empty. If Spark runs a stage again after a
    loss, rows that pass again may be counted again; ``run_stats`` is exact whatever is lost.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def _watch(self, df: DataFrame, step: str, *figures: Column) -> DataFrame:
        self._seen[step] = Observation()
        return df.observe(self._seen[step], *figures)

    def events(self, events: DataFrame) -> DataFrame:
        return self._watch(events, "events", F.count(F.lit(1)).alias("tracepoints"))

    def matched(self, matched: DataFrame) -> DataFrame:
        return self._watch(matched, "matched", F.count(F.lit(1)).alias("syscalls"), F.count(F.when(~F.col("valid"), 1)).alias("mismatches"))

    def filtered(self, calls: DataFrame) -> DataFrame:
        return self._watch(calls, "filtered", F.count(F.lit(1)).alias("syscalls_after_filter"))

    def row(self, spark: SparkSession, seconds: float) -> DataFrame:
        """The figures, once the job is done; waits for it if it still runs."""
        names = ("tracepoints", "syscalls", "mismatches", "syscalls_after_filter")
        got = {k: v for o in self._seen.values() for k, v in o.get.items()}
        one = spark.range(1).select(*[F.lit(got.get(n, 0)).cast("bigint").alias(n) for n in names])
        return rates(one, seconds)
