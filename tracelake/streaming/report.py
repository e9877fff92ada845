"""The figures of a run while its stream runs, from the batches themselves: nothing is read for them."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tracelake.operators.pairing import rates

FIGURES = ("tracepoints", "syscalls", "mismatches", "syscalls_after_filter", "late")


class StreamReport(StreamingQueryListener):
    """Sums over the batches of one query.

        report = StreamReport()
        spark.streams.addListener(report)
        calls = report.calls(pair_stream(report.events(read_events(spark, path)), dim, audit=True))
        run_once(calls, checkpoint, sink)
        report.row(spark, 60.0)

    Spark tells the figures of a batch when it is done. A batch that is tried again, also by a later start of the query, replaces its figures. The calls
    need ``audit`` for mismatches and late events to be seen; without it they count as none.
    """

    def __init__(self) -> None:
        own = uuid.uuid4().hex
        self._events, self._calls = f"events_{own}", f"calls_{own}"
        self._lock, self._ended, self._runs = threading.Lock(), threading.Event(), set()
        self._sums, self._last = dict.fromkeys(FIGURES, 0), (-1, {})

    def events(self, events: DataFrame) -> DataFrame:
        return events.observe(self._events, F.count(F.lit(1)).alias("tracepoints"))

    def calls(self, calls: DataFrame) -> DataFrame:
        outcome = F.col("outcome") if "outcome" in calls.columns else F.lit("completed")
        count = lambda *which: F.count(F.when(outcome.isin(*which), 1))
        figures = {"syscalls": count("completed", "mismatch"), "mismatches": count("mismatch"), "syscalls_after_filter": count("completed"), "late": count("late")}
        return calls.observe(self._calls, *[c.alias(n) for n, c in figures.items()])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {k: v for name in (self._events, self._calls) if name in p.observedMetrics for k, v in p.observedMetrics[name].asDict().items()}
        if not seen:
            return
        with self._lock:
            self._runs.add(p.runId)
            number, figures = self._last
            if p.batchId > number:
                self._add(figures)
            if p.batchId >= number:
                self._last = (p.batchId, seen)

    def _add(self, figures: dict) -> None:
        for k, v in figures.items():
            self._sums[k] += v or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self._runs:
            self._ended.set()

    def row(self, spark: SparkSession, seconds: float, wait: float = 0.0) -> DataFrame:
        """The figures so far, as ``run_stats`` has them, and the number of late events; ``wait``: seconds to wait for the query's end at most."""
        if wait:
            self._ended.wait(wait)
        with self._lock:
            now = {n: self._sums[n] + (self._last[1].get(n) or 0) for n in FIGURES}
        return rates(spark.range(1).select(*[F.lit(v).cast("bigint").alias(n) for n, v in now.items()]), seconds)
