"""Typed events from tables: a trace over the driver's ``events``, and snapshots of the process table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The trace as one statement for Spark and DuckDB, apart from {TNS}, the nanoseconds of a row's time. It leaves out every 23rd
#: enter and 17th exit, spoils every 29th exit's id, and lets calls of a thread overlap.
TRACE_SQL = """
WITH b AS (
  SELECT event_id, 1000 + user_id AS pid, (1000 + user_id) * 10 + event_id % 2 AS tid,
         {TNS} AS t0, CAST(round(value * 100) AS BIGINT) AS v,
         CASE WHEN event_id % 11 = 0 THEN 'newstat' WHEN event_id % 13 = 0 THEN 'rename'
              WHEN event_id % 19 = 0 THEN 'sync'    WHEN event_id % 31 = 0 THEN 'fcntl'
              WHEN event_type = 'signup' THEN 'openat' WHEN event_type = 'view' THEN 'read'
              WHEN event_type = 'click' THEN 'write'   WHEN event_type = 'purchase' THEN 'dup'
              ELSE 'close' END AS name,
         '/data/' || event_type || '/k' || regexp_extract(props, '[0-9]+', 0) AS path,
         3 + event_id % 8 AS fd0, 'app' || CAST(user_id % 5 AS STRING) AS comm0
  FROM events),
d AS (
  SELECT b.*, CASE name WHEN 'newstat' THEN 874 WHEN 'rename' THEN 884 WHEN 'sync' THEN 1040
         WHEN 'fcntl' THEN 912 WHEN 'openat' THEN 798 WHEN 'read' THEN 858 WHEN 'write' THEN 856
         WHEN 'dup' THEN 932 ELSE 792 END AS enter_id FROM b)
SELECT t0 AS time_ns, event_id * 2 AS seq, 'enter' AS phase, enter_id AS trace_id, pid, tid,
       CASE WHEN name IN ('read','write','dup','close','fcntl') THEN fd0 END AS fd,
       CASE WHEN name = 'openat' THEN 2 END AS flags,
       CASE WHEN name IN ('openat','newstat') THEN path END AS path,
       CASE WHEN name = 'rename' THEN path || '.tmp' END AS oldname,
       CASE WHEN name = 'rename' THEN path END AS newname,
       CASE WHEN name = 'openat' THEN comm0 END AS comm,
       CASE WHEN name = 'fcntl' THEN 4 END AS cmd, CASE WHEN name = 'fcntl' THEN 3072 END AS arg,
       CAST(NULL AS BIGINT) AS ret
FROM d WHERE event_id % 23 <> 0
UNION ALL
SELECT t0 + v * 1000000000, event_id * 2 + 1, 'exit',
       CASE WHEN event_id % 29 = 0 THEN enter_id + 1 ELSE enter_id - 1 END, pid, tid,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN name = 'openat' AND event_id % 7 = 0 THEN -2 WHEN name = 'openat' THEN fd0
            WHEN name = 'dup' THEN 3 + (event_id * 5 + 1) % 8
            WHEN name IN ('read','write') THEN v ELSE 0 END
FROM d WHERE event_id % 17 <> 0
"""
#: A second trace, of few processes with long histories and of more kinds of calls, on two hosts whose processes, threads and
#: numbers are the same but whose times and files differ. {LIT} is the type of whole numbers in strings.
HOSTS_SQL = """
WITH b AS (
  SELECT h.host, h.late, event_id, 1000 + user_id % 40 AS pid, (1000 + user_id % 40) * 10 + event_id % 2 AS tid, {TNS} + h.late * 7000000000 AS t0,
         CAST(round(value * 100) AS BIGINT) AS v, 3 + event_id % 6 AS fd0, 3 + (event_id * 5 + h.late) % 6 AS fd1,
         CASE WHEN event_id % 7 = 0 THEN 'creat' WHEN event_id % 11 = 0 THEN 'dup3' WHEN event_id % 13 = 0 THEN 'dup2' WHEN event_id % 5 = 0 THEN 'fcntl'
              WHEN event_id % 17 = 0 THEN 'rename' WHEN event_id % 19 = 0 THEN 'sync' WHEN event_id % 23 = 0 THEN 'newstat' WHEN event_id % 29 = 0 THEN 'copy_file_range'
              WHEN event_id % 31 = 0 THEN 'msync' WHEN event_type = 'signup' THEN 'openat' WHEN event_type = 'view' THEN 'read' WHEN event_type = 'click' THEN 'write'
              WHEN event_type = 'purchase' THEN 'dup' ELSE 'close' END AS name,
         h.root || event_type || '/k' || CAST(event_id % 4 AS {LIT}) AS path, ' app' || CAST(event_id % 3 AS {LIT}) || ' ' AS comm0
  FROM events CROSS JOIN (SELECT 'h0' AS host, 0 AS late, '/data/' AS root UNION ALL SELECT 'h1', 1, '/srv/') h),
d AS (
  SELECT b.*, CASE name WHEN 'creat' THEN 796 WHEN 'dup3' THEN 928 WHEN 'dup2' THEN 930 WHEN 'fcntl' THEN 912 WHEN 'rename' THEN 884 WHEN 'sync' THEN 1040 WHEN 'newstat' THEN 874
         WHEN 'copy_file_range' THEN 1100 WHEN 'msync' THEN 1102 WHEN 'openat' THEN 798 WHEN 'read' THEN 858 WHEN 'write' THEN 856 WHEN 'dup' THEN 932 ELSE 792 END AS enter_id FROM b)
SELECT host, t0 AS time_ns, event_id * 2 AS seq, 'enter' AS phase, enter_id AS trace_id, pid, tid,
       CASE WHEN name IN ('read', 'write', 'dup', 'dup2', 'dup3', 'close', 'fcntl', 'copy_file_range') THEN fd0 END AS fd,
       CASE WHEN name = 'openat' THEN event_id % 3 WHEN name = 'dup3' THEN event_id % 2 * 524288 END AS flags,
       CASE WHEN name IN ('openat', 'newstat', 'creat') THEN path END AS path, CASE WHEN name = 'rename' THEN path || '.tmp' END AS oldname,
       CASE WHEN name = 'rename' THEN path END AS newname, CASE WHEN name = 'openat' THEN comm0 END AS comm,
       CASE WHEN name = 'fcntl' THEN CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1030 WHEN 2 THEN 4 ELSE 3 END END AS cmd,
       CASE WHEN name = 'fcntl' THEN 3072 + event_id % 2 * 16384 END AS arg, CAST(NULL AS BIGINT) AS ret
FROM d WHERE event_id % 37 <> 0
UNION ALL
SELECT host, t0 + v * 1000000, event_id * 2 + 1, 'exit', CASE WHEN event_id % 41 = 0 THEN enter_id + 1 ELSE enter_id - 1 END, pid, tid,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN event_id % 9 = 0 THEN -2 WHEN name IN ('openat', 'creat', 'dup', 'dup2', 'dup3', 'fcntl') THEN fd1 WHEN name IN ('read', 'write', 'copy_file_range') THEN v ELSE 0 END
FROM d WHERE event_id % 43 <> 0
"""
#: What was open, and which programs ran, on the first host before that trace.
HELD_FDS_SQL = """SELECT 'h0' AS host, 1000 + n_nationkey AS pid, 3 + n_nationkey % 6 AS fd, '/held/k' || CAST(n_nationkey % 4 AS {LIT}) AS name, CASE WHEN n_nationkey % 5 > 0 THEN '0100002' END AS flags_octal FROM nation"""
HELD_EXES_SQL = """SELECT 'h0' AS host, (1000 + n_nationkey) * 10 + n_nationkey % 2 AS tid, '/usr/bin/app' || CAST(n_nationkey % 3 AS {LIT}) AS exe FROM nation"""
#: The enter ids of that trace.
HOSTS_IDS = {"creat": 796, "dup3": 928, "dup2": 930, "fcntl": 912, "rename": 884, "sync": 1040, "newstat": 874, "copy_file_range": 1100, "msync": 1102, "openat": 798, "read": 858, "write": 856, "dup": 932, "close": 792}
SPARK_TNS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000"
DUCKDB_TNS = "epoch_us(ts) * 1000"
#: Record kinds by enter tracepoint id in the statement above, and the event types of enters by kind.
KIND_OF = {798: "open", 858: "fd", 856: "fd", 932: "fd", 792: "fd", 874: "path", 884: "name", 1040: "null", 912: "fcntl"}
ENTER_TYPE = {"open": 1, "fd": 3, "null": 5, "name": 9, "path": 11, "fcntl": 13, "dup3": 15}
RET_TYPE = 8


def _typed(t: DataFrame, kind_of: dict[int, str]) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for k, v in kind_of.items() for x in (k, ENTER_TYPE[v])])
    event_type = F.when(F.col("phase") == "exit", F.lit(RET_TYPE)).otherwise(kinds[F.col("trace_id")])
    c = F.col
    return t.select(
        *(n for n in ("host",) if n in t.columns), c("seq").cast("bigint"), event_type.cast("int").alias("event_type"), "phase", c("trace_id").cast("int"), c("time_ns").cast("bigint"),
        c("pid").cast("bigint"), c("tid").cast("bigint"), c("fd").cast("int"), c("flags").cast("int"), "path", "oldname", "newname", "comm", c("cmd").cast("bigint"), c("arg").cast("bigint"),
        "ret", F.when(c("phase") == "exit", F.lit(0)).alias("ret_type"),
    )


def _run_sql(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    sql = sql.replace("{TNS}", SPARK_TNS).replace("{LIT}", "STRING").replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed events of a trace over the driver's ``events`` table."""
    return _typed(_run_sql(spark, sf_dir, TRACE_SQL, "events"), KIND_OF)


def hosts_trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The typed events of the trace of two hosts, and its snapshots of open files and programs."""
    from tracelake.functions.dims import record_kind

    events = _typed(_run_sql(spark, sf_dir, HOSTS_SQL, "events"), {i: record_kind(n) for n, i in HOSTS_IDS.items()})
    fds, exes = _run_sql(spark, sf_dir, HELD_FDS_SQL, "nation"), _run_sql(spark, sf_dir, HELD_EXES_SQL, "nation")
    return events, proc_fd_snapshot(fds, ("host",)), proc_exe_snapshot(exes, ("host",))


def with_time(events: DataFrame, boot_epoch_ns: int = 0) -> DataFrame:
    """``ts``, the wall-clock time of each event; the integer nanoseconds stay as they are."""
    return events.withColumn("ts", F.timestamp_micros(F.expr(f"(time_ns + {int(boot_epoch_ns)}L) div 1000")))


def proc_fd_snapshot(table: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Open files as captured: ``flags_octal`` read as flags, unknown where missing. ``run``: columns that tell hosts apart."""
    from tracelake.functions.text import octal
    from tracelake.schema import UNKNOWN

    flags = F.coalesce(octal(F.col("flags_octal")), F.lit(UNKNOWN)).alias("flags")
    return table.select(*run, F.col("pid").cast("bigint"), F.col("fd").cast("int"), "name", flags).dropDuplicates([*run, "pid", "fd"])


def proc_exe_snapshot(table: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Program names as captured: the last part of each thread's program path. The stream takes them as initial state if the table has a ``pid``."""
    from tracelake.functions.text import basename

    pid = [F.col("pid").cast("bigint")] if "pid" in table.columns else []
    return table.select(*run, *pid, F.col("tid").cast("bigint"), basename(F.col("exe")).alias("exe_comm")).dropDuplicates([*run, "tid"])
