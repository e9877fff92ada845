"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tracelake.sources.trace import DUCKDB_TNS, HELD_EXES_SQL, HELD_FDS_SQL, HOSTS_IDS, HOSTS_SQL, TRACE_SQL

T = TRACE_SQL.replace("{TNS}", DUCKDB_TNS)
EV = f"""WITH RECURSIVE ev AS ({T}),
nm AS (SELECT * FROM (VALUES (798, 'openat', 'open', 'none'), (858, 'read', 'fd', 'read'), (856, 'write', 'fd', 'write'), (932, 'dup', 'fd', 'none'), (792, 'close', 'fd', 'none'),
       (874, 'newstat', 'path', 'none'), (884, 'rename', 'name', 'none'), (1040, 'sync', 'null', 'none'), (912, 'fcntl', 'fcntl', 'none')) v(trace_id, name, kind, io))"""


def _pairs(source: str, prefix: str = "") -> str:
    """The common table expressions of pairing over the events of ``source``: {prefix}lg, {prefix}mt and {prefix}vc."""
    p = prefix
    w = "OVER (PARTITION BY tid ORDER BY time_ns, seq)"
    cols = ", ".join(f"lag({c}) {w} AS p_{c}" for c in ("phase", "seq", "time_ns", "trace_id", "pid", "fd", "flags", "path", "oldname", "newname", "comm", "cmd", "arg"))
    return f"""{p}lg AS (SELECT *, {cols} FROM {source}),
{p}mt AS (SELECT tid, p_pid AS pid, p_seq AS enter_seq, seq AS exit_seq, p_trace_id AS enter_trace_id, trace_id AS exit_trace_id, ret, p_time_ns AS enter_time_ns, time_ns AS exit_time_ns,
             p_fd AS fd, p_flags AS flags, p_path AS path, p_oldname AS oldname, p_newname AS newname, p_comm AS comm0, p_cmd AS cmd, p_arg AS arg, p_trace_id - 1 = trace_id AS valid
      FROM {p}lg WHERE phase = 'exit' AND p_phase = 'enter'),
{p}vc AS (SELECT {p}mt.*, nm.name, nm.kind, nm.io FROM {p}mt JOIN nm ON nm.trace_id = {p}mt.enter_trace_id WHERE valid)"""


PAIRED = f"{EV},\n{_pairs('ev')}"
GAP = """coalesce(CASE WHEN lag(exit_time_ns) OVER g <> 0 THEN enter_time_ns - lag(exit_time_ns) OVER g END, 0)"""
GAP_W = "WINDOW g AS (PARTITION BY tid ORDER BY exit_time_ns, exit_seq)"
COMM = """CASE WHEN kind = 'open' THEN CASE WHEN ret >= 0 THEN comm0 ELSE '' END
     ELSE coalesce(last_value(CASE WHEN kind = 'open' THEN comm0 END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY exit_time_ns, exit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END"""


def _files(vc: str, prefix: str = "") -> str:
    """Versions of descriptors, links followed by recursion, and {prefix}fl: exit_seq with the file's name, flags and origin."""
    p = prefix
    return f"""{p}ver AS (
  SELECT exit_seq AS vid, pid, exit_time_ns, exit_seq,
         CASE WHEN kind = 'open' AND ret >= 0 THEN 'root' WHEN name = 'close' THEN 'closed' WHEN (name = 'dup' AND ret >= 0) OR (kind = 'fcntl' AND cmd = 4 AND ret >= 0) THEN 'link' END AS vk,
         CASE WHEN name = 'close' OR kind = 'fcntl' THEN fd ELSE ret END AS vfd, fd AS src, path, flags, CASE WHEN kind = 'fcntl' THEN arg & 289792 END AS setf
  FROM {vc}),
{p}vv AS (SELECT * FROM {p}ver WHERE vk IS NOT NULL),
{p}us AS (SELECT exit_seq AS uid, 'link' AS uk, pid, src AS ufd, exit_time_ns, exit_seq FROM {p}vv WHERE vk = 'link'
       UNION ALL SELECT exit_seq, 'use', pid, fd, exit_time_ns, exit_seq FROM {vc} WHERE kind IN ('fd', 'fcntl')),
{p}al AS (SELECT pid, vfd AS f, exit_time_ns, exit_seq, 1 AS o, vid, vk, NULL::BIGINT AS uid, NULL::VARCHAR AS uk FROM {p}vv
       UNION ALL SELECT pid, ufd, exit_time_ns, exit_seq, 0, NULL, NULL, uid, uk FROM {p}us),
{p}ao AS (SELECT *, last_value(vid IGNORE NULLS) OVER w AS lv, last_value(vk IGNORE NULLS) OVER w AS lk FROM {p}al
       WINDOW w AS (PARTITION BY pid, f ORDER BY exit_time_ns, exit_seq, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}lk AS (SELECT v.vid, v.setf, CASE WHEN a.lk <> 'closed' THEN a.lv END AS parent FROM {p}vv v JOIN {p}ao a ON a.uid = v.vid AND a.uk = 'link' WHERE v.vk = 'link'),
{p}rs AS (SELECT vid, path AS fname, flags AS fflags, false AS snap FROM {p}vv WHERE vk = 'root'
       UNION ALL SELECT vid, '', coalesce(setf, -1), true FROM {p}lk WHERE parent IS NULL
       UNION ALL SELECT l.vid, r.fname, coalesce(l.setf, r.fflags), r.snap FROM {p}lk l JOIN {p}rs r ON l.parent = r.vid),
{p}fl AS (SELECT c.exit_seq,
         CASE WHEN kind = 'open' THEN CASE WHEN ret >= 0 THEN c.path ELSE 'N:file' END WHEN kind = 'path' THEN c.path WHEN kind = 'name' THEN newname WHEN kind = 'null' THEN 'N:file'
              WHEN kind = 'fcntl' AND cmd = 4 AND ret >= 0 THEN o.fname ELSE coalesce(r.fname, '') END AS file_name,
         (CASE WHEN kind = 'open' THEN CASE WHEN ret >= 0 THEN c.flags ELSE 0 END WHEN kind IN ('path', 'name') THEN -1 WHEN kind = 'null' THEN 0
              WHEN kind = 'fcntl' AND cmd = 4 AND ret >= 0 THEN o.fflags ELSE coalesce(r.fflags, -1) END)::INTEGER AS file_flags,
         CASE WHEN kind IN ('open', 'path', 'name', 'null') THEN false WHEN kind = 'fcntl' AND cmd = 4 AND ret >= 0 THEN o.snap ELSE coalesce(r.snap, true) END AS from_snapshot
  FROM {vc} c LEFT JOIN {p}ao a ON a.uid = c.exit_seq AND a.uk = 'use'
  LEFT JOIN {p}rs r ON r.vid = CASE WHEN a.lk <> 'closed' THEN a.lv END LEFT JOIN {p}rs o ON o.vid = c.exit_seq)"""


FULL = f"""{PAIRED},
{_files('vc')},
cc AS (SELECT vc.*, {COMM} AS comm, exit_time_ns - enter_time_ns AS duration, {GAP} AS gap FROM vc {GAP_W}),
cf AS (SELECT cc.*, file_name, file_flags FROM cc JOIN fl ON cc.exit_seq = fl.exit_seq)"""
NAMES = {"O_WRONLY": 1, "O_RDWR": 2, "O_ACCMODE": 3, "O_APPEND": 1024, "O_ASYNC": 8192, "O_CLOEXEC": 524288, "O_CREAT": 64, "O_DIRECT": 16384, "O_DIRECTORY": 65536, "O_DSYNC": 4096,
         "O_EXCL": 128, "O_NOATIME": 262144, "O_NOCTTY": 256, "O_NOFOLLOW": 131072, "O_NONBLOCK": 2048, "O_SYNC": 1052672, "O_TRUNC": 512}


def _flags(x: str) -> str:
    parts = [f"CASE WHEN {x} & 3 = 0 THEN 'O_RDONLY' END"] + [f"CASE WHEN {x} & {m} = {m} THEN '{n}' END" for n, m in NAMES.items()]
    return f"CASE WHEN {x} = -1 THEN 'O_NONE' ELSE array_to_string(list_filter([{', '.join(parts)}], lambda n: n IS NOT NULL), '|') END"


AGG = f"""{FULL},
ag AS (SELECT file_name AS path, enter_trace_id AS trace_id, trim(comm) AS comm, pid, tid, file_flags AS flags, count(*) AS count, sum(duration)::BIGINT AS duration,
              sum(gap)::BIGINT AS duration_to_prev, sum(CASE WHEN io <> 'none' AND ret > 0 THEN ret ELSE 0 END)::BIGINT AS moved FROM cf GROUP BY 1, 2, 3, 4, 5, 6)"""
SERIES = """WITH s AS (SELECT event_type AS g, ts, epoch_us(ts) AS us, event_id AS k, round(value * 100)::BIGINT AS bytes, round(value * 1000)::BIGINT AS lat FROM events)"""
LINES = """WITH s AS (SELECT l_returnflag AS g, l_shipdate AS ts, epoch_us(l_shipdate::TIMESTAMP) AS us, l_orderkey * 100 + l_linenumber AS k, round(l_extendedprice)::BIGINT AS bytes, l_quantity::BIGINT AS lat FROM lineitem)"""


def _profile(series: str, name: str) -> str:
    return f"""{series},
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lat) - 1 AS il, row_number() OVER (PARTITION BY g ORDER BY bytes) - 1 AS ib, count(*) OVER (PARTITION BY g) AS n FROM s)
SELECT g AS {name}, count(*) AS count, sum(bytes)::BIGINT AS total_bytes, sum(lat)::BIGINT AS total_latency, min(lat) AS latency_min, max(lat) AS latency_max,
       (sum(lat) // count(*))::BIGINT AS latency_mean, max(lat) FILTER (WHERE il = n // 2) AS latency_median, max(lat) FILTER (WHERE il = least(floor(n * 0.95::DOUBLE), n - 1)) AS latency_p95,
       max(lat) FILTER (WHERE il = least(floor(n * 0.99::DOUBLE), n - 1)) AS latency_p99, min(bytes) AS bytes_min, max(bytes) AS bytes_max, sum(bytes)::DOUBLE / count(*) AS bytes_mean,
       max(bytes) FILTER (WHERE ib = n // 2) AS bytes_median, max(bytes) FILTER (WHERE ib = least(floor(n * 0.95::DOUBLE), n - 1)) AS bytes_p95,
       max(bytes) FILTER (WHERE ib = least(floor(n * 0.99::DOUBLE), n - 1)) AS bytes_p99
FROM r GROUP BY g"""


def _bursts(series: str, threshold: int) -> str:
    return f"""{series},
b AS (SELECT *, bytes > {threshold} AS hi, coalesce(lag(bytes > {threshold}) OVER w, false) AS was FROM s WINDOW w AS (PARTITION BY g ORDER BY ts, k)),
i AS (SELECT *, sum(CASE WHEN hi AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY ts, k) AS run FROM b),
z AS (SELECT g, run, min(us) FILTER (WHERE hi) AS a, min(us) FILTER (WHERE NOT hi AND was) AS e FROM i WHERE run > 0 GROUP BY g, run),
bu AS (SELECT q.g, count(z.e) AS burst_count, coalesce(sum(z.e - z.a), 0)::BIGINT AS burst_us FROM (SELECT DISTINCT g FROM s) q LEFT JOIN z ON q.g = z.g GROUP BY q.g)"""


def _period(lags: int) -> str:
    return f"""
d AS (SELECT g, us, row_number() OVER (PARTITION BY g ORDER BY ts, k) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, bytes - avg(bytes) OVER (PARTITION BY g) AS dev FROM s),
c AS (SELECT a.g, l.l AS lag, avg(a.dev * b.dev) AS correlation FROM d a JOIN (SELECT unnest(range(1, {lags} + 1)) AS l) l ON l.l < a.n // 2 JOIN d b ON a.g = b.g AND b.i = a.i + l.l WHERE a.n >= 4 GROUP BY 1, 2),
t AS (SELECT g, max(correlation) AS correlation, arg_max(lag, (correlation, -lag)) AS best_lag FROM c WHERE correlation > 0 GROUP BY g),
pe AS (SELECT q.g, coalesce(t.correlation > 0.7, false) AS is_periodic, coalesce(t.best_lag, 0) AS best_lag, coalesce(t.correlation, 0) AS correlation,
       CASE WHEN t.correlation > 0.7 AND t.best_lag < q.n - 1 THEN (SELECT us FROM d WHERE d.g = q.g AND d.i = t.best_lag) - (SELECT us FROM d WHERE d.g = q.g AND d.i = 0) ELSE 0 END AS period_us
       FROM (SELECT g, max(n) AS n FROM d GROUP BY g) q LEFT JOIN t ON q.g = t.g)"""


CALLS = "tid, enter_seq, exit_seq, enter_trace_id, exit_trace_id, ret"
GATED = f"""{EV},
{_pairs("(SELECT ev.* FROM ev LEFT JOIN nm ON ev.trace_id = nm.trace_id WHERE phase = 'exit' OR (kind = 'open' AND contains(comm, 'app1') AND {open}))", 'o_')},
kn AS (SELECT tid, min((exit_time_ns, exit_seq)) AS known FROM o_mt WHERE valid GROUP BY tid),
ge AS (SELECT ev.* FROM ev LEFT JOIN nm ON ev.trace_id = nm.trace_id LEFT JOIN kn ON ev.tid = kn.tid
       WHERE phase = 'exit' OR (kind = 'open' AND contains(comm, 'app1') AND {{open}}) OR (kind <> 'open' AND {{other}} AND (time_ns, seq) > known))"""
GATE_COMM = GATED.format(open="true", other="true")
GATE_BOTH = GATED.format(open="contains(path, '/k')", other="(kind NOT IN ('path', 'name') OR contains(coalesce(path, ''), '/k') OR contains(coalesce(oldname, ''), '/k') OR contains(coalesce(newname, ''), '/k'))")
# Files and comms are looked up over all calls that pair under the gate; the filter on calls comes last.
FILTERED = f"""{GATE_BOTH},
{_pairs('ge')},
{_files('vc')},
cm AS (SELECT vc.*, {COMM} AS comm FROM vc),
kp AS (SELECT cm.*, file_name, file_flags FROM cm JOIN fl ON cm.exit_seq = fl.exit_seq
       WHERE kind NOT IN ('fd', 'null', 'fcntl') OR (contains(comm, 'app1') AND kind <> 'null' AND contains(file_name, '/k')))
SELECT exit_seq, name, comm, file_name, file_flags, exit_time_ns - enter_time_ns AS duration, {GAP} AS gap FROM kp {GAP_W}"""

_KIND = {"openat": "open", "creat": "path", "newstat": "path", "rename": "name", "sync": "null", "msync": "null", "dup3": "dup3", "fcntl": "fcntl"}
_IO = {"read": "read", "write": "write", "copy_file_range": "transfer"}


def _hosts(path: str | None = None) -> str:
    """The trace of two hosts, its pairs and comms, and ``fl``: each process's calls folded one by one over a list of its open files.

    With ``path``, calls by descriptor whose file's name does not hold it are dropped before they change anything.
    """
    names = ", ".join(f"({i}, '{n}', '{_KIND.get(n, 'fd')}', '{_IO.get(n, 'none')}')" for n, i in HOSTS_IDS.items())
    source, held, exes = (q.replace("{TNS}", DUCKDB_TNS).replace("{LIT}", "VARCHAR") for q in (HOSTS_SQL, HELD_FDS_SQL, HELD_EXES_SQL))
    passes = "true" if path is None else f"(kind NOT IN ('path', 'name', 'open') OR contains(coalesce(path, ''), '{path}') OR contains(coalesce(oldname, ''), '{path}') OR contains(coalesce(newname, ''), '{path}'))"
    kept = "true" if path is None else f"(c.kind NOT IN ('fd', 'dup3', 'fcntl', 'null') OR (c.kind <> 'null' AND contains(coalesce(f2.held.name, s.name, ''), '{path}')))"
    w = "OVER (PARTITION BY host, tid ORDER BY time_ns, seq)"
    cols = ", ".join(f"lag({c}) {w} AS p_{c}" for c in ("phase", "seq", "time_ns", "trace_id", "pid", "fd", "flags", "path", "oldname", "newname", "comm", "cmd", "arg"))
    state = "STRUCT(fd BIGINT, name VARCHAR, flags BIGINT, snap BOOLEAN)"
    copied = "CASE WHEN c.name IN ('dup', 'dup2') OR (c.name = 'fcntl' AND c.cmd = 0) THEN 0 WHEN c.name = 'dup3' THEN c.flags & 524288 WHEN c.name = 'fcntl' AND c.cmd = 1030 THEN 524288 END"
    return f"""WITH RECURSIVE ev AS ({source}), nm AS (SELECT * FROM (VALUES {names}) v(trace_id, name, kind, io)), sn AS ({held}), ex AS ({exes}),
ge AS (SELECT ev.* FROM ev LEFT JOIN nm ON ev.trace_id = nm.trace_id WHERE phase = 'exit' OR {passes}),
lg AS (SELECT *, {cols} FROM ge),
vc AS (SELECT host, tid, p_pid AS pid, p_seq AS enter_seq, seq AS exit_seq, p_trace_id AS enter_trace_id, ret, p_time_ns AS enter_time_ns, time_ns AS exit_time_ns, p_fd AS fd, p_flags AS flags,
              p_path AS path, p_newname AS newname, p_comm AS comm0, p_cmd AS cmd, p_arg AS arg, nm.name, nm.kind, nm.io
       FROM lg JOIN nm ON nm.trace_id = p_trace_id WHERE phase = 'exit' AND p_phase = 'enter' AND p_trace_id - 1 = lg.trace_id),
cm AS (SELECT vc.*, row_number() OVER (PARTITION BY vc.host, pid ORDER BY exit_time_ns, exit_seq) AS n,
              CASE WHEN kind = 'open' THEN CASE WHEN ret >= 0 THEN comm0 ELSE '' END ELSE coalesce(last_value(CASE WHEN kind = 'open' THEN comm0 END IGNORE NULLS)
                OVER (PARTITION BY vc.host, vc.tid ORDER BY exit_time_ns, exit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), string_split(ex.exe, '/')[-1], '') END AS comm
       FROM vc LEFT JOIN ex ON vc.host = ex.host AND vc.tid = ex.tid),
fo AS (SELECT host, pid, 0::BIGINT AS n, NULL::BIGINT AS exit_seq, []::{state}[] AS files, NULL::{state} AS shown, NULL::BOOLEAN AS kept FROM (SELECT DISTINCT host, pid FROM cm)
       UNION ALL
       SELECT host, pid, n, exit_seq,
         CASE WHEN name IN ('openat', 'creat') AND ret >= 0 THEN list_append(list_filter(files, lambda x: x.fd <> ret), {{'fd': ret, 'name': path, 'flags': CASE WHEN name = 'creat' THEN 577 ELSE flags END, 'snap': false}})
              WHEN name = 'close' THEN list_filter(files, lambda x: x.fd <> fd)
              WHEN kept AND name = 'fcntl' AND cmd = 4 AND ret >= 0 THEN list_append(list_filter(files, lambda x: x.fd <> fd), shown)
              WHEN kept AND added IS NOT NULL AND ret >= 0 THEN list_append(list_filter(files, lambda x: x.fd <> ret), {{'fd': ret, 'name': shown.name, 'flags': shown.flags | added, 'snap': shown.snap}})
              ELSE files END, shown, kept
       FROM (SELECT f2.host, f2.pid, c.n, c.exit_seq, c.name, c.ret, c.cmd, c.fd, c.path, c.flags, f2.files, {copied} AS added, {kept} AS kept,
               CASE WHEN c.kind IN ('fd', 'dup3', 'fcntl') THEN {{'fd': c.fd::BIGINT, 'name': coalesce(f2.held.name, s.name, ''), 'flags': CASE WHEN c.name = 'fcntl' AND c.cmd = 4 AND c.ret >= 0 THEN c.arg & 289792
                 ELSE coalesce(f2.held.flags, CASE WHEN s.flags_octal IS NOT NULL THEN 32770 END, -1) END::BIGINT, 'snap': coalesce(f2.held.snap, true)}} END AS shown
             FROM (SELECT fo.host, fo.pid, fo.n, fo.files, list_filter(fo.files, lambda x: x.fd = c0.fd)[1] AS held FROM fo JOIN cm c0 ON c0.host = fo.host AND c0.pid = fo.pid AND c0.n = fo.n + 1) f2
             JOIN cm c ON c.host = f2.host AND c.pid = f2.pid AND c.n = f2.n + 1 LEFT JOIN sn s ON s.host = c.host AND s.pid = c.pid AND s.fd = c.fd)),
cf AS (SELECT cm.*, CASE WHEN kind = 'open' OR name = 'creat' THEN CASE WHEN ret >= 0 THEN path ELSE 'N:file' END WHEN kind = 'path' THEN path WHEN kind = 'name' THEN newname WHEN kind = 'null' THEN 'N:file'
                ELSE shown.name END AS file_name,
              (CASE WHEN kind = 'open' THEN CASE WHEN ret >= 0 THEN flags ELSE 0 END WHEN name = 'creat' THEN CASE WHEN ret >= 0 THEN 577 ELSE 0 END WHEN kind IN ('path', 'name') THEN -1 WHEN kind = 'null' THEN 0
                ELSE shown.flags END)::INTEGER AS file_flags, coalesce(shown.snap, false) AS from_snapshot
       FROM cm JOIN fo ON cm.host = fo.host AND cm.pid = fo.pid AND cm.n = fo.n WHERE fo.kept),
done AS (SELECT *, exit_time_ns - enter_time_ns AS duration, coalesce(enter_time_ns - lag(exit_time_ns) OVER (PARTITION BY host, tid ORDER BY exit_time_ns, exit_seq), 0) AS gap FROM cf)"""


HOSTS_ROWS = "SELECT host, pid, from_snapshot, exit_seq, name, comm, file_name, file_flags, duration, gap FROM done"
LINE = f"""printf('%08d,%08d,%s@%d.%d,%s=>%d,', gap, duration, comm, pid, tid, name, ret) || CASE WHEN file_name = 'N:file' THEN 'N:file' WHEN kind = 'path' THEN 'pathname:' || path || '%(O_NONE)'
    WHEN kind = 'name' THEN 'old:' || oldname || ' ->new:' || newname || '%(O_NONE)' ELSE CASE WHEN file_name = '' THEN 'E:name' ELSE file_name END || '%(' || CASE WHEN kind = 'open' THEN ret ELSE fd END || ',' ||
    {_flags('file_flags')} || ')' END"""

SQL: dict[str, str] = {
    "calls_hosts": f"{_hosts()} {HOSTS_ROWS}",
    "calls_hosts_split": f"{_hosts()} {HOSTS_ROWS}",
    "calls_filter_first": f"{_hosts('/k1')} {HOSTS_ROWS}",
    "filters_thread": f"{EV} SELECT seq, pid, tid FROM ev WHERE tid = 10071",
    "stats_map_events": _profile(SERIES, "event_type"),
    "saved_runs": f"""{_hosts()} SELECT trim(comm) || ';enter_' || name || ';' || tid AS stack, sum(CASE WHEN io <> 'none' AND ret > 0 THEN ret ELSE 0 END)::BIGINT AS value FROM done GROUP BY 1""",
    "collapsed_file": f"""{_hosts()}, st AS (SELECT array_to_string(string_split(file_name, '/'), ';/') || ';' || {_flags('file_flags')} AS stack, count(*) AS c FROM done GROUP BY 1) SELECT stack || ' ' || c AS line FROM st""",
    "rows_file": f"{FULL} SELECT {LINE} AS value FROM cf",
    "render_pairs_full": f"{FULL} SELECT exit_seq, {LINE} AS value FROM cf",
    "decode_present": f"{EV} SELECT seq, 'decoded' AS what FROM ev WHERE seq % 60 <> 0",
    "scalar_text": "SELECT c_custkey, c_custkey::INTEGER AS number, c_name AS last, c_mktsegment AS comm FROM customer",
    "periodicity_every_lag": f"""{SERIES},{_period(0).replace("range(1, 0 + 1)", "range(1, (SELECT max(n) FROM d) // 2)")} SELECT g AS event_type, is_periodic, best_lag, period_us::BIGINT AS period_us,
        CASE WHEN correlation > 0 THEN round(correlation * pow(10.0::DOUBLE, 5 - floor(log10(correlation)))) ELSE 0 END::BIGINT AS correlation FROM pe""",
    "pair_calls": f"{PAIRED} SELECT {CALLS}, name FROM vc",
    "pair_calls_split": f"{PAIRED} SELECT {CALLS}, name FROM vc",
    "calls_crowded": f"""{EV}, cr AS (SELECT * REPLACE ((CASE WHEN tid % 10 < 9 THEN 1 ELSE tid END)::BIGINT AS tid) FROM ev),
{_pairs('cr')} SELECT tid, exit_seq, name, {COMM} AS comm, exit_time_ns - enter_time_ns AS duration, {GAP} AS gap FROM vc {GAP_W}""",
    "pair_mismatches": f"{PAIRED} SELECT {CALLS} FROM mt WHERE NOT valid",
    "run_stats": f"""{PAIRED}, n AS (SELECT (SELECT count(*) FROM ev) AS tracepoints, (SELECT count(*) FROM mt) AS syscalls, (SELECT count(*) FROM mt WHERE NOT valid) AS mismatches,
        (SELECT count(*) FROM vc) AS syscalls_after_filter)
        SELECT *, 100.0::DOUBLE * mismatches / tracepoints AS mismatch_percent, tracepoints / 60.0::DOUBLE AS tracepoints_per_second, syscalls / 60.0::DOUBLE AS syscalls_per_second,
        syscalls_after_filter / 60.0::DOUBLE AS syscalls_after_filter_per_second FROM n""",
    "durations_gaps": f"{PAIRED} SELECT tid, exit_seq, exit_time_ns - enter_time_ns AS duration, {GAP} AS gap FROM vc {GAP_W}",
    "comm_asof": f"{PAIRED} SELECT tid, exit_seq, {COMM} AS comm FROM vc",
    "fd_asof_roots": f"{PAIRED}, rc AS (SELECT * FROM vc WHERE name NOT IN ('dup', 'fcntl')),\n{_files('rc')} SELECT exit_seq, file_name, file_flags FROM fl",
    "fd_asof_full": f"{PAIRED},\n{_files('vc')} SELECT exit_seq, file_name, file_flags, from_snapshot FROM fl",
    "calls_full": f"{FULL} SELECT exit_seq, name, comm, file_name, file_flags, duration, gap FROM cf",
    "calls_filtered": FILTERED,
    "filters_open": f"{EV} SELECT seq, comm, path FROM ev WHERE trace_id = 798 AND phase = 'enter' AND contains(comm, 'app1') AND contains(path, 'k3')",
    "filters_path": f"{EV} SELECT seq, path FROM ev WHERE trace_id = 874 AND phase = 'enter' AND contains(path, '/data/view')",
    "filters_name": f"{EV} SELECT seq, oldname, newname FROM ev WHERE trace_id = 884 AND phase = 'enter' AND (contains(oldname, '7.tmp') OR contains(newname, '7.tmp'))",
    "filters_process": f"{EV} SELECT seq, pid, tid FROM ev WHERE pid = 1007 AND time_ns >= 1704067200000000000 AND time_ns < 1704067200000000000 + 30 * 86400000000000",
    "comm_gate": f"{GATE_COMM} SELECT seq, tid FROM ge WHERE phase = 'enter'",
    "tracepoint_select": f"""{EV}, tp AS (SELECT trace_id, 'sys_enter_' || name AS t FROM nm UNION ALL SELECT trace_id - 1, 'sys_exit_' || name FROM nm)
        SELECT seq, ev.trace_id FROM ev JOIN tp ON ev.trace_id = tp.trace_id WHERE NOT regexp_matches(t, 'exit_open') AND (regexp_matches(t, 'read$') OR regexp_matches(t, 'open'))""",
    "is_call": f"{PAIRED} SELECT exit_seq, oldname, newname FROM vc WHERE name = 'rename'",
    "flags_path_text": f"""WITH e AS (SELECT event_id, (event_id * 7919 % 2097152)::INTEGER AS flags, '/data/' || event_type || '/x' AS path FROM events)
        SELECT event_id, {_flags('flags')} AS flags_text, array_to_string(string_split(path, '/'), ';/') AS stack FROM e""",
    "render_pairs": f"""{EV}, sub AS (SELECT * FROM ev WHERE trace_id IN (798, 797, 874, 873, 884, 883, 1040, 1039)),
        {_pairs('sub')}, cc AS (SELECT vc.*, {COMM} AS comm, exit_time_ns - enter_time_ns AS duration, {GAP} AS gap FROM vc {GAP_W})
        SELECT exit_seq, printf('%08d,%08d,%s@%d.%d,%s=>%d,', gap, duration, comm, pid, tid, name, ret) ||
          CASE WHEN kind = 'open' THEN CASE WHEN ret >= 0 THEN path || '%(' || ret || ',O_RDWR)' ELSE 'N:file' END WHEN kind = 'path' THEN 'pathname:' || path || '%(O_NONE)'
               WHEN kind = 'name' THEN 'old:' || oldname || ' ->new:' || newname || '%(O_NONE)' ELSE 'N:file' END AS value FROM cc""",
    "agg6": f"{AGG} SELECT path, trace_id, comm, pid, tid, flags, count, duration, duration_to_prev, 0::BIGINT AS bytes FROM ag",
    "agg6_bytes": f"{AGG} SELECT path, trace_id, comm, pid, tid, flags, count, duration, duration_to_prev, moved AS bytes FROM ag",
    "rollup_merge": f"{AGG} SELECT path, trace_id, comm, pid, tid, flags, count, duration, duration_to_prev, 0::BIGINT AS bytes FROM ag",
    "collapse_default": f"""{AGG} SELECT pid || ';' || array_to_string(string_split(path, '/'), ';/') || ';enter_' || name AS stack, sum(duration)::BIGINT AS value FROM ag JOIN nm ON ag.trace_id = nm.trace_id GROUP BY 1""",
    "collapse_comm_flags": f"""{AGG} SELECT comm || ';enter_' || name || ';' || {_flags('flags')} AS stack, sum(duration_to_prev)::BIGINT AS value FROM ag JOIN nm ON ag.trace_id = nm.trace_id GROUP BY 1""",
    "rollup_paths": f"""{AGG}, lv AS (SELECT string_split(path, '/') AS p, * FROM ag)
        SELECT p[2] AS level1, p[3] AS level2, p[4] AS level3, sum(count)::BIGINT AS count, sum(duration)::BIGINT AS duration, sum(duration_to_prev)::BIGINT AS duration_to_prev,
        grouping(p[2], p[3], p[4]) AS depth_mask FROM lv GROUP BY ROLLUP (p[2], p[3], p[4])""",
    "io_profile_events": _profile(SERIES, "event_type"),
    "io_profile_lineitem": _profile(LINES, "l_returnflag"),
    "time_series": f"{SERIES} SELECT g AS event_type, row_number() OVER (PARTITION BY g ORDER BY ts, k) AS place, ts, lat AS latency_ns, bytes FROM s",
    "bursts_events": f"{_bursts(SERIES, 5000)} SELECT g AS event_type, burst_count, burst_us FROM bu",
    "bursts_lineitem": f"{_bursts(LINES, 30000)} SELECT g AS l_returnflag, burst_count, burst_us FROM bu",
    "periodicity_events": f"{SERIES},{_period(24)} SELECT g AS event_type, is_periodic, best_lag, period_us::BIGINT AS period_us, round(correlation, 0) AS correlation FROM pe",
    "trend_orders": """WITH o AS (SELECT o_orderpriority, epoch_us(o_orderdate::TIMESTAMP) AS us, round(o_totalprice)::BIGINT AS y FROM orders),
        x AS (SELECT *, (us - min(us) OVER (PARTITION BY o_orderpriority)) / 1000000.0::DOUBLE AS x FROM o),
        r AS (SELECT o_orderpriority, regr_slope(y::DOUBLE, x) AS slope FROM x GROUP BY 1)
        SELECT o_orderpriority, round(slope, 9) AS slope, CASE WHEN abs(slope) < 0.1 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM r""",
    "patterns_events": f"""{_bursts(SERIES, 1000)},{_period(8)},
        tr AS (SELECT g, regr_slope(bytes::DOUBLE, (us - m) * 1000.0::DOUBLE) AS slope FROM (SELECT *, min(us) OVER (PARTITION BY g) AS m FROM s) GROUP BY g)
        SELECT bu.g AS event_type, burst_count, burst_us, is_periodic, best_lag, period_us::BIGINT AS period_us,
        CASE WHEN abs(slope) < 0.1 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM bu JOIN pe ON bu.g = pe.g JOIN tr ON bu.g = tr.g""",
    "decode_round_trip": f"""{EV} SELECT seq, CASE WHEN phase = 'exit' THEN 8 WHEN kind = 'open' THEN 1 WHEN kind = 'fd' THEN 3 WHEN kind = 'null' THEN 5 WHEN kind = 'name' THEN 9
        WHEN kind = 'path' THEN 11 ELSE 13 END AS event_type, phase, ev.trace_id, time_ns, pid, tid, coalesce(fd, 0)::BIGINT AS fd, coalesce(flags, 0)::BIGINT AS flags, coalesce(cmd, 0)::BIGINT AS cmd,
        coalesce(arg, 0)::BIGINT AS arg, coalesce(ret, 0)::BIGINT AS ret, coalesce(path, '') AS path, coalesce(oldname, '') AS oldname, coalesce(newname, '') AS newname, coalesce(comm, '') AS comm FROM ev LEFT JOIN nm ON ev.trace_id = nm.trace_id AND phase = 'enter'""",
    "quarantined": f"""{EV} SELECT seq, CASE WHEN seq % 50 = 0 THEN 7 WHEN phase = 'exit' THEN 8 WHEN kind = 'open' THEN 1 WHEN kind = 'fd' THEN 3 WHEN kind = 'null' THEN 5 WHEN kind = 'name' THEN 9
        WHEN kind = 'path' THEN 11 ELSE 13 END AS event_type, CASE WHEN seq % 50 = 0 THEN 'unknown type' ELSE 'too short' END AS reason
        FROM ev LEFT JOIN nm ON ev.trace_id = nm.trace_id AND phase = 'enter' WHERE seq % 50 = 0 OR seq % 70 = 0""",
    "transitions": f"""{PAIRED}, st AS (SELECT name, lag(name) OVER g AS previous, {GAP} AS gap FROM vc {GAP_W})
        SELECT previous || '->' || name AS transition, count(*) AS count, sum(gap)::BIGINT AS duration_to_prev FROM st WHERE previous IS NOT NULL GROUP BY 1""",
    "gaps_by_call": f"{PAIRED}, st AS (SELECT name, {GAP} AS gap FROM vc {GAP_W}) SELECT name, count(*) AS count, sum(gap)::BIGINT AS duration_to_prev, max(gap) AS longest_gap FROM st GROUP BY 1",
    "call_times": f"""{PAIRED}, st AS (SELECT name, pid, exit_time_ns - enter_time_ns AS duration, {GAP} AS gap FROM vc {GAP_W})
        SELECT name, pid, count(*) AS count, sum(duration)::BIGINT AS duration, sum(gap)::BIGINT AS duration_to_prev FROM st GROUP BY 1, 2""",
    "path_buckets": f"{FULL} SELECT CASE WHEN regexp_matches(file_name, '/k[0-4]') THEN 'PATHMATCH' ELSE 'OTHER' END AS bucket, count(*) AS count, sum(duration)::BIGINT AS duration FROM cf GROUP BY 1",
    "by_directory": f"""{AGG} SELECT CASE WHEN NOT contains(path, '/') THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS directory, sum(count)::BIGINT AS count, sum(duration)::BIGINT AS duration FROM ag GROUP BY 1""",
    "by_mount": f"""{AGG}, mo AS (SELECT *, string_split(path, '/')[3] AS t FROM ag)
        SELECT CASE WHEN path NOT LIKE '/%' THEN 'none' WHEN len(t) % 2 = 0 THEN '/data/' || t ELSE '/' END AS mount,
        CASE WHEN path NOT LIKE '/%' THEN 'none' WHEN len(t) % 2 = 0 THEN 'dev-' || t ELSE 'root' END AS device, sum(count)::BIGINT AS count, sum(duration)::BIGINT AS duration FROM mo GROUP BY 1, 2""",
    "by_user": f"""{AGG} SELECT coalesce(c_name, '?') AS "user", sum(count)::BIGINT AS count, sum(duration)::BIGINT AS duration FROM ag LEFT JOIN customer ON pid = c_custkey + 1000 GROUP BY 1""",
    "sketch_runs": f"""{SERIES}, n AS (SELECT g AS event_type, count(lat) AS latency, count(bytes) AS bytes FROM s GROUP BY g)
        SELECT event_type, what, q::DOUBLE AS q, CASE WHEN what = 'bytes' THEN bytes ELSE latency END AS count, true AS near
        FROM n, (VALUES ('latency'), ('bytes')) w(what), (VALUES (0.5), (0.95), (0.99)) p(q) WHERE CASE WHEN what = 'bytes' THEN bytes ELSE latency END > 0""",
    "dump_round_trip": f"""{EV} SELECT row_number() OVER (ORDER BY seq) - 1 AS place, CASE WHEN phase = 'exit' THEN 8 WHEN kind = 'open' THEN 1 WHEN kind = 'fd' THEN 3 WHEN kind = 'null' THEN 5
        WHEN kind = 'name' THEN 9 WHEN kind = 'path' THEN 11 ELSE 13 END AS event_type, phase, ev.trace_id, time_ns, pid, tid, coalesce(ret, 0)::BIGINT AS ret,
        coalesce(path, '') AS path, coalesce(oldname, '') AS oldname, coalesce(newname, '') AS newname, coalesce(comm, '') AS comm FROM ev LEFT JOIN nm ON ev.trace_id = nm.trace_id AND phase = 'enter'""",
    "stacks_user": f"""{FULL}, st AS (SELECT *, lag(name) OVER (PARTITION BY tid ORDER BY exit_time_ns, exit_seq) AS previous FROM cf)
        SELECT coalesce(c_name, '?') || ';' || trim(comm) || ';' || pid || ';' || tid || ';' || coalesce(previous, 'start') || '->' || name AS stack, sum(gap)::BIGINT AS value
        FROM st LEFT JOIN customer ON pid = c_custkey + 1000 GROUP BY 1""",
    "stacks_device": f"""{FULL}, mo AS (SELECT *, string_split(file_name, '/')[3] AS t, CASE WHEN io <> 'none' AND ret > 0 THEN ret ELSE 0 END AS moved FROM cf)
        SELECT CASE WHEN file_name NOT LIKE '/%' THEN 'none;none' WHEN len(t) % 2 = 0 THEN 'dev-' || t || ';/data/' || t ELSE 'root;/' END || ';' ||
        CASE WHEN NOT contains(file_name, '/') THEN '.' ELSE regexp_extract(file_name, '^(.*)/[^/]*$', 1) END || ';' ||
        CASE WHEN regexp_matches(file_name, '/k[0-4]') THEN 'PATHMATCH' ELSE 'OTHER' END || ';' || name AS stack, sum(moved)::BIGINT AS value FROM mo GROUP BY 1""",
    "flame_tree": f"""{AGG}, sk AS (SELECT trim(comm) || ';' || array_to_string(string_split(path, '/'), ';/') || ';enter_' || name AS stack, sum(duration)::BIGINT AS value
          FROM ag JOIN nm ON ag.trace_id = nm.trace_id GROUP BY 1),
        ex AS (SELECT value, string_split(stack, ';') AS f, unnest(range(1, len(string_split(stack, ';')) + 1)) AS depth FROM sk)
        SELECT array_to_string(f[1:depth], ';') AS node, CASE WHEN depth > 1 THEN array_to_string(f[1:depth - 1], ';') END AS parent, f[depth] AS frame, depth::INTEGER AS depth,
        sum(value)::BIGINT AS total, sum(CASE WHEN depth = len(f) THEN value ELSE 0 END)::BIGINT AS self FROM ex GROUP BY ALL""",
}
SQL["run_report"] = SQL["run_stats"]
