"""The table of open files, batch form: which file a descriptor stood for when a call completed.

Calls that change the table give versions of a descriptor, ordered by their exits: an open gives a file, a close none, and
a duplicate or F_SETFL refers to the version of another descriptor (or the same) before it. A use reads the last version
before its own exit. One look back over versions and uses together, both with what they carry, answers all of them: a
root tells its file at once, and only calls that meet a duplicate join the table of resolved duplicates. References are
followed by pointer doubling, so a chain of n duplicates takes log2(n) rounds. Descriptors without a version are looked up
in the snapshot of the process table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import CREAT_FLAGS, F_DUPFD, F_DUPFD_CLOEXEC, F_SETFL, O_CLOEXEC, SETTABLE
from tracelake.operators import passing
from tracelake.operators.ordered import Rows, look_back, look_backs
from tracelake.schema import UNKNOWN, file_struct
from tracelake.scratch import cut, drop

NO_FDS = "pid bigint, fd int, name string, flags int"
ORDER = ("exit_time_ns", "exit_seq", "mark")
#: Calls that work on no descriptor pass through the look back under this many keys of their own.
SPREAD = 4_096


def _failed(strict_minus_one: bool) -> Column:
    ret = F.col("ret")
    return F.coalesce(ret == -1 if strict_minus_one else ret < 0, F.lit(True))


def _int32(x: Column) -> Column:
    low = x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Whether the pairs of columns are equal, nulls as well."""
    out = F.lit(True)
    for x, y in pairs:
        out = out & a[x].eqNullSafe(b[y])
    return out


class _Changes:
    """What a call does to the table, as columns of the call."""

    def __init__(self, strict_minus_one: bool, keep_access_mode: bool):
        c, name, kind, ok = F.col, F.col("name"), F.col("record_kind"), ~_failed(strict_minus_one)
        self.new_fd = _int32(c("ret"))
        self.opened = (kind == "open") & c("ret").isNotNull() & (self.new_fd >= 0)
        self.created = (name == "creat") & c("ret").isNotNull() & (self.new_fd >= 0)
        dup, dup3, fcntl = name.isin("dup", "dup2") & ok, (kind == "dup3") & ok, (kind == "fcntl") & ok
        self.setfl = F.coalesce(fcntl & (c("cmd") == F_SETFL), F.lit(False))
        cloexec = fcntl & (c("cmd") == F_DUPFD_CLOEXEC)
        self.copied = F.coalesce(dup | dup3 | (fcntl & (c("cmd") == F_DUPFD)) | cloexec, F.lit(False))
        self.link = self.copied | self.setfl
        self.closed = name == "close"
        self.kind = F.when(self.opened | self.created, F.lit("root")).when(self.closed, F.lit("closed")).when(self.link, F.lit("link"))
        self.fd = F.when(self.closed | self.setfl, c("fd")).otherwise(self.new_fd).cast("int")
        self.file_name = F.when(self.kind == "root", F.coalesce("path", F.lit("")))
        self.file_flags = F.when(self.opened, F.coalesce("flags", F.lit(UNKNOWN))).when(self.created, F.lit(CREAT_FLAGS)).cast("int")
        # With the access mode kept, the mask of what stays is the complement of what can be set.
        self.and_mask = F.when(self.setfl, F.lit(~SETTABLE & 0x7FFFFFFF if keep_access_mode else 0)).otherwise(F.lit(-1)).cast("int")
        settable = c("arg").bitwiseAND(F.lit(SETTABLE)).cast("int")
        self.or_mask = F.when(self.setfl, settable).when(dup3, c("flags").bitwiseAND(F.lit(O_CLOEXEC))).when(cloexec, F.lit(O_CLOEXEC)).otherwise(F.lit(0)).cast("int")
        self.on_fd = kind.isin("fd", "dup3", "fcntl")
        self.version = F.when(self.kind.isNotNull(), F.struct(c("exit_seq").alias("vid"), self.kind.alias("kind"), self.file_name.alias("file_name"), self.file_flags.alias("file_flags")))


def _scope(scope: str) -> Column:
    return F.col("pid") if scope == "pid" else F.lit(0).cast("bigint")


def versions(calls: DataFrame, scope: str = "pid", strict_minus_one: bool = False, keep_access_mode: bool = False, run: Sequence[str] = ()) -> DataFrame:
    """The history of descriptors: one row for each call that changes one.

    ``vid`` (the exit's number), ``scope``, ``pid``, ``fd``, the order, ``kind`` (root, closed, link), for roots ``file_name`` and
    ``file_flags``, for links ``src_fd`` and the masks that make its flags: flags & ``and_mask`` | ``or_mask``.
    """
    x = _Changes(strict_minus_one, keep_access_mode)
    return calls.where(x.kind.isNotNull()).select(
        *run, F.col("exit_seq").alias("vid"), _scope(scope).alias("scope"), "pid", x.fd.alias("fd"), "exit_time_ns", "exit_seq", x.kind.alias("kind"), x.file_name.alias("file_name"),
        x.file_flags.alias("file_flags"), F.when(x.link, F.col("fd")).cast("int").alias("src_fd"), x.and_mask.alias("and_mask"), x.or_mask.alias("or_mask"),
    )


def _sources(states: DataFrame, run: Sequence[str], split_ns: int | Rows | None) -> DataFrame:
    """The links of ``states`` and ``found``, the version that each refers to."""
    fields = ("pid", "src_fd", "and_mask", "or_mask")
    version = F.struct("vid", "kind", "file_name", "file_flags")
    own = F.struct("vid", *fields)
    marks = states.select(*run, "scope", "fd", "exit_time_ns", "exit_seq", version.alias("v"), F.lit(1).alias("mark"), F.lit(None).cast(states.select(own.alias("x")).schema["x"].dataType).alias("link"))
    asks = states.where("kind = 'link'").select(
        *run, "scope", F.col("src_fd").alias("fd"), "exit_time_ns", "exit_seq", F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.lit(0).alias("mark"), own.alias("link")
    )
    seen = look_back(marks.unionByName(asks), [*run, "scope", "fd"], F.col("v"), "found", order=ORDER, split_ns=split_ns)
    return seen.where("link is not null").select(*run, "link.*", "found")


def _snapshot(proc_fd: DataFrame | None, rows: DataFrame, run: Sequence[str], pid: str, fd: str, wanted: Column) -> DataFrame:
    """``rows`` with ``snap_name`` and ``snap_flags`` of the descriptors that are ``wanted``."""
    if proc_fd is None:
        return rows.withColumn("snap_name", F.lit(None).cast("string")).withColumn("snap_flags", F.lit(None).cast("int"))
    both = [k for k in run if k in proc_fd.columns]
    held = proc_fd.select(*[F.col(k).alias(f"snap_{k}") for k in both], F.col("pid").alias("snap_pid"), F.col("fd").alias("snap_fd"), F.col("name").alias("snap_name"), F.col("flags").alias("snap_flags"))
    on = wanted & (F.col(pid) == F.col("snap_pid")) & (F.col(fd) == F.col("snap_fd"))
    for k in both:
        on = on & (rows[k] == held[f"snap_{k}"])
    return rows.join(held, on, "left").drop("snap_pid", "snap_fd", *[f"snap_{k}" for k in both])


def _follow(links: DataFrame, proc_fd: DataFrame | None, run: Sequence[str], rounds: int = 64) -> DataFrame:
    """``vid``, ``file_name``, ``file_flags``, ``from_snapshot`` of links (``pid``, ``src_fd``, masks, ``found``), by pointer doubling.

    A link becomes its source's version under two masks. Each round joins every link that is open to the link that it
    points at and composes their masks, until all rest on a root or on the snapshot.
    """
    ended = ~F.coalesce(F.col("found.kind") == "link", F.lit(False))
    lost = ended & (F.col("found").isNull() | (F.col("found.kind") == "closed"))
    named = _snapshot(proc_fd, links.withColumn("lost", lost), run, "pid", "src_fd", F.col("lost"))
    masks = ("and_mask", "or_mask")
    base = ("base_name", "base_flags", "snap")
    work = named.select(
        *run, "vid", *masks, F.when(~ended, F.col("found.vid")).alias("to"),
        F.when(F.col("lost"), F.coalesce("snap_name", F.lit(""))).otherwise(F.col("found.file_name")).alias("base_name"),
        F.when(F.col("lost"), F.coalesce("snap_flags", F.lit(UNKNOWN))).otherwise(F.col("found.file_flags")).alias("base_flags"), F.col("lost").alias("snap"),
    )
    work = cut(work)
    for _ in range(rounds):
        if work.where("to is not null").isEmpty():
            break
        up = work.select(*[F.col(k).alias(f"up_{k}") for k in run], F.col("vid").alias("up_vid"), *[F.col(c).alias(f"up_{c}") for c in (*masks, "to", *base)])
        pending = work.where("to is not null")
        met = pending.join(up, (F.col("to") == F.col("up_vid")) & same(pending, up, [(k, f"up_{k}") for k in run]))
        moved = met.select(
            *run, "vid", F.col("up_and_mask").bitwiseAND(F.col("and_mask")).alias("and_mask"),
            F.col("up_or_mask").bitwiseAND(F.col("and_mask")).bitwiseOR(F.col("or_mask")).alias("or_mask"),
            F.col("up_to").alias("to"), *[F.col(f"up_{c}").alias(c) for c in base],
        )
        done = cut(work.where("to is null").unionByName(moved))
        drop(work)
        work = done
    else:
        raise RuntimeError("references between descriptors did not end")
    return work.select(
        *run, "vid", F.coalesce("base_name", F.lit("")).alias("file_name"), F.col("base_flags").bitwiseAND(F.col("and_mask")).bitwiseOR(F.col("or_mask")).cast("int").alias("file_flags"),
        F.col("snap").alias("from_snapshot"),
    )


def resolve(states: DataFrame, proc_fd: DataFrame | None, split_ns: int | Rows | None = None, run: Sequence[str] = ()) -> DataFrame:
    """``vid``, ``file_name``, ``file_flags`` and ``from_snapshot`` of every version of ``versions`` that is a file."""
    linked = _follow(_sources(states, run, split_ns), proc_fd, run)
    return linked.unionByName(states.where("kind = 'root'").select(*run, "vid", "file_name", "file_flags", F.lit(False).alias("from_snapshot")))


def _dropped(calls: DataFrame, proc_fd: DataFrame | None, scope: str, x: tuple[bool, bool], comm: str | None, path: str | None, run: Sequence[str]) -> DataFrame:
    """``vid`` of the duplicates and F_SETFLs that change nothing, as their calls are filtered out before the table sees them.

    A link passes if its program's name and its source's file do; a failing name is known beforehand, and such links are no part of the table.
    """
    named = F.coalesce(F.col("comm").contains(comm), F.lit(False)) if comm else F.lit(True)
    link = _Changes(*x).link
    out = calls.where(link & ~named).select(*run, F.col("exit_seq").alias("vid"))
    if path:
        states = versions(calls.where(named | ~link), scope, *x, run=run)
        states = _snapshot(proc_fd, states, run, "pid", "src_fd", F.col("kind") == "link")
        own = F.when(F.col("file_name").contains(path), passing.YES).otherwise(passing.NO)
        what = F.when(F.col("kind") == "link", passing.LINK).when(F.col("kind") == "closed", passing.LOST).otherwise(own)
        snap = F.coalesce("snap_name", F.lit("")).contains(path)
        out = out.unionByName(passing.failing(states.select(*run, "scope", "vid", "exit_time_ns", "exit_seq", "fd", F.col("src_fd").alias("src"), what.alias("what"), snap.alias("snap")), run))
    return cut(out)


def attach_files(
    calls: DataFrame, proc_fd: DataFrame | None = None, scope: str = "pid", strict_minus_one: bool = False, keep_access_mode: bool = False, split_ns: int | Rows | None = None, run: Sequence[str] = (),
    first: tuple[str | None, str | None] | None = None,
) -> DataFrame:
    """``calls`` and ``file``: what the call worked on, or null.

    Opens and creat have the file they opened, none if they failed; calls by path or by two names have those names; calls by
    descriptor have its file as it stood before, but a successful F_SETFL shows the flags it set. Close shows the file it
    closes. Descriptors are counted per process; ``scope='fd'`` counts them over all processes together. ``run``: columns
    that tell hosts or runs apart, in ``calls`` and, where it has them, in ``proc_fd``. ``first``, filters on comm and
    path: duplicates and F_SETFLs that do not pass them leave the table as it is.
    """
    c, x = F.col, _Changes(strict_minus_one, keep_access_mode)
    if first is not None and any(first):
        calls = cut(calls)
        gone = _dropped(calls, proc_fd, scope, (strict_minus_one, keep_access_mode), *first, run).select(*[c(k).alias(f"gone_{k}") for k in run], c("vid").alias("gone_vid"))
        calls = calls.join(gone, same(calls, gone, [("exit_seq", "gone_vid"), *((k, f"gone_{k}") for k in run)]), "left").drop(*[f"gone_{k}" for k in run])
        version = F.when(c("gone_vid").isNull(), x.version)
    else:
        calls, version = calls.withColumn("gone_vid", F.lit(None).cast("bigint")), x.version
    names = [n for n in calls.columns if n not in ("gone_vid", "file")]
    what = {"__link": x.link, "__setfl": x.setfl, "__on_fd": x.on_fd, "__and": x.and_mask, "__or": x.or_mask, "__root": x.opened | x.created, "__new": x.new_fd, "__own": x.file_flags}
    # One row a call; duplicates have another under the descriptor that they make. Closes and F_SETFLs are version and use at once.
    own_fd = F.when(x.on_fd, c("fd")).when(x.kind == "root", x.new_fd).otherwise((-1 - F.pmod("exit_seq", F.lit(SPREAD))).cast("int"))
    # Marks alone are multiplied, between two steps: arrays of whole calls, in one, make a method too long (over 8,000 bytes) for the JVM to compile.
    rows = calls.withColumns(what | {"__at": own_fd.cast("int"), "__copied": x.copied, "__v": version})
    rows = rows.withColumn("mark", F.explode(F.when(c("__copied"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    here = c("mark") == 0
    rows = rows.select(
        *run, _scope(scope).alias("scope"), "exit_time_ns", "exit_seq", F.when(here, c("__at")).otherwise(c("__new")).alias("at"), "mark",
        F.when(~here | ~c("__copied"), c("__v")).alias("v"), F.when(here, F.struct(*names, *what)).alias("call"),
    )
    seen = look_back(rows, [*run, "scope", "at"], c("v"), "found", order=ORDER, split_ns=split_ns, keep=c("call").isNotNull(), asks=c("call.__on_fd") | c("call.__link")).select("call", "found")
    # Read three times. Spans of time have written it, but for what is carried to few rows.
    seen = seen if isinstance(split_ns, int) else cut(seen)

    links = seen.where("call.__link").select(*[c(f"call.{k}").alias(k) for k in run], c("call.exit_seq").alias("vid"), c("call.pid").alias("pid"), c("call.fd").alias("src_fd"), c("call.__and").alias("and_mask"), c("call.__or").alias("or_mask"), "found")
    files = _follow(links, proc_fd, run).select(*[c(k).alias(f"at_{k}") for k in run], c("vid").alias("at_vid"), c("file_name").alias("name"), c("file_flags").alias("flags"), c("from_snapshot").alias("snap"))
    on_link = F.coalesce(c("call.__on_fd") & (c("found.kind") == "link"), F.lit(False))
    met = seen.where(on_link).withColumns({f"of_{k}": c(f"call.{k}") for k in run})
    met = met.join(files, (c("found.vid") == c("at_vid")) & same(met, files, [(f"of_{k}", f"at_{k}") for k in run])).select("call", "name", "flags", "snap")
    plain = seen.where(~on_link).withColumn("lost", c("call.__on_fd") & (c("found").isNull() | (c("found.kind") == "closed")))
    plain = plain.withColumns({k: c(f"call.{k}") for k in run} | {"__pid": c("call.pid"), "__fd": c("call.fd")})
    plain = _snapshot(proc_fd, plain, run, "__pid", "__fd", c("lost"))
    plain = plain.select(
        "call", F.when(c("lost"), F.coalesce("snap_name", F.lit(""))).otherwise(c("found.file_name")).alias("name"),
        F.when(c("lost"), F.coalesce("snap_flags", F.lit(UNKNOWN))).otherwise(c("found.file_flags")).alias("flags"), c("lost").alias("snap"),
    )
    j = met.unionByName(plain).select("call.*", c("name").alias("__name"), c("flags").alias("__flags"), c("snap").alias("__snap"))
    opens = (c("record_kind") == "open") | (c("name") == "creat")
    null = F.lit(None)
    flags = F.when(c("__setfl"), c("__flags").bitwiseAND(c("__and")).bitwiseOR(c("__or"))).otherwise(c("__flags"))
    file = (
        F.when(c("__root"), file_struct(F.lit("fd"), c("__new"), F.coalesce("path", F.lit("")), null, c("__own"), F.lit(False)))
        .when(opens, null)
        .when(c("record_kind") == "path", file_struct(F.lit("path"), null, F.coalesce("path", F.lit("")), null, F.lit(UNKNOWN), F.lit(False)))
        .when(c("record_kind") == "name", file_struct(F.lit("name"), null, F.coalesce("newname", F.lit("")), F.coalesce("oldname", F.lit("")), F.lit(UNKNOWN), F.lit(False)))
        .when(c("__on_fd"), file_struct(F.lit("fd"), c("fd"), c("__name"), null, flags, c("__snap")))
    )
    return j.select(*names, file.alias("file"))


def attach_comm(calls: DataFrame, proc_exe: DataFrame | None = None, split_ns: int | Rows | None = None, run: Sequence[str] = (), also: Mapping[str, Column | str] = {}) -> DataFrame:
    """``calls`` with ``comm``: the program name of the thread.

    A successful open has its own; a failed one has none but still tells the later calls of its thread. Other calls have that
    of the last completed open, else the snapshot's, else none. ``also``: more values, by name, to be found by the same look back.
    """
    opens = F.col("record_kind") == "open"
    told = calls.withColumn("__own", F.when(opens, F.coalesce("comm", F.lit(""))))
    j = look_backs(told, [*run, "tid"], {"__known": F.col("__own"), **also}, order=("exit_time_ns", "exit_seq"), split_ns=split_ns)
    if proc_exe is not None:
        both = [k for k in run if k in proc_exe.columns]
        exe = proc_exe.select(*[F.col(k).alias(f"exe_{k}") for k in both], F.col("tid").alias("exe_tid"), "exe_comm")
        on = j["tid"] == exe["exe_tid"]
        for k in both:
            on = on & (j[k] == exe[f"exe_{k}"])
        j = j.join(exe, on, "left").drop("exe_tid", *[f"exe_{k}" for k in both])
    else:
        j = j.withColumn("exe_comm", F.lit(None).cast("string"))
    ok = F.coalesce(_int32(F.col("ret")) >= 0, F.lit(False))
    comm = F.when(opens, F.when(ok, F.col("__own")).otherwise("")).otherwise(F.coalesce("__known", "exe_comm", F.lit("")))
    return j.withColumn("comm", comm).drop("__own", "__known", "exe_comm")
