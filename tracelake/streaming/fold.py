"""The state of one process, event by event: the small pure function that the stream and the tests share."""

from __future__ import annotations

from dataclasses import dataclass, field

from tracelake.functions.text import CREAT_FLAGS, F_DUPFD, F_DUPFD_CLOEXEC, F_SETFL, O_CLOEXEC, SETTABLE
from tracelake.schema import UNKNOWN


def int32(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


@dataclass
class ProcessState:
    """Pending enters, names and last exits by thread, and open files by descriptor."""

    pending: dict[int, dict] = field(default_factory=dict)
    comms: dict[int, str] = field(default_factory=dict)
    files: dict[int, tuple[str, int, bool]] = field(default_factory=dict)
    last_exit: dict[int, int] = field(default_factory=dict)
    mismatches: int = 0
    mismatched: dict | None = None


def _file(kind: str, fd: int | None, name: str, flags: int, oldname: str | None = None, snap: bool = False) -> dict:
    return {"kind": kind, "fd": fd, "name": name, "oldname": oldname, "flags": flags, "from_snapshot": snap}


def step(s: ProcessState, e: dict, dim: dict[int, tuple[str, str]], comm: str = "", path: str = "", filter_first: bool = True) -> dict | None:
    """Take one event and return the call that it completes, if any. ``dim``: name and record kind by enter id.

    An enter may carry what the snapshots of the process table say of its thread and descriptor: ``exe_comm``, ``snap_name``,
    ``snap_flags``. A pair whose ids do not fit is left in ``s.mismatched``.
    """
    s.mismatched = None
    tid, name_kind = e["tid"], dim.get(e["trace_id"])
    if e["phase"] == "enter":
        kind = name_kind[1] if name_kind else None
        passes = {
            "open": comm in (e["comm"] or "") and path in (e["path"] or ""), "path": path in (e["path"] or ""),
            "name": path in (e["oldname"] or "") or path in (e["newname"] or ""),
        }
        if passes.get(kind, True) and (not comm or kind == "open" or tid in s.comms):
            s.pending[tid] = e
        return None
    enter = s.pending.pop(tid, None)
    if enter is None:
        return None
    if enter["trace_id"] - 1 != e["trace_id"]:
        s.mismatches, s.mismatched = s.mismatches + 1, enter
        return None
    if enter["trace_id"] not in dim:
        return None
    name, kind = dim[enter["trace_id"]]
    ret, fd, known = e["ret"], enter["fd"], s.comms.get(tid, enter.get("exe_comm") or "")
    new_fd, failed = (None, True) if ret is None else (int32(ret), ret < 0)
    file, held = None, None
    if kind == "open":
        known = enter["comm"] or ""
        s.comms[tid] = known
        if new_fd is not None and new_fd >= 0:
            flags = UNKNOWN if enter["flags"] is None else enter["flags"]
            s.files[new_fd], file = (enter["path"] or "", flags, False), _file("fd", new_fd, enter["path"] or "", flags)
        else:
            known = ""
    elif kind == "name":
        file = _file("name", None, enter["newname"] or "", UNKNOWN, enter["oldname"] or "")
    elif name == "creat":
        if new_fd is not None and new_fd >= 0:
            s.files[new_fd], file = (enter["path"] or "", CREAT_FLAGS, False), _file("fd", new_fd, enter["path"] or "", CREAT_FLAGS)
    elif kind == "path":
        file = _file("path", None, enter["path"] or "", UNKNOWN)
    elif kind in ("fd", "dup3", "fcntl"):
        flags = enter.get("snap_flags")
        held = s.files.get(fd, (enter.get("snap_name") or "", UNKNOWN if flags is None else flags, True))
        file = _file("fd", fd, held[0], held[1], snap=held[2])
        if name == "close":
            s.files.pop(fd, None)
    kept = kind not in ("fd", "dup3", "null", "fcntl") or (comm in known and (not path or (file is not None and path in file["name"])))
    if filter_first and not kept:
        return None
    if held is not None and not failed:
        if name in ("dup", "dup2"):
            s.files[new_fd] = held
        elif kind == "dup3":
            s.files[new_fd] = (held[0], held[1] | (enter["flags"] & O_CLOEXEC), held[2])
        elif kind == "fcntl" and enter["cmd"] == F_SETFL:
            flags = enter["arg"] & SETTABLE
            s.files[fd], file = (held[0], flags, held[2]), _file("fd", fd, held[0], flags, snap=held[2])
        elif kind == "fcntl" and enter["cmd"] in (F_DUPFD, F_DUPFD_CLOEXEC):
            s.files[new_fd] = (held[0], held[1] | (O_CLOEXEC if enter["cmd"] == F_DUPFD_CLOEXEC else 0), held[2])
    if not kept:
        return None
    before = s.last_exit.get(tid, 0)
    s.last_exit[tid] = e["time_ns"]
    return {
        "pid": enter["pid"], "tid": tid, "enter_seq": enter["seq"], "exit_seq": e["seq"], "enter_time_ns": enter["time_ns"], "exit_time_ns": e["time_ns"],
        "enter_trace_id": enter["trace_id"], "exit_trace_id": e["trace_id"], "name": name, "comm": known, "file": file, "ret": ret,
        "duration": e["time_ns"] - enter["time_ns"], "gap": enter["time_ns"] - before if before else 0,
    }
