"""Small traces for the tests: a builder of events, and random ones."""

import random

from tracelake.schema import EVENTS

IDS = {"openat": 798, "read": 858, "write": 856, "dup": 932, "close": 792, "newstat": 874, "rename": 884, "sync": 1040, "fcntl": 912, "dup2": 930, "dup3": 928, "creat": 796, "fsync": 1030, "mkdir": 880}
KINDS = {"openat": "open", "newstat": "path", "mkdir": "path", "creat": "path", "rename": "name", "sync": "null", "fcntl": "fcntl", "dup3": "dup3"}
COLUMNS = [c.split(" ")[0] for c in EVENTS.split(", ")]
TYPES = {"open": 1, "fd": 3, "null": 5, "name": 9, "path": 11, "fcntl": 13, "dup3": 15}


class Trace:
    def __init__(self, pid=10, tid=11, time=1_234_567):
        self.rows, self.pid, self.tid, self.time = [], pid, tid, time

    def add(self, phase, call, dt=0, **fields):
        row = dict.fromkeys(COLUMNS)
        kind = KINDS.get(call, "fd")
        own = {"seq": len(self.rows) + 1, "phase": phase, "event_type": TYPES[kind] if phase == "enter" else 8, "trace_id": IDS[call] - (phase == "exit"), "time_ns": self.time + dt, "pid": self.pid, "tid": self.tid}
        self.time += dt
        self.rows.append(row | own | fields)
        return self

    def call(self, call, ret=0, dt=100, pid=None, tid=None, **fields):
        who = {k: v for k, v in (("pid", pid), ("tid", tid)) if v is not None}
        self.add("enter", call, dt, **who, **fields)
        return self.add("exit", call, dt, ret=ret, **who)

    def open(self, ret=42, path="testfile.txt", comm="testcomm", flags=2, **who):
        return self.call("openat", ret, path=path, comm=comm, flags=flags, **who)

    def frame(self, spark):
        return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in self.rows], EVENTS)


def random_trace(seed, n=120):
    r, t = random.Random(seed), Trace()
    for _ in range(n):
        who = {"pid": (p := r.choice((10, 20))), "tid": p * 10 + r.randint(0, 1)}
        call = r.choice(["openat", "openat", "read", "write", "dup", "dup2", "dup3", "fcntl", "fcntl", "close", "newstat", "rename", "sync", "creat"])
        fd = r.randint(3, 7)
        fields = {"fd": fd} if KINDS.get(call, "fd") in ("fd", "fcntl", "dup3") else {}
        if call == "openat":
            fields |= {"path": r.choice(("/a/x", "/b/y", "/a/z")), "comm": r.choice(("app1", "app2")), "flags": r.choice((0, 1, 2, 0x80002))}
        if call in ("newstat", "creat"):
            fields |= {"path": r.choice(("/a/p", "/c/q"))}
        if call == "rename":
            fields |= {"oldname": "/a/o", "newname": r.choice(("/a/n", "/d/n"))}
        if call == "fcntl":
            fields |= {"cmd": r.choice((0, 1030, 4, 3)), "arg": r.choice((0x400, 0x800, 0x4C01))}
        if call == "dup3":
            fields |= {"flags": r.choice((0, 0x80000))}
        makes = call in ("openat", "creat", "dup", "dup2", "dup3") or (call == "fcntl" and fields["cmd"] in (0, 1030))
        ret = r.choice((-2, r.randint(3, 7), r.randint(3, 7), r.randint(3, 7))) if makes else r.choice((-1, 0, 5))
        kind = r.random()
        if kind < 0.1:
            t.add("enter", call, 10, **who, **fields)
        elif kind < 0.2:
            t.add("exit", call, 10, ret=ret, **who)
        else:
            t.call(call, ret, r.randint(0, 20), **who, **fields)
    return t
