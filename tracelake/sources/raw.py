"""Raw tracepoint payloads: little-endian records of fixed layout, told apart by their first number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import nul_text
from tracelake.schema import EVENTS

#: Record kind by event type, and the places of its fields (name: type, offset, size).
KIND_OF_TYPE = {1: "open", 2: "ret", 3: "fd", 4: "fd", 5: "null", 6: "null", 8: "ret", 9: "name", 11: "path", 13: "fcntl", 15: "dup3"}
LAYOUT = {
    "open": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4), "flags": ("s32", 24, 4), "path": ("text", 28, 256), "comm": ("text", 284, 16)},
    "null": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4)},
    "fd": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4), "fd": ("s32", 24, 4)},
    "ret": {"ret": ("s64", 16, 8), "pid": ("u32", 24, 4), "tid": ("u32", 28, 4), "ret_type": ("u32", 32, 4)},
    "name": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4), "oldname": ("text", 24, 256), "newname": ("text", 280, 256)},
    "path": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4), "path": ("text", 24, 256)},
    "fcntl": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4), "fd": ("s32", 24, 4), "cmd": ("u32", 28, 4), "arg": ("s64", 32, 8)},
    "dup3": {"pid": ("u32", 16, 4), "tid": ("u32", 20, 4), "fd": ("s32", 24, 4), "flags": ("s32", 28, 4)},
}


def _hex(payload: Column, offset: int, size: int) -> Column:
    """The bytes of a little-endian number as hex digits, most significant first."""
    h = F.hex(F.substring(payload, offset + 1, size))
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def _field(payload: Column, kind: str, offset: int, size: int) -> Column:
    if kind == "text":
        return nul_text(F.substring(payload, offset + 1, size))
    if kind == "s64":
        return F.conv(_hex(payload, offset, size), 16, -10).cast("bigint")
    wide = F.conv(_hex(payload, offset, size), 16, 10).cast("bigint")
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide) if kind == "s32" else wide


def present(raw: DataFrame) -> DataFrame:
    """Without empty records."""
    return raw.where(F.length("payload") > 0)


def _least(kind: str) -> int:
    return max(offset + size for _, offset, size in LAYOUT[kind].values())


def _typed(raw: DataFrame) -> DataFrame:
    # The type is a 32-bit number, but only its first byte is looked at.
    tag = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int")
    known = F.create_map(*[F.lit(x) for t, k in KIND_OF_TYPE.items() for x in (t, _least(k))])
    return present(raw).withColumn("event_type", tag).withColumn("__ok", F.coalesce(F.length("payload") >= known[F.col("event_type")], F.lit(False)))


def decode_events(raw: DataFrame) -> DataFrame:
    """``raw`` (seq, payload) as typed events; empty, unknown and cut-off records are left out (see ``quarantine``)."""
    p = F.col("payload")
    t = _typed(raw).where("__ok")
    columns = {"seq": F.col("seq"), "event_type": F.col("event_type"), "trace_id": _field(p, "u32", 4, 4), "time_ns": _field(p, "s64", 8, 8)}
    columns["phase"] = F.when(F.col("event_type") % 2 == 1, F.lit("enter")).otherwise(F.lit("exit"))
    for f in EVENTS.split(", "):
        name = f.split(" ")[0]
        places: dict[tuple, list[int]] = {}  # kinds that have the field at one place share an expression
        for t_, kind in KIND_OF_TYPE.items():
            if name in LAYOUT[kind]:
                places.setdefault(LAYOUT[kind][name], []).append(t_)
        values = [F.when(F.col("event_type").isin(types), _field(p, *place)) for place, types in places.items()]
        if values:
            columns[name] = F.coalesce(*values)
    return t.select(*[columns[f.split(" ")[0]].cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in EVENTS.split(", ")])


def quarantine(raw: DataFrame) -> DataFrame:
    """The records that no layout fits, with the reason."""
    known = F.col("event_type").isin(list(KIND_OF_TYPE))
    return _typed(raw).where("not __ok").withColumn("reason", F.when(known, F.lit("too short")).otherwise(F.lit("unknown type"))).drop("__ok")


def _number(value: Column, size: int) -> Column:
    """The bytes of a whole number, least significant first; null counts as 0."""
    v = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
    digits = F.lpad(F.hex(v if size == 8 else v.bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def _text(value: Column, size: int) -> Column:
    """The first ``size`` bytes of a text, filled up with zeros; null counts as no text."""
    return F.rpad(F.substring(F.encode(F.coalesce(value, F.lit("")), "utf-8"), 1, size), size, F.unhex(F.lit("00")))


def encode_events(events: DataFrame) -> DataFrame:
    """Typed events as raw records, laid out as ``LAYOUT`` says: the source of a replay. Nulls become 0 or no text."""
    c = F.col
    head = [_number(c("event_type"), 4), _number(c("trace_id"), 4), _number(c("time_ns"), 8)]
    payload = None
    for kind, layout in LAYOUT.items():
        types = [t for t, k in KIND_OF_TYPE.items() if k == kind]
        fields = [_text(c(n), size) if how == "text" else _number(c(n), size) for n, (how, offset, size) in sorted(layout.items(), key=lambda f: f[1][1])]
        made = F.concat(*head, *fields)
        payload = F.when(c("event_type").isin(types), made) if payload is None else payload.when(c("event_type").isin(types), made)
    return events.select("seq", payload.alias("payload"))
