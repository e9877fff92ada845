"""Scalar functions over flags, paths and names, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.schema import UNKNOWN

#: Open flags of amd64 in the order in which they are printed.
OPEN_FLAGS = {
    "O_WRONLY": 0x1, "O_RDWR": 0x2, "O_ACCMODE": 0x3, "O_APPEND": 0x400, "O_ASYNC": 0x2000, "O_CLOEXEC": 0x80000, "O_CREAT": 0x40,
    "O_DIRECT": 0x4000, "O_DIRECTORY": 0x10000, "O_DSYNC": 0x1000, "O_EXCL": 0x80, "O_NOATIME": 0x40000, "O_NOCTTY": 0x100,
    "O_NOFOLLOW": 0x20000, "O_NONBLOCK": 0x800, "O_SYNC": 0x101000, "O_TRUNC": 0x200,
}
O_CLOEXEC = OPEN_FLAGS["O_CLOEXEC"]
CREAT_FLAGS = OPEN_FLAGS["O_CREAT"] | OPEN_FLAGS["O_WRONLY"] | OPEN_FLAGS["O_TRUNC"]
#: What F_SETFL can change.
SETTABLE = sum(OPEN_FLAGS[n] for n in ("O_APPEND", "O_ASYNC", "O_DIRECT", "O_NOATIME", "O_NONBLOCK"))
F_DUPFD, F_SETFL, F_DUPFD_CLOEXEC = 0, 4, 1030


def has_flags(flags: Column, mask: int) -> Column:
    """Whether all bits are set; never for unknown flags."""
    return (flags != UNKNOWN) & (flags.bitwiseAND(F.lit(mask)) == mask)


def flags_text(flags: Column) -> Column:
    """The names of the flags, joined by bars; reading only is named where neither write bit is set."""
    writes = flags.bitwiseAND(F.lit(OPEN_FLAGS["O_ACCMODE"])) != 0
    names = [F.when(~writes, F.lit("O_RDONLY"))] + [F.when(has_flags(flags, mask), F.lit(name)) for name, mask in OPEN_FLAGS.items()]
    return F.when(flags == UNKNOWN, F.lit("O_NONE")).otherwise(F.array_join(F.filter(F.array(*names), lambda n: n.isNotNull()), "|"))


def nul_text(raw: Column) -> Column:
    """The text before the first NUL; all of it where there is none."""
    return F.substring_index(raw.cast("string"), "\0", 1)


def path_stack(path: Column) -> Column:
    """The directories of a path as frames: /a/b becomes ;/a;/b."""
    return F.array_join(F.split(path, "/", -1), ";/")


def trim_comm(comm: Column) -> Column:
    return F.regexp_replace(comm, r"(?U)^\s+|\s+$", "")


def octal(text: Column) -> Column:
    """A number in octal digits as an int of 32 bits."""
    wide = F.conv(text, 8, 10).cast("bigint")
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
