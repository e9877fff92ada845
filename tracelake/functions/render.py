"""Files and completed calls as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import flags_text

HEADER = "durationToPrevNs,durationNs,comm@pid.tid,name=>ret,file"
NO_FILE = "N:file"


def file_name(file: Column) -> Column:
    """The name of a call's file: of a renamed one the new name."""
    return F.coalesce(F.when(file.isNotNull(), F.coalesce(file["name"], F.lit(""))), F.lit(NO_FILE))


def file_flags(file: Column) -> Column:
    """The flags of a call's file; a call without one counts as reading only."""
    return F.when(file.isNull(), F.lit(0)).otherwise(file["flags"]).cast("int")


def file_text(file: Column) -> Column:
    flags = flags_text(file["flags"])
    name = F.coalesce(file["name"], F.lit(""))
    by_fd = F.concat(F.when(name == "", F.lit("E:name")).otherwise(name), F.lit("%("), file["fd"].cast("string"), F.lit(","), flags, F.lit(")"))
    renamed = F.concat(F.lit("old:"), file["oldname"], F.lit(" ->new:"), name, F.lit("%("), flags, F.lit(")"))
    by_path = F.concat(F.lit("pathname:"), name, F.lit("%("), flags, F.lit(")"))
    return F.when(file.isNull(), F.lit(NO_FILE)).when(file["kind"] == "fd", by_fd).when(file["kind"] == "name", renamed).otherwise(by_path)


def pair_text(comm: str = "comm", ret: str = "ret", file: str = "file", gap: str = "gap", duration: str = "duration") -> Column:
    """One line of the row stream; durations have eight digits at least, and the result is blank where there is none."""
    c = F.col
    numbers = F.format_string("%08d,%08d", c(gap), c(duration))
    return F.concat(
        numbers, F.lit(","), F.coalesce(c(comm), F.lit("")), F.lit("@"), c("pid").cast("string"), F.lit("."), c("tid").cast("string"), F.lit(","), c("name"),
        F.lit("=>"), F.coalesce(c(ret).cast("string"), F.lit("")), F.lit(","), file_text(c(file)),
    )
