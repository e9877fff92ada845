"""The system-call dimension: ids, names, record kinds and I/O classes.

The ids belong to one kernel, so they are data: ``syscall_dim`` takes the id of each call's enter tracepoint, from a
listing of that kernel. The record kinds and the I/O classes follow from the names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The calls of each kind of enter record.
KINDS = {
    "fd": "cachestat close close_range dup dup2 fadvise64 fallocate fchdir fchmod fchown fdatasync fgetxattr finit_module flistxattr flock fremovexattr "
    "fsconfig fsetxattr fstatfs fsync ftruncate getdents getdents64 ioctl lseek mmap newfstat pread64 preadv preadv2 pwrite64 pwritev pwritev2 quotactl_fd "
    "read readahead readv sync_file_range syncfs vmsplice write writev",
    "path": "access chdir chmod chown chroot creat faccessat faccessat2 fanotify_mark fchmodat fchmodat2 fchownat fspick futimesat getxattr getxattrat lchown "
    "lgetxattr listxattr listxattrat llistxattr lremovexattr lsetxattr mkdir mkdirat mount_setattr newfstatat newlstat newstat readlink readlinkat removexattr "
    "removexattrat rmdir setxattr setxattrat statfs statx truncate unlink unlinkat utimensat",
    "null": "io_cancel io_destroy io_getevents io_pgetevents io_setup io_submit io_uring_enter io_uring_register io_uring_setup sync syslog",
    "name": "link linkat rename renameat renameat2 symlink symlinkat",
    "open": "open openat openat2 open_tree open_tree_attr",
    "dup3": "dup3",
    "fcntl": "fcntl",
}
#: Calls that traces may hold besides, by the kind of record that fits their arguments.
MORE_KINDS = {"fd": "copy_file_range", "null": "msync getcwd", "path": "name_to_handle_at", "open": "open_by_handle_at"}
#: Beginnings of the names of each I/O class, whole names before a blank.
READS = ("getdents", "pread", "process_vm_readv", "readlink", "readv", "recv")
TRANSFERS = ("copy_file_range", "sendfile64", "splice", "tee", "vmsplice")
WRITES = ("process_vm_writev", "pwrite", "pwritev", "send", "writev")
#: The enter ids that the traces of the driver's events use.
ENTER_IDS = {"openat": 798, "read": 858, "write": 856, "dup": 932, "close": 792, "newstat": 874, "rename": 884, "sync": 1040, "fcntl": 912}


def record_kind(name: str) -> str | None:
    return next((kind for kinds in (KINDS, MORE_KINDS) for kind, names in kinds.items() if name in names.split()), None)


def io_class(name: str) -> str:
    """What the result of a call counts: bytes read, written or moved between files, or nothing."""
    if name in TRANSFERS:
        return "transfer"
    if name == "read" or name.startswith(READS):
        return "read"
    if name == "write" or name.startswith(WRITES):
        return "write"
    return "none"


def _literal(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def syscall_dim(spark: SparkSession, enter_ids: Mapping[str, int] | None = None) -> DataFrame:
    """Two rows a call: its enter tracepoint and its exit, whose id is one less. Unknown names have no record kind."""
    rows = []
    for name, i in (ENTER_IDS if enter_ids is None else enter_ids).items():
        rows += [(i, name, "enter", record_kind(name), io_class(name)), (i - 1, name, "exit", "ret", io_class(name))]
    # A table of values has a size that the optimizer knows, so it is the side that is sent around; one made by createDataFrame has none.
    values = ", ".join(f"({int(i)}, {', '.join(map(_literal, rest))})" for i, *rest in rows)
    columns = "trace_id, name, phase, record_kind, io_class"
    if not rows:
        return spark.createDataFrame([], "trace_id int, name string, phase string, record_kind string, io_class string")
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({columns})")


def listing_dim(listing: DataFrame) -> DataFrame:
    """The same from a listing (id, tracepoint), such as sys_enter_openat; names of other tracepoints are left out."""
    dim = syscall_dim(listing.sparkSession, {n: 0 for kinds in (KINDS, MORE_KINDS) for names in kinds.values() for n in names.split()}).where("phase = 'enter'").drop("trace_id", "phase")
    own = listing.select(F.col("id").cast("int").alias("trace_id"), F.regexp_extract("tracepoint", "^sys_(enter|exit)_(.+)$", 1).alias("phase"), F.regexp_extract("tracepoint", "^sys_(enter|exit)_(.+)$", 2).alias("name"))
    kind = F.when(F.col("phase") == "exit", F.lit("ret")).otherwise(F.col("record_kind"))
    return own.join(dim, "name").select("trace_id", "name", "phase", kind.alias("record_kind"), "io_class")


def tracepoint(dim: DataFrame) -> Column:
    """The form of the name that stacks show, such as enter_openat."""
    return F.concat_ws("_", dim["phase"], dim["name"])
