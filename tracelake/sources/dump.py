"""Binary dumps: files of raw records one after the other, as a data source of Spark, batch and stream.

    register(spark)
    raw.write.format("tracedump").mode("append").save(folder)
    spark.read.format("tracedump").load(folder)          # seq, payload
    spark.readStream.format("tracedump").load(folder)    # files may grow, and new ones come

A record's length follows from its first byte, and nothing marks where one begins, so a task that is given a range of bytes looks
back: of all chains of records that begin in a window before the range, the true one is among those that do not break. If these agree on the record
that the range begins in, that is it; else the window is widened, at most to the start of the file, where the chain is known. So
ranges are exact, and no one reads a file from its start but for a file without any agreement.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tracelake.sources.raw import KIND_OF_TYPE, LAYOUT

NAME, SCHEMA = "tracedump", "seq bigint, payload binary"
#: Bytes of a range, of the first window before one, and of payloads in a batch of rows.
RANGE, WINDOW, BATCH = 64 << 20, 1 << 16, 4 << 20
#: A record's number is its file's place times this, plus where it ends in the file: files of up to a terabyte.
FILE_SHIFT = 40


def sizes() -> dict[int, int]:
    """The length of a record by its type."""
    return {t: max(offset + size for _, offset, size in LAYOUT[kind].values()) for t, kind in KIND_OF_TYPE.items()}


SIZES = sizes()
LONGEST = max(SIZES.values())


class BrokenDump(ValueError):
    """A record of no known type: what comes after it cannot be told apart."""


def _size_at(data: bytes, at: int) -> int:
    """The length of a record that begins there, 0 if none can. Types are 32-bit numbers."""
    return SIZES.get(data[at], 0) if data[at + 1 : at + 4] == b"\0\0\0"[: len(data) - at - 1] else 0


def border(data: bytes, origin: int, target: int) -> int | None:
    """The begin of the record that holds the byte ``target``, or is to begin there; None if the chains do not agree.

    ``data`` are the file's bytes from ``origin``, up to the target and LONGEST behind it where there are as many. At ``origin`` 0 the chain is known.
    """
    if target == 0:
        return 0
    here = target - origin
    lead: dict[int, int] = {}  # by place: the border that the chain from there has at or last before the target

    def follow(at: int) -> int:
        """That border, -1 if the chain breaks before."""
        trail = []
        while at not in lead:
            size = _size_at(data, at) if at < len(data) else 0
            if at == here or (size and at + size > here):
                lead[at] = at
            elif not size:
                lead[at] = -1
            else:
                trail.append(at)
                at += size
        for t in trail:
            lead[t] = lead[at]
        return lead[at]

    if origin == 0:
        found = follow(0)
        if found < 0:
            raise BrokenDump(f"no chain of records leads from the start of the file to byte {target}")
        return found
    # The true chain has a border among LONGEST places in a row, so it is one of these.
    ends = {follow(at) for at in range(min(LONGEST, here))} - {-1}
    return origin + ends.pop() if len(ends) == 1 else None


@dataclass
class Range(InputPartition):
    """The records of a file that end behind ``begin`` and not behind ``end``; ``rest``: and what is left at the end of the file."""

    path: str
    place: int
    begin: int
    end: int
    rest: bool


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """The dump's files and lengths by name; names that begin with a dot or an underscore are not the dump's."""
    fs, root = _open(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    own = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((prefix + f.path, f.size) for f in own)


def cut_ranges(path: str, place: int, begin: int, end: int, size: int, rest: bool) -> list[Range]:
    edges = [*range(begin, end, size), end]
    return [Range(path, place, a, b, rest and b == end) for a, b in zip(edges, edges[1:], strict=False)]


def records(r: Range) -> Iterator[pa.RecordBatch]:
    """The rows of a range. ``seq`` rises with the place in the file; a record that is cut off by the end of the file is a row too, as it is."""
    fs, path = _open(r.path)
    with fs.open_input_file(path) as f:
        length, window, at = f.size(), WINDOW, None
        while at is None:
            origin = max(0, r.begin - window)
            f.seek(origin)
            at, window = border(f.read(min(length, r.begin + LONGEST) - origin), origin, r.begin), window * 4
        seqs, payloads, held, base = [], [], b"", at
        while True:
            f.seek(at)
            held, base = f.read(min(BATCH, length - at)), at
            done = 0
            while done < len(held):
                size = _size_at(held, done)
                if not size and len(held) - done >= 4:
                    raise BrokenDump(f"{r.path}: no record begins at byte {base + done}")
                if not size or done + size > len(held) or base + done + size > r.end:
                    break
                seqs.append((r.place << FILE_SHIFT) + base + done + size)
                payloads.append(held[done : done + size])
                done += size
            at = base + done
            if seqs:
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(payloads, pa.binary())], ["seq", "payload"])
                seqs, payloads = [], []
            if at >= r.end or base + len(held) >= length or (done < len(held) and (size := _size_at(held, done)) and at + size > r.end):
                break
        if r.rest and at < length == r.end:
            f.seek(at)
            yield pa.RecordBatch.from_arrays([pa.array([(r.place << FILE_SHIFT) + length], pa.int64()), pa.array([f.read()], pa.binary())], ["seq", "payload"])


class DumpReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        found = [r for k, (f, n) in enumerate(listed(self.path)) for r in cut_ranges(f, k, 0, n, self.size, True)]
        return found or [Range("", 0, 0, 0, False)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from records(partition) if partition.path else ()


class DumpStream(DataSourceStreamReader):
    """Offsets hold every file with its place (the order in which files came) and the bytes seen. A record that is not whole yet is read once it is."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.last: dict = {"files": []}

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        now = dict(listed(self.path))
        known = [f for f, _ in self.last["files"]]
        self.last = {"files": [[f, now.get(f, 0)] for f in known] + [[f, now[f]] for f in sorted(set(now).difference(known))]}
        return self.last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last = end if len(end["files"]) >= len(self.last["files"]) else self.last
        before = dict(map(tuple, start["files"]))
        return [r for k, (f, n) in enumerate(end["files"]) if n > before.get(f, 0) for r in cut_ranges(f, k, before.get(f, 0), n, self.size, False)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from records(partition)


@dataclass
class Written(WriterCommitMessage):
    name: str


class DumpWriter(DataSourceWriter):
    """A file for each task, under a name of the write and the task; files count once all tasks are done, when they lose their leading dot."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.own = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{context.partitionId():08d}-{self.own}-{context.taskAttemptId()}.bin"
        with fs.open_output_stream(f"{root}/.{name}") as f:
            for row in iterator:
                f.write(bytes(row["payload"] or b""))
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        old = listed(self.path) if self.overwrite else []
        for m in messages:
            fs.move(f"{root}/.{m.name}", f"{root}/{m.name}")
        for f, _ in old:
            fs.delete_file(_open(f)[1])

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/.{m.name}")


class TraceDump(DataSource):
    """``path``: a file or folder; ``rangeBytes``: bytes that a task reads (RANGE)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _own(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("a dump needs a path")
        return self.options["path"].rstrip("/"), max(LONGEST, int(self.options.get("rangeBytes", RANGE)))

    def reader(self, schema) -> DumpReader:
        return DumpReader(*self._own())

    def streamReader(self, schema) -> DumpStream:
        return DumpStream(*self._own())

    def writer(self, schema, overwrite: bool) -> DumpWriter:
        return DumpWriter(self._own()[0], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceDump)
