"""Which duplicates leave the table of open files as it is, when a filter on paths comes before it.

A duplicate passes if its source's file does, and then its target has a file that passes; else nothing changes. So all that counts of a descriptor is its
state: its file passes (YES), does not (NO), or it has none of the trace (LOST, where the snapshot tells for each call). The calls of a process are folded in their order.
A process may hold most of the trace, so the sorted calls are cut into chunks: each chunk of a process that crosses a border is summed up as what a descriptor's state at the
end is made from at the start, these few rows are followed from chunk to chunk, and then all chunks are folded side by side, each from its start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.scratch import cut

LOST, NO, YES, LINK = 0, 1, 2, 3
#: Where a chunk is folded without its start, a descriptor that it has not set.
START = None
ORDER = ("key", "chunk", "mark", "exit_time_ns", "exit_seq")
#: Descriptors that are null, beside all others.
NO_FD = -(1 << 40)
#: A chunk's end in terms of its start: the state of ``fd`` is YES if one of ``yes`` is YES or one of ``open`` is YES or LOST there, else ``base`` (null: as at the start).
SUMS = "key string, chunk int, fd bigint, base int, yes array<bigint>, open array<bigint>"


def _link(states: dict, src: int, dst: int, snap: bool, default: int | None) -> bool | None:
    """Whether the duplicate passes, None if the start decides. A state is a base and the descriptors (with whether LOST counts) that make it YES."""
    base, of = states.get(src, (default, frozenset()))
    if base == YES or (base == LOST and snap):
        states[dst] = (YES, frozenset())
        return True
    if base is START:
        of = of | {(src, snap)}
    if not of:
        return False
    base, own = states.get(dst, (default, frozenset()))
    if base != YES:
        states[dst] = (base, own | of)
    return None


def _each(batches: Iterator[pa.RecordBatch], default: int | None) -> Iterator[tuple]:
    """Each batch, which of its rows are duplicates that do not pass, and the chunks that ended in it with their states."""
    now, states = None, {}
    for batch in batches:
        fails, ended = [], []
        for key, chunk, what, fd, src, snap in zip(*(batch.column(n).to_pylist() for n in ("key", "chunk", "what", "fd", "src", "snap")), strict=True):
            if (key, chunk) != now:
                if now is not None:
                    ended.append((now, states))
                now, states = (key, chunk), {}
            fails.append(what == LINK and _link(states, src, fd, snap, default) is False)
            if what != LINK:
                states[fd] = (what, frozenset())
        yield batch, fails, ended
    if now is not None:
        yield None, [], [(now, states)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, ended in _each(batches, START):
        rows = [(*of, fd, base, [f for f, lost in c if not lost], [f for f, lost in c if lost]) for of, states in ended for fd, (base, c) in states.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "chunk", "fd", "base", "yes", "open"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states that each chunk of a process starts with, from sums sorted by process and chunk; descriptors without a row are LOST."""
    now, start, end = None, {}, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["key"], r["chunk"]) != now:
                start = end if now is not None and now[0] == r["key"] else {}
                now, end = (r["key"], r["chunk"]), dict(start)
                out += [(*now, fd, state) for fd, state in start.items()]
            got = any(start.get(f, LOST) == YES for f in r["yes"]) or any(start.get(f, LOST) != NO for f in r["open"])
            end[r["fd"]] = YES if got else start.get(r["fd"], LOST) if r["base"] is None else r["base"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["key", "chunk", "fd", "what"])


def failing(changes: DataFrame, run: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """``run`` and ``vid`` of the duplicates that do not pass.

    ``changes``: ``run``, ``scope``, ``vid``, ``exit_time_ns``, ``exit_seq``, ``fd`` (for duplicates the target), ``what`` (LOST, NO, YES or LINK), and for
    duplicates ``src`` and ``snap``, whether the snapshot's file of the source passes. ``chunks``: at most so many; Spark's own number where none is given.
    """
    key = F.to_json(F.struct(*run, "scope")).alias("key")
    fds = [F.coalesce(F.col(c).cast("bigint"), F.lit(NO_FD)).alias(c) for c in ("fd", "src")]
    plain = changes.select(key, *run, "vid", "exit_time_ns", "exit_seq", *fds, F.col("what").cast("int"), F.coalesce("snap", F.lit(False)).alias("snap"))
    dealt = plain.repartitionByRange(*([chunks] if chunks else []), "key", "exit_time_ns", "exit_seq")
    rows = cut(dealt.withColumn("chunk", F.spark_partition_id()).withColumn("mark", F.lit(1)))
    crossing = rows.groupBy("key").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("key")  # one for each border at most
    sums = rows.join(crossing, "key", "left_semi").repartition("key", "chunk").sortWithinPartitions(*ORDER).mapInArrow(_sums, SUMS)
    starts = sums.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_starts, "key string, chunk int, fd bigint, what int")
    every = rows.unionByName(starts.withColumns({"mark": F.lit(0), "snap": F.lit(False)}), allowMissingColumns=True).repartition("key", "chunk").sortWithinPartitions(*ORDER)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, fails, _ in _each(batches, LOST):
            if batch is not None:
                yield batch.select([*run, "vid"]).filter(pa.array(fails, pa.bool_()))

    return every.mapInArrow(fold, rows.select(*run, "vid").schema)
