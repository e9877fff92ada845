"""A table that grows by numbered parts, one for each batch of a stream, and is compacted now and then.

The folder holds ``batch=<n>``, what batch ``n`` added, and ``upto=<n>``, what all batches up to ``n`` make together. A folder counts once Spark's
writer has marked it as a success, which it does last. A reader takes the compacted folder of the highest number and the parts above it, so a compaction
takes effect at one moment: what was there before counts until then, and nothing counts twice after it. A batch that is tried again replaces its part;
if it is compacted already, its part is no longer read. A compaction that failed leaves a folder that does not count, and the next one replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PART, WHOLE = "batch", "upto"


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, bool]:
    """The numbers of the folders of a kind, and whether each is whole."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = spark._jvm.org.apache.hadoop.fs.Path
    found = (f.getPath().toString() for f in fs.globStatus(pattern))
    return {int(p.rsplit("=", 1)[1]): fs.exists(mark(f"{p}/_SUCCESS")) for p in found}


def add_part(rows: DataFrame, path: str, number: int) -> None:
    """What batch ``number`` adds; a second try replaces the first."""
    _write(rows, f"{path}/{PART}={number}")


def layout(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The compacted folder that counts (None: none yet) and the parts that count besides, ascending."""
    base = max((n for n, done in _folders(spark, path, WHOLE).items() if done), default=None)
    return base, sorted(n for n, done in _folders(spark, path, PART).items() if done and (base is None or n > base))


def _read(spark: SparkSession, path: str, schema: str, base: int | None, parts: list[int]) -> DataFrame:
    paths = [f"{path}/{WHOLE}={base}"] * (base is not None) + [f"{path}/{PART}={n}" for n in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all parts so far, each batch's once, as ``schema``; of an empty folder none."""
    return _read(spark, path, schema, *layout(spark, path))


def compact(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
    """Merge the parts into one folder and return its number, or None if there was nothing to merge.

    ``merge`` takes the rows of several parts and gives those of one, as a sum by key does. Batches are written in turn, so parts are taken up to the
    first that is not whole. Old folders stay, as somebody may be reading them, until ``vacuum``.
    """
    base, _ = layout(spark, path)
    ready: list[int] = []
    for n, done in sorted(_folders(spark, path, PART).items()):
        if base is not None and n <= base:
            continue
        if not done:
            break
        ready.append(n)
    if not ready:
        return None
    _write(merge(_read(spark, path, schema, base, ready)), f"{path}/{WHOLE}={ready[-1]}")
    return ready[-1]


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what a compaction has replaced: parts and compacted folders below the one that counts. No reader may still be at work on them."""
    base, _ = layout(spark, path)
    if base is None:
        return
    gone = [f"{path}/{PART}={n}" for n in _folders(spark, path, PART) if n <= base] + [f"{path}/{WHOLE}={n}" for n in _folders(spark, path, WHOLE) if n < base]
    for p in map(spark._jvm.org.apache.hadoop.fs.Path, gone):
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
