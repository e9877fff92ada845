"""Tables that cut a lineage, in the folder that driver and executors share.

Each table belongs to the owner that was entered when it was made, so jobs that run side by side delete their own tables only:

    with scratch.Owner() as own:
        query(spark, path).write.parquet(target)
    own.release(spark)
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: The tables and folders that this process has made and not yet deleted, by path, with their owners.
_made: dict[str, Owner | None] = {}
#: The owner that is entered; each thread has its own, and starts without.
_current: contextvars.ContextVar[Owner | None] = contextvars.ContextVar("owner", default=None)


class Owner:
    """What is made while it is entered is its own, and stays until ``release``: results may still have to be read.

    Owners may be entered within each other (the innermost one gets the tables) and again, one thread at a time.
    """

    def __enter__(self) -> Owner:
        self._before = _current.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _current.reset(self._before)

    def release(self, spark: SparkSession, keep: Iterable[DataFrame] = ()) -> None:
        """Delete the owner's tables but those that ``keep`` reads."""
        _release(spark, self, keep)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session that names none (tests) gets a folder of this machine; on a
    cluster executors would not see it, so there the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tracelake.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.tracelake.scratch", found)
    return found.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, for a table or a folder of files, which is deleted with the owner's tables."""
    path = f"{shared_dir(spark)}/tracelake/{uuid.uuid4().hex}"
    _made[path] = _current.get()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    This ends the lineage: a lost executor costs no recomputation of what lies before, and what is used more than
    once is computed once. The table stays until ``drop`` or ``release`` deletes it.
    """
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    hadoop = spark._jsc.hadoopConfiguration()
    for p in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)
        _made.pop(p, None)


def _read(tables: Iterable[DataFrame]) -> set[str]:
    """The names of the folders that the tables read."""
    return {part for t in tables for f in t.inputFiles() for part in f.split("/")[:-1]}


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that nothing reads any more."""
    names = {f.split("/")[-2] for f in df.inputFiles()}
    _delete(df.sparkSession, [p for p in list(_made) if p.rsplit("/", 1)[-1] in names])


def _release(spark: SparkSession, owner: Owner | None, keep: Iterable[DataFrame]) -> None:
    names = _read(keep)
    _delete(spark, [p for p, own in list(_made.items()) if own is owner and p.rsplit("/", 1)[-1] not in names])


def release(spark: SparkSession, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the tables that no owner has but those that ``keep`` reads: to be called when results have been written."""
    _release(spark, None, keep)
