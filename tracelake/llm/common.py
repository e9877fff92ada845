"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracelake.scratch import cut, drop

#: The characters that separate words in the contracts of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a worker turns into Python strings at once; Arrow batches are bounded in bytes by Spark's own setting.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(docs: DataFrame, keep: list[str], text: str, out: list[StructField], fn: Callable[[list[str]], list[list]]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the columns ``out`` that ``fn`` makes from the texts of a batch (null: empty).

    ``fn`` gets a list of texts and returns a list for each column of ``out``. Partitions stay as they were read;
    nothing is shuffled. The temporary names avoid clashes with other columns of ``docs``.
    """
    schema = StructType([docs.schema[c] for c in keep] + out)
    types = pa.schema([pa.field(f.name, _arrow(f)) for f in out])

    at = keep.index(text) if text in keep else len(keep)
    extra = [] if text in keep else [F.col(f"`{text}`").alias("__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(i, BATCH_ROWS) for w in batches for i in range(0, w.num_rows, BATCH_ROWS)):
            made = fn([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(v, type=f.type) for v, f in zip(made, types, strict=True))], [*keep, *types.names])

    return docs.select(*[F.col(f"`{c}`") for c in keep], *extra).mapInArrow(run, schema)


def _arrow(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; such rows never give labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node reachable.

    Large-star and small-star rounds in turn (Kiveris et al. 2014), each a partial aggregate and an equi-join, until a
    round changes nothing. No group is ever gathered: a hub is an aggregate over its edges and one side of a
    join that adaptive execution can split. Every round is cut by a table in the shared folder. Nodes without an edge
    do not appear. Nulls in either column give no edge.
    """
    work = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u"))) if large else e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        near = joined.where("v > u") if large else joined.where("v <> m")
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    sign = None
    for _ in range(limit):
        after = cut(star(star(work, True), False))
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(work)
        work = after
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).union(work.select(F.col("v"), F.col("v")).distinct())
