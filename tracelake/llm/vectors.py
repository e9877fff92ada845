"""What the vector searches share: valid rows, matrices from Arrow lists, and the best candidates of a block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that meet a block of candidates at once.
QUERY_BLOCK = 256


def element(vec_col: str, *tables: DataFrame) -> str:
    """The type in which components travel: float where all tables hold floats, else double."""
    return "float" if all(t.schema[vec_col].dataType.simpleString() == "array<float>" for t in tables) else "double"


def valid(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False, kind: str = "double") -> DataFrame:
    """``id`` and ``vec`` of the rows whose vector can take part: not null, all components finite; no null id."""
    x = F.col(f"`{vec_col}`").cast(f"array<{kind}>")
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("vec")).where("id is not null and vec is not null")
    out = out.where(F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)))
    return out.where(F.exists("vec", lambda v: v != 0)) if nonzero else out


def one_row_per_id(queries: DataFrame) -> DataFrame:
    """Repeated query ids are asked once, by the smallest of their vectors."""
    return queries.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim))
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated rows (same id, same vector), which all lie in one block."""
    if len(np.unique(ids)) == len(ids):
        return ids, x
    _, first = np.unique(np.c_[ids.astype(np.int64).view(np.float64), x + 0.0].view(np.int64), axis=0, return_index=True)
    return ids[np.sort(first)], x[np.sort(first)]


def best(scores: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0, rescore: Callable | None = None, none: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``scores`` (``none``: no candidate) its ``k`` best columns, ties to the smaller id.

    All columns within ``slack`` of the k-th score are kept before ``rescore(rows, columns)`` gives the scores that
    decide. Returns row, column and score.
    """
    n = scores.shape[1]
    if not n or not len(scores):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    low = np.partition(scores, n - min(k, n), axis=1)[:, n - min(k, n)]
    row, col = np.nonzero((scores >= (low - slack if slack else low)[:, None]) & (scores > none))
    value = rescore(row, col) if rescore else scores[row, col]
    order = np.lexsort((ids[col], -value, row))  # a score of int64 is never its least value, so it can be negated
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], value[place < k]


def rank(found: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` best among what the blocks found."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
