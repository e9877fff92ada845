"""Exact top-k search by inner product as a Voronoi kNN join.

A vector x becomes (x, sqrt(M - |x|^2)), M the largest squared length, and a query q becomes (q, 0); then the nearest by
distance are those of the largest inner product. Pivots divide the space. Each cell of queries has a bound on the
distance of its queries' k-th neighbour, from the cells' summaries alone: their sizes, radii and the smallest distances to the
pivot of k + 1 ids. By the triangle inequality a vector can be among the answers of a cell of queries only if its distance to
its own pivot lies in a ring, so only such vectors go to the cell's group. Groups are solved locally, in chunks of data that
follow its cells, and queries go only to the chunks that hold a cell whose vectors a ring of theirs reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.llm.vectors import QUERY_BLOCK, best, element, matrix, once, one_row_per_id, rank, valid

SCALE = 1024.0
#: Pivots: the root of the number of queries, within these bounds (the driver holds their distances and cells' heads).
LEAST_PIVOTS, MOST_PIVOTS = 64, 512
#: Candidates in one chunk of a group, and queries in one group.
CHUNK, GROUP = 32_768, 8_192
#: Scores up to this are exact in doubles, and in 64-bit integers.
DOUBLE, LONG = 2.0**53, 2.0**63
NONE = np.iinfo(np.int64).min


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def _length(vec: str) -> Column:
    """The squared length of the whole-number vector; large doubles are whole already and would not fit a long."""
    n = F.transform(vec, lambda v: F.when(F.abs(v * SCALE) < 2.0**52, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    return F.aggregate(n, F.lit(0.0), lambda a, b: a + b * b)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _cells(rows: DataFrame, pivots: np.ndarray, largest: float | None, dim: int) -> DataFrame:
    """The rows with their cell, the distance to its pivot and a mix of the whole-number vector; ``largest`` lifts data, None leaves queries flat."""
    odd = np.random.default_rng(dim).integers(0, 1 << 62, dim) * 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(matrix(b.column(1), dim))
            last = np.sqrt(np.maximum(largest - (x**2).sum(1), 0)) if largest is not None else np.zeros(len(x))
            d = _distances(np.c_[x, last], pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1, initial=np.inf)), pa.array(((x + 0.0).view(np.int64) * odd).sum(1))], ["id", "vec", "cell", "dist", "mix"])

    return rows.mapInArrow(run, f"id long, vec {rows.schema['vec'].dataType.simpleString()}, cell int, dist double, mix long")


def rings(between: np.ndarray, reach: np.ndarray, data_cells: list, k: int, slack: float, data_ids: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per cell of queries (rows) and cell of data (columns), the least and the largest distance to its pivot that a
    vector of the data cell needs in order to matter; least > largest where none can.

    ``reach``: the largest distance of a query of the cell to its pivot, -1 for cells without queries. ``data_cells``: per
    cell of data its k + 1 smallest distances (one more than k, as the query itself may be among them); ``data_ids``: their
    ids, each once a cell, where rows can share an id. An id counts once, as all rows of the query's own are no candidates.
    """
    n = len(between)
    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for i in np.flatnonzero(reach >= 0):
        bounds = np.concatenate([reach[i] + between[i, j] + np.array(data_cells[j]) for j in range(n)])
        order = np.argsort(bounds, kind="stable")
        if data_ids is not None:
            order = order[np.sort(np.unique(np.concatenate([np.array(x, np.int64) for x in data_ids])[order], return_index=True)[1])]
        bounds = bounds[order]
        far = bounds[k] + slack if len(bounds) > k else np.inf
        low[i], high[i] = between[i] - reach[i] - far - slack, between[i] + reach[i] + far + slack
    return low, high


def search(data: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` largest inner products of each query with ``data``.

    Components count as floor(1024 x). Ties go to the smaller id; a candidate with the query's own id is none. Null
    ids and vectors that are null or hold a null or non-finite component take no part. Shorter vectors are filled up
    with zeros. Repeated rows of ``data`` are one candidate; a repeated query id is asked once, by its smallest vector.
    Queries with fewer candidates than ``k`` get all of them. No valid row gives an empty result. Scores are exact: where
    products can reach 2^53 they are made in 64-bit integers, and where they can reach 2^63 an error is raised.
    """
    spark = data.sparkSession
    kind = element(vec_col, data, queries)
    rows, asked = cut(valid(data, id_col, vec_col, kind=kind).dropDuplicates(["id", "vec"])), cut(one_row_per_id(valid(queries, id_col, vec_col, kind=kind)))
    count, largest, dim = rows.select(F.count("*"), F.max(_length("vec")), F.max(F.size("vec"))).first()
    n_asked, longest, dim_asked = asked.select(F.count("*"), F.max(_length("vec")), F.max(F.size("vec"))).first()
    dim = max(dim or 0, dim_asked or 0)
    if not count or not dim or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = float(np.sqrt(largest) * np.sqrt(longest)) * (1 + 1e-9)
    if most >= LONG:
        raise ValueError(f"inner products may reach {most:.3g}: they do not fit a long")
    exact = most < DOUBLE
    # A bounded sample of rows, the same on each run: the pivots.
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, np.ceil(np.sqrt(n_asked)))))
    sample = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("vec")).limit(wanted).toPandas()
    p = np.zeros((len(sample), dim))
    for at, v in enumerate(sample["vec"]):
        p[at, : len(v)] = v
    p = np.unique(whole(p), axis=0)
    pivots = np.c_[p, np.sqrt(np.maximum(largest - (p**2).sum(1), 0))]

    placed = cut(_cells(rows, pivots, largest, dim))
    placed_asked = cut(_cells(asked, pivots, None, dim))
    nearest = Window.partitionBy("cell").orderBy("dist", "id")
    heads = placed.groupBy("cell", "id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    first = {c: h for c, h in heads.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("dist", "id")))).collect()}
    queried = {c: (n, d) for c, n, d in placed_asked.groupBy("cell").agg(F.count("*"), F.max("dist")).collect()}
    reach = np.array([queried.get(i, (0, -1.0))[1] for i in range(len(pivots))])
    slack = 1e-6 * np.sqrt(max(largest, longest, 1.0))
    cells = [first.get(i, []) for i in range(len(pivots))]
    low, high = rings(_distances(pivots, pivots), reach, [[h[0] for h in c] for c in cells], k, slack, [[h[1] for h in c] for c in cells])

    per_group, group_of, parts_of = groups([queried.get(i, (0, 0))[0] for i in range(len(pivots))], pivots[:, 0])
    stats = {c: s for c, *s in placed.groupBy("cell").agg(F.count("*"), F.min("dist"), F.max("dist")).collect()}
    held, closest, widest = zip(*[stats.get(i, (0, np.inf, -np.inf)) for i in range(len(pivots))], strict=True)
    _, chunk_of, chunks_of = groups(list(held), pivots[:, 0], int(min(CHUNK, max(1024, np.ceil(count / spark.sparkContext.defaultParallelism)))))
    meets = (low <= np.array(widest)) & (high >= np.array(closest))
    runs = {i: made for own, _ in per_group for made in [joined([(chunk_of[j], chunk_of[j] + chunks_of[j] - 1) for j in np.flatnonzero(meets[own].any(0))])] for i in own}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            for own, numbers in per_group:
                need = np.zeros(len(cell), bool)
                for i in own:
                    need |= (dist >= low[i, cell]) & (dist <= high[i, cell])
                part = b.filter(pa.array(need))
                for g in numbers if len(part) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), g), pa.int32()), *(part.column(i) for i in (0, 1, 4))], ["g", "id", "vec", "chunk"])

    def of_cell(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(3).to_numpy()
            for i in np.unique(cell):
                part = b.filter(pa.array(cell == i))
                for run in runs[i]:
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(np.full(len(part), c), pa.int32()) for c in run)], ["g", "id", "vec", "first", "last"])

    shape = f"g int, id long, vec array<{kind}>"
    # Rows that share id and whole numbers stay together; others of one id need not.
    chunk = of_cell(chunk_of) + F.pmod(F.xxhash64("id", "mix"), of_cell(chunks_of)).cast("int")
    sent = placed.select("id", "vec", "cell", "dist", chunk.alias("chunk")).mapInArrow(send, shape + ", chunk int").withColumn("asks", F.lit(False))
    number = of_cell(group_of) + F.pmod(F.xxhash64("id", F.lit(1)), of_cell(parts_of)).cast("int")
    asks = placed_asked.select(number.alias("g"), "id", "vec", "cell").mapInArrow(ask, shape + ", first int, last int")
    asks = asks.select("g", "id", "vec", F.explode(F.sequence("first", "last")).alias("chunk"), F.lit(True).alias("asks"))

    def solve(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        q, d = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        ids, x = once(d.column("id").to_numpy(), whole(matrix(d.column("vec"), dim)))
        qid, qx = q.column("id").to_numpy(), whole(matrix(q.column("vec"), dim))
        if not exact:
            x, qx = x.astype(np.int64), qx.astype(np.int64)  # sums may wrap on the way, the result fits
        none, out = -np.inf if exact else NONE, []
        for s in range(0, len(qid), QUERY_BLOCK):
            scores = qx[s : s + QUERY_BLOCK] @ x.T
            scores[qid[s : s + QUERY_BLOCK, None] == ids[None]] = none
            r, c, v = best(scores, ids, k, none=none)
            out.append((qid[r + s], ids[c], v.astype(np.int64)))
        made = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [[], [], []])]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, made), strict=True)))

    found = sent.unionByName(asks).groupBy("g", "chunk").applyInArrow(solve, "query_id long, vec_id long, score long")
    return rank(found, k)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of numbers, ends included, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def groups(sizes: list[int], along: np.ndarray, most: int | None = None) -> tuple[list[tuple[list[int], list[int]]], list[int], list[int]]:
    """Cells in groups of about ``most`` rows (GROUP), neighbours in the order of ``along``.

    A cell of more rows is cut into groups of its own, dealt by a hash of the row. Returns the (cells,
    group numbers) that get the same data, and per cell the number of its first group and how many it has.
    """
    most = most or GROUP
    shared, first, parts = [], [0] * len(sizes), [1] * len(sizes)
    number, filled, current = 0, 0, None
    for i in np.argsort(along, kind="stable").tolist():
        n = sizes[i]
        if n > most:
            parts[i] = -(-5 * n // (4 * most))  # a little more, as a hash does not deal evenly
            shared.append(([i], list(range(number, number + parts[i]))))
            first[i], number = number, number + parts[i]
        elif n:
            if current is None or filled + n > most:
                current, filled = ([], [number]), 0
                shared.append(current)
                number += 1
            current[0].append(i)
            first[i], filled = current[1][0], filled + n
    return shared, first, parts
