"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

A vector of length 1 has in each table the key floor((a . x + b) / w) of some Gaussian projections, whose number grows
with the logarithm of the rows, so that buckets stay small. A query looks into its own bucket and into perturbed ones, in the
order of estimated success: its projections' distances to the cell borders are sorted, and a fixed list of sets of these
ranks, by expected squared distance, is walked through (Lv et al. 2007). How many sets are walked is set on a bounded
sample of queries, compared with brute force over all rows, so that recall reaches a target. Where all sets are too few for it, the tables
get fewer projections, and so larger buckets, until they are not; without any, one bucket holds all rows and the search is exact, by blocks.
So recall does not fall as tables grow: the share of rows that a query meets rises instead. Every row is indexed; no
bucket is capped: those with many rows are split over parts by id, and every part is searched. Each part takes the exact
cosine of the pairs that meet in a bucket and gives each query's best.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.llm.vectors import QUERY_BLOCK, best, element, matrix, once, one_row_per_id, rank, valid

LOG = logging.getLogger("tracelake")
TABLES, WIDTH, SEED = 8, 3.0, 11
#: Projections of a table: so many for each doubling of the rows, within these bounds.
PER_DOUBLING, LEAST_HASHES, MOST_HASHES = 1.15, 6, 40
#: Queries of the sample that sets the number of probes, the recall they must reach, and the sets that are tried at most.
SAMPLE, RECALL, SETS = 200, 0.96, 8_192
#: Rows in one part of a table, rows of a bucket beyond which it is split, and split buckets kept in memory.
PART, HOT, MOST_HOT = 8_192, 4_096, 1_000_000
#: Where a block of queries meets more than this share of a part's rows, one product of matrices is cheaper than pairs.
DENSE = 1 / 40
#: Pairs whose vectors are gathered at once.
PAIRS = 16_384
NEAR = 1e-9


def hashes_for(count: int) -> int:
    return int(min(MOST_HASHES, max(LEAST_HASHES, round(PER_DOUBLING * np.log2(max(count, 2))))))


def probe_sets(hashes: int, limit: int = SETS) -> list[tuple[int, ...]]:
    """Sets of ranks (0: the nearest border of 2 * ``hashes``) in order of expected squared distance, the empty set first."""
    if not hashes:
        return [()]
    m = hashes
    rising = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    # The border opposite the j-th nearest one is a whole cell less that distance away.
    cost = rising + [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    out: list[tuple[int, ...]] = [()]
    queue: list[tuple[float, tuple[int, ...]]] = [(cost[0], (0,))]
    while queue and len(out) < limit:
        total, s = heapq.heappop(queue)
        if len({min(j, 2 * m - 1 - j) for j in s}) == len(s):  # never both borders of one projection
            out.append(s)
        if (last := s[-1]) + 1 < 2 * m:
            heapq.heappush(queue, (total + cost[last + 1], (*s, last + 1)))
            heapq.heappush(queue, (total - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
    return out


class Hashes:
    """The projections of all tables, and what follows from them for vectors of length 1."""

    def __init__(self, dim: int, hashes: int = 8):
        rng = np.random.default_rng(SEED)
        self.hashes = hashes
        self.tables = TABLES if hashes else 1
        self.a = rng.standard_normal((TABLES, dim, hashes))
        self.b = rng.random((TABLES, hashes)) * WIDTH
        self.mix = rng.integers(1, 1 << 62, (TABLES, hashes), dtype=np.int64) | 1
        sets = probe_sets(hashes)
        # A set costs more than the set without its last rank, which so comes before it: its key is one step from that key.
        at = {s: i for i, s in enumerate(sets)}
        self.size = np.array([len(s) for s in sets])
        self.prefix = np.array([at[s[:-1]] if s else 0 for s in sets])
        self.last = np.array([s[-1] if s else 0 for s in sets])

    def _key(self, t: int, cell: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.mix[t]).sum(-1)

    def keys(self, t: int, x: np.ndarray) -> np.ndarray:
        return self._key(t, np.floor((x @ self.a[t] + self.b[t]) / WIDTH))

    def probes(self, t: int, x: np.ndarray, n: int) -> np.ndarray:
        """The keys of the first ``n`` buckets of each row's probing order."""
        f = (x @ self.a[t] + self.b[t]) / WIDTH
        cell = np.floor(f)
        low = f - cell
        order = np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1, kind="stable")
        which, sign = order % self.hashes, np.where(order < self.hashes, -1, 1)
        with np.errstate(over="ignore"):
            change = sign * self.mix[t][which]  # what a step across the border of each rank adds to the key
            out = np.empty((len(x), min(n, len(self.size))), np.int64)
            out[:, 0] = self._key(t, cell)
            for size in range(1, self.size[:n].max() + 1):
                own = np.flatnonzero(self.size[:n] == size)
                out[:, own] = out[:, self.prefix[own]] + change[:, self.last[own]]
            return out


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows times powers of two, so that no square over- or underflows; cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal pairs give equal results."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def part_of(keys: np.ndarray, salts: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        u = (keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (((u >> np.uint64(20)) + salts.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def salt_of(ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        u = ids.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((u >> np.uint64(32)) % salts.astype(np.uint64)).astype(np.int64)


def _brute(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, dim: int) -> DataFrame:
    """The ``k`` nearest of a bounded set of queries among all rows, with their vectors: at most k rows a query and task."""
    flat = unit(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim))]
        for b in batches:
            own, y = b.column(0).to_numpy(), matrix(b.column(1), dim)
            s = flat @ unit(y).T
            s[ids[:, None] == own[None]] = -np.inf
            r, c, v = best(s, own, k)
            row, near, value, vec = (np.concatenate(z) for z in zip(held, (r, own[c], v, y[c]), strict=True))
            order = np.lexsort((near, -value, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            keep = order[place < k]
            held = [row[keep], near[keep], value[keep], vec[keep]]
        vecs = pa.FixedSizeListArray.from_arrays(pa.array(held[3].ravel()), dim).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2]), vecs], ["query_id", "vec_id", "score", "vec"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double, vec array<double>")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


@dataclass(frozen=True)
class Settings:
    """How a table is searched: its projections, the buckets that a query looks into in each table, and the recall that these gave on the sample."""

    h: Hashes
    probes: int
    recall: float


def needed(h: Hashes, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """The probes with which queries ``x`` find RECALL of their neighbours (row i of ``y`` is one of query ``q[i]``), all if none do, and the share found."""
    most = len(h.size)
    first = np.full(len(q), most)
    for t in range(h.tables):
        match = h.probes(t, x, most)[q] == h.keys(t, y)[:, None]
        first = np.minimum(first, np.where(match.any(1), match.argmax(1), most))
    n = min(most, int(np.sort(first)[max(0, int(np.ceil(RECALL * len(first))) - 1)]) + 1)
    return n, float((first < n).mean())


def calibrate(rows: DataFrame, asked: DataFrame, count: int, k: int, dim: int) -> Settings:
    """The settings that reach RECALL on at most SAMPLE queries, by hash of the id, then id: as many projections as the number of rows asks for, or, if SETS probes
    do not reach it, the most that do. Ties among the neighbours go to the smaller id, as in the search."""
    some = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    x = matrix(pa.array([[float(c) for c in v] for v in some["vec"]], pa.list_(pa.float64())), dim)
    ids = some["id"].to_numpy()
    true = _brute(rows, ids, x, k, dim).select("query_id", "vec").toPandas()
    hashes = hashes_for(count)
    if true.empty:
        return Settings(Hashes(dim, hashes), 1, 1.0)
    at = {q: i for i, q in enumerate(ids)}
    q = np.array([at[i] for i in true["query_id"]])
    y = unit(matrix(pa.array(true["vec"].tolist(), pa.list_(pa.float64())), dim))
    while True:
        h = Hashes(dim, hashes)
        n, recall = needed(h, unit(x), q, y)
        if recall >= RECALL or not hashes:
            LOG.info("%d projections, %d probes, recall %.3f on %d queries", hashes, n, recall, len(ids))
            return Settings(h, n, recall)
        hashes -= 1


def _meet(q: np.ndarray, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of each pair: query ``q`` probes bucket ``b``, and rows lie sorted by bucket."""
    n = sizes[b]
    return np.repeat(q, n), np.repeat(starts[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Part:
    """The rows of one part of a table, sorted by bucket."""

    def __init__(self, h: Hashes, t: int, ids: np.ndarray, x: np.ndarray):
        ids, x = once(ids, x)
        flat = unit(x)
        keys = h.keys(t, flat)
        order = np.argsort(keys, kind="stable")
        self.ids, self.x, self.flat = ids[order], x[order], flat[order]
        self.keys, self.starts, self.counts = np.unique(keys[order], return_index=True, return_counts=True)


def _pairs(data: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame | None:
    """``query_id``, ``vec_id``, ``score`` of each query's ``k`` best in each part, and ``met``, how many rows it met there (in one of its rows)."""
    spark = data.sparkSession
    kind = element(vec_col, data, queries)
    rows, asked = cut(valid(data, id_col, vec_col, nonzero=True, kind=kind)), cut(one_row_per_id(valid(queries, id_col, vec_col, nonzero=True, kind=kind)))
    count, dim = rows.select(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(dim or 0, asked.select(F.max(F.size("vec"))).first()[0] or 0)
    if not count or not dim:
        return None
    found = calibrate(rows, asked, count, k, dim)
    h, n = found.h, found.probes
    parts = int(np.ceil(count / PART))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column(0), dim))
            for t in range(h.tables):
                keys, counts = np.unique(h.keys(t, x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(counts)], ["t", "key", "n"])

    sizes = cut(rows.select("vec").mapInArrow(bucket, "t int, key long, n long").groupBy("t", "key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT))
    hot = HOT
    while sizes.where(F.col("n") > hot).count() > MOST_HOT:
        hot *= 2
    split = {t: (g["key"].to_numpy(), np.ceil(g["n"].to_numpy() / hot).astype(np.int64)) for t, g in sizes.where(F.col("n") > hot).orderBy("t", "key").toPandas().groupby("t")}
    shared = spark.sparkContext.broadcast(split)  # at most MOST_HOT keys and counts

    def salts(t: int, keys: np.ndarray) -> np.ndarray:
        if t not in shared.value:
            return np.ones(keys.shape, np.int64)
        known, many = shared.value[t]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, many[at], 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), unit(matrix(b.column(1), dim))
            for t in range(h.tables):
                keys = h.keys(t, x)
                part = part_of(keys, salt_of(ids, salts(t, keys)), parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(part), pa.array(np.zeros(len(ids), bool)), *b.columns], ["t", "part", "asks", "id", "vec"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, QUERY_BLOCK):
                c = b.slice(s, QUERY_BLOCK)
                x = unit(matrix(c.column(1), dim))
                for t in range(h.tables):
                    keys = h.probes(t, x, n)
                    many = salts(t, keys)
                    where = [part_of(keys[r, at], np.full(len(r), salt), parts).astype(np.int64) + r * parts for salt in range(int(min(many.max(), parts))) for r, at in [np.nonzero(many > salt)]]
                    r, part = np.divmod(np.unique(np.concatenate(where)), parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), t, np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(r), bool)), *(v.take(pa.array(r)) for v in c.columns)], ["t", "part", "asks", "id", "vec"])

    def answer(t: int, p: int, part: Part, asker: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        probed = h.probes(t, unit(own), n)
        # Only probes of buckets that this part may hold are looked up.
        here = (p - part_of(probed, np.zeros(1, np.int64), parts)) % parts < salts(t, probed)
        q, wanted = np.nonzero(here)[0], probed[here]
        at = np.minimum(np.searchsorted(part.keys, wanted), len(part.keys) - 1)
        found = part.keys[at] == wanted
        q, bucket = np.divmod(np.unique(q[found] * len(part.keys) + at[found]), len(part.keys))
        row, col = _meet(q, bucket, part.starts, part.counts)
        other = asker[row] != part.ids[col]
        row, col = row[other], col[other]
        met = np.bincount(row, minlength=len(own))
        if len(row) > DENSE * len(own) * len(part.ids):
            scores = np.full((len(own), len(part.ids)), -np.inf)
            scores[row, col] = (unit(own) @ part.flat.T)[row, col]
            r, c, v = best(scores, part.ids, k, NEAR, lambda r, c: cosine(own[r], part.x[c]))
        else:
            v = np.concatenate([np.zeros(0), *(cosine(own[row[i : i + PAIRS]], part.x[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS))])
            order = np.lexsort((part.ids[col], -v, row))
            row, col, v = row[order], col[order], v[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            r, c, v = row[keep], col[keep], v[keep]
        first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(asker[r]), pa.array(part.ids[c]), pa.array(v), pa.array(np.where(first, met[r], 0))], ["query_id", "vec_id", "score", "met"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, its data first: a part's data are held, its queries pass by in blocks."""
        key, held, part = None, [], None
        for b in batches:
            t, p, asks, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (asks[1:] != asks[:-1]), True]) if len(t) else []
            for i, j in zip(edges[:-1], edges[1:], strict=False):
                if key != (t[i], p[i]):
                    key, held, part = (t[i], p[i]), [], None
                if not asks[i]:
                    held.append((ids[i:j], matrix(b.column(4).slice(i, j - i), dim)))
                    continue
                if held and part is None:
                    part = Part(h, int(t[i]), *(np.concatenate(z) for z in zip(*held, strict=True)))
                for s in range(i, j if held else i, QUERY_BLOCK):
                    e = min(j, s + QUERY_BLOCK)
                    yield answer(int(t[i]), int(p[i]), part, ids[s:e], matrix(b.column(4).slice(s, e - s), dim))

    cells = f"t int, part int, asks boolean, id long, vec array<{kind}>"
    dealt = rows.mapInArrow(place, cells).union(asked.mapInArrow(ask, cells)).repartition("t", "part").sortWithinPartitions("t", "part", "asks")
    return dealt.mapInArrow(solve, "query_id long, vec_id long, score double, met long")


def search(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` of largest cosine that each query's probes find.

    Recall is held on a sample: the buckets are made so large, and so many are looked into, that at most SAMPLE queries find RECALL of their true neighbours,
    however many rows there are (``calibrate``); of all queries it then differs from that by chance only, about 0.02 with 200 queries of five.
    Scores are exact cosines of the original vectors. Ties go to the smaller id; a candidate with the query's own
    id is none. Null ids and vectors that are null, zero or hold a null or non-finite component take no part. Shorter
    vectors are filled up with zeros. Repeated rows of ``data`` are one candidate; a repeated query id is asked once, by its
    smallest vector. No valid row gives an empty result.
    """
    found = _pairs(data, queries, k, id_col, vec_col)
    if found is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return rank(found.select("query_id", "vec_id", "score").distinct(), k)  # several tables find the same pair


def meetings(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id`` and ``met``: how many rows each query of ``search`` meets in its buckets, over all tables, repeats counted."""
    found = _pairs(data, queries, k, id_col, vec_col)
    if found is None:
        return data.sparkSession.createDataFrame([], "query_id long, met long")
    return found.groupBy("query_id").agg(F.sum("met").alias("met"))
