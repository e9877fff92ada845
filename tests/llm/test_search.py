"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import knn_voronoi, lsh_multiprobe
from tracelake.llm.queries import QUERIES
from tracelake.llm.vectors import best, once

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def exact(rows, queries, k, score):
    out = []
    for q, v in queries:
        s = sorted({(-score(v, x), i) for i, x in rows if i != q})[:k]
        out += [(q, r, i, -m) for r, (m, i) in enumerate(s, 1)]
    return sorted(out)


def dot(a, b):
    n = max(len(a), len(b))
    a, b = (np.floor(1024 * np.array([*v, *[0] * (n - len(v))], float)) for v in (a, b))
    return int(a @ b)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


def vectors(n, dim=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[5:40] = x[4]  # a group of equal vectors
    return [(i, [float(v) for v in x[i]]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


ODD = [(1001, None), (1002, [float("nan")] * 8), (1003, [float("inf"), *[0.0] * 7]), (1004, [None, *[1.0] * 7]), (None, [1.0] * 8)]


def test_voronoi_is_exact(spark):
    rows = vectors(700)
    data = frame(spark, rows + ODD)
    got = knn_voronoi.search(data, data.where("vec_id % 10 = 0 or vec_id > 1000"), 5)
    assert sorted(map(tuple, got.collect())) == exact(rows, [r for r in rows if r[0] % 10 == 0], 5, dot)


def test_voronoi_edges(spark):
    rows = [(1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0, 0.25, 2.0]), (4, [0.0, 0.0])]
    data = frame(spark, rows)
    assert sorted(map(tuple, knn_voronoi.search(data, data, 10).collect())) == exact(rows, {1: rows[0][1], 2: rows[1][1], 3: rows[3][1], 4: rows[4][1]}.items(), 10, dot)
    for empty in (data.limit(0), frame(spark, ODD)):
        assert knn_voronoi.search(empty, empty).collect() == [] == lsh_multiprobe.search(empty, empty).collect()
    assert knn_voronoi.search(data, data.limit(0)).collect() == []


@pytest.mark.parametrize("shift", [0.0, 0.001])
def test_voronoi_with_repeated_rows(spark, shift):
    r = np.random.default_rng(7)
    near = [(i, [10.0 + 0.01 * i, 0.0, 0.0]) for i in range(1, 6)]
    far = [(i, [float(v) for v in np.float32([-10, 0, 0] + r.standard_normal(3))]) for i in range(100, 140)]
    # With a shift the copies of an id are vectors of their own: the query's own id takes several places among the nearest.
    own = [(1, [10.01 + j * shift, 0.0, 0.0]) for j in range(15)]
    data = frame(spark, near * 3 + far + own)
    query = near[0]
    want = exact({(i, tuple(v)) for i, v in near + far}, [query], 10, dot)
    got = knn_voronoi.search(data, frame(spark, [query]), 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 10


def test_rings_lose_nothing():
    r = np.random.default_rng(1)
    p, q, x, k = r.standard_normal((9, 4)), r.standard_normal((30, 4)), r.standard_normal((400, 4)), 3
    dist = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    cq, cx = dist(q, p).argmin(1), dist(x, p).argmin(1)
    dq, dx = dist(q, p).min(1), dist(x, p).min(1)
    reach = np.array([dq[cq == i].max(initial=-1) for i in range(9)])
    low, high = knn_voronoi.rings(dist(p, p), reach, [sorted(dx[cx == j])[: k + 1] for j in range(9)], k, 1e-9)
    for i in range(30):
        for j in dist(q, x)[i].argsort()[:k]:
            assert low[cq[i], cx[j]] <= dx[j] <= high[cq[i], cx[j]]
    assert (high - low).min() < 8


def test_multiprobe_recall_and_scores(spark):
    rows = vectors(1500, 16, 2)
    data = frame(spark, [*rows, *ODD, (1005, [0.0] * 16)])
    got = [tuple(r) for r in lsh_multiprobe.search(data, data.where("vec_id % 10 = 0"), 5).collect()]
    want = exact(rows, [r for r in rows if r[0] % 10 == 0], 5, cosine)
    by = {(q, i): s for q, _, i, s in want}
    assert len(got) == len(want) and sum((q, i) in by for q, _, i, _ in got) >= 0.9 * len(want)
    at = dict(rows)
    assert all(s == cosine(at[q], at[i]) for q, _, i, s in got)
    assert sorted((q, r) for q, r, *_ in got) == sorted((q, r) for q, r, *_ in want)


def test_multiprobe_splits_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(lsh_multiprobe, "HOT", 20)
    monkeypatch.setattr(lsh_multiprobe, "PART", 100)
    rows = vectors(600, 8, 3)
    data = frame(spark, rows)
    got = sorted(map(tuple, lsh_multiprobe.search(data, data.where("vec_id in (4, 6, 39)"), 5).collect()))
    assert [(q, r, i) for q, r, i, _ in got] == [(4, r, i) for r, i in zip(range(1, 6), (5, 6, 7, 8, 9), strict=True)] + [(6, r, i) for r, i in zip(range(1, 6), (4, 5, 7, 8, 9), strict=True)] + [(39, r, i) for r, i in zip(range(1, 6), (4, 5, 6, 7, 8), strict=True)]


def test_probe_order():
    sets = lsh_multiprobe.probe_sets(3, 100)
    assert sets[:2] == [(), (0,)] and len(sets) == len(set(sets)) == 27
    h = lsh_multiprobe.Hashes(6)
    x = lsh_multiprobe.unit(np.random.default_rng(0).standard_normal((5, 6)))
    assert (h.probes(0, x, 1)[:, 0] == h.keys(0, x)).all() and len(set(h.probes(0, x, 500)[0])) == 500


def test_best_and_once():
    r, c, v = best(np.array([[1.0, 3, 3, -np.inf]]), np.array([9, 8, 7, 6]), 2)
    assert (r.tolist(), c.tolist(), v.tolist()) == ([0, 0], [2, 1], [3, 3])
    ids, x = once(np.array([1, 1, 1]), np.array([[1.0], [1.0], [2.0]]))
    assert len(ids) == 2 == len(x)


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op4_multiprobe_lsh"])
def test_queries_on_the_tables(spark, data, name):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES[name](spark, data)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint" if name[2] == "1" else "double"]
    got = sorted(map(tuple, got.collect()))
    want = exact(rows, [r for r in rows if r[0] % (100 if name[2] == "1" else 50) == 0], 10 if name[2] == "1" else 5, dot if name[2] == "1" else cosine)
    if name[2] == "1":
        assert got == want
    else:
        assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_one_cell_of_all_queries_is_cut(spark, monkeypatch):
    monkeypatch.setattr(knn_voronoi, "GROUP", 20)
    shared, first, parts = knn_voronoi.groups([3, 200, 0, 15, 9], np.arange(5.0))
    assert parts == [1, 13, 1, 1, 1] and [c for c, _ in shared] == [[0, 3], [1], [4]] and sorted(g for _, n in shared for g in n) == list(range(15))
    assert [first[i] for i in (0, 1, 3, 4)] == [shared[0][1][0], shared[1][1][0], shared[0][1][0], shared[2][1][0]]
    rows = vectors(300) + [(1000 + i, [0.5] * 8) for i in range(120)]
    data = frame(spark, rows)
    got = knn_voronoi.search(data, data.where("vec_id >= 1000"), 4)  # equal queries: one cell
    assert sorted(map(tuple, got.collect())) == exact(rows, [r for r in rows if r[0] >= 1000], 4, dot)


def test_queries_go_to_the_chunks_that_their_rings_reach(spark, monkeypatch):
    assert knn_voronoi.joined([(4, 5), (0, 1), (2, 2), (5, 9), (12, 12)]) == [(0, 2), (4, 9), (12, 12)] and knn_voronoi.joined([]) == []
    r = np.random.default_rng(11)
    # Clusters far from each other, one with a third of the rows, copies, and an id with many vectors.
    heart = [(200.0 * np.eye(6)[i % 6] * (1 + i // 6)).tolist() for i in range(12)]
    rows = [(i, [float(v) for v in np.float32(np.array(heart[i % 12 if i % 3 else 5]) + r.standard_normal(6))]) for i in range(900)]
    rows += [(5000 + i, rows[5][1]) for i in range(60)] + [(7000, [float(v) for v in np.float32(np.array(heart[1]) + r.standard_normal(6))]) for _ in range(150)]
    data = frame(spark, rows)
    monkeypatch.setattr(knn_voronoi, "CHUNK", 50)
    monkeypatch.setattr(knn_voronoi, "GROUP", 20)
    sent, plain = [], knn_voronoi.joined
    monkeypatch.setattr(knn_voronoi, "joined", lambda runs: sent.append(runs) or plain(runs))
    got = knn_voronoi.search(data, data.where("vec_id % 10 = 0 and vec_id < 5000"), 4)
    assert sorted(map(tuple, got.collect())) == exact(rows, [x for x in rows if x[0] % 10 == 0 and x[0] < 5000], 4, dot)
    chunks = max(b for runs in sent for _, b in runs) + 1
    assert chunks >= 21 and sum(b - a + 1 for runs in sent for a, b in runs) < 0.7 * chunks * len(sent)


def test_inner_products_beyond_doubles(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(v) for v in r.integers(-(1 << 19), 1 << 19, 4) + r.random(4)]) for i in range(60)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    exactly = lambda a, b: sum(int(np.floor(1024 * x)) * int(np.floor(1024 * y)) for x, y in zip(a, b, strict=True))
    got = [tuple(x) for x in knn_voronoi.search(data, data.where("vec_id < 20"), 5).collect()]
    assert sorted(got) == exact(rows, rows[:20], 5, exactly) and max(abs(s) for *_, s in got) > 2**53
    with pytest.raises(ValueError, match="long"):
        knn_voronoi.search(spark.createDataFrame([(1, [1e200]), (2, [1e200])], data.schema), data)


def test_cosines_of_very_large_and_small_vectors(spark):
    rows = [(1, [3e200, 4e200]), (2, [3e-200, 4e-200]), (3, [4.0, -3.0]), (4, [3.0, 4.0])]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = lsh_multiprobe.search(data, data, 3).collect()
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got if r["query_id"] == 1} == pytest.approx({(1, 2): 1.0, (1, 4): 1.0, (1, 3): 0.0})


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_both_ways_of_a_part_agree(spark, monkeypatch, dense):
    monkeypatch.setattr(lsh_multiprobe, "DENSE", dense)
    rows = vectors(400, 8, 6)
    data = frame(spark, rows)
    got = sorted(tuple(r) for r in lsh_multiprobe.search(data, data.where("vec_id % 7 = 0"), 5).collect())
    want = exact(rows, [r for r in rows if r[0] % 7 == 0], 5, cosine)
    assert len({r[:3] for r in got} & {r[:3] for r in want}) >= 0.9 * len(want) and len(got) == len(want)


def test_candidates_grow_slower_than_the_table(spark):
    share, found = {}, {}
    for name in ("sf0.01", "sf0.1"):
        data = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
        asked = data.where("vec_id % 50 = 0")
        share[name] = lsh_multiprobe.meetings(data, asked).agg(F.avg("met")).first()[0] / data.count()
        rows = [(r[0], r[1]) for r in data.select("vec_id", "embedding").collect()]
        want = {(q, i) for q, _, i, _ in exact(rows, [r for r in rows if r[0] % 50 == 0], 5, cosine)}
        found[name] = len(want & {(r[0], r[2]) for r in lsh_multiprobe.search(data, asked).collect()}) / len(want)
    assert share["sf0.1"] < 0.95 * share["sf0.01"] and min(found.values()) >= 0.9


def test_recall_holds_where_probes_are_too_few(spark, monkeypatch):
    import numpy as np

    from tracelake.llm import lsh_multiprobe as lsh

    real = lsh.probe_sets
    monkeypatch.setattr(lsh, "probe_sets", lambda hashes, limit=20: real(hashes, 20))
    x = np.random.default_rng(3).standard_normal((1_500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[::10] @ u.T
    s[np.arange(150), np.arange(0, 1_500, 10)] = -9
    true = {(10 * q, int(j)) for q, row in enumerate(s) for j in np.argsort(-row, kind="stable")[:5]}
    for hashes in (30, 0):
        monkeypatch.setattr(lsh, "hashes_for", lambda count, n=hashes: n)
        found = lsh.calibrate(lsh.valid(df, "vec_id", "embedding", nonzero=True, kind="double"), lsh.valid(asked, "vec_id", "embedding", nonzero=True, kind="double"), 1_500, 5, 24)
        assert found.recall >= lsh.RECALL and (found.h.hashes < 30)
        got = {(r["query_id"], r["vec_id"]) for r in lsh.search(df, asked, 5).collect()}
        assert len(got & true) / len(true) >= (0.9 if hashes else 1.0)
