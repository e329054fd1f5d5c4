import numpy as np
import pytest
from folioforge.llm import multiindex as mi


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 16))
    x[100:160] = x[100]  # copies tie
    ids = np.arange(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = mi.search(df, df.where("vec_id % 100 = 0"), least=500, centroids=8).collect()
    hits = 0
    for q in range(0, 6000, 100):
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        true = brute(ids, x, q)
        hits += len({i for i, _ in true} & {g[1] for g in got})
        assert [g[0] for g in got] == list(range(1, 11)) and [g[2] for g in got] == sorted(g[2] for g in got)
        assert all(abs(g[2] - np.sqrt(((x[g[1]] - x[q]) ** 2).sum())) < 1e-12 for g in got)
    assert hits / 600 >= 0.9
    assert sorted(r.vec_id for r in found if r.query_id == 100) == list(range(101, 111))
    every = mi.search(df, df.where("vec_id % 1000 = 0"), share=1.0, centroids=8).collect()
    assert all([(r.vec_id) for r in sorted(every, key=lambda r: r.rank) if r.query_id == q] == [i for i, _ in brute(ids, x, q)] for q in range(0, 6000, 1000))


def test_small_parts_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 6)))], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 9 = 0")
    a, b = (sorted(map(tuple, mi.search(df, q, centroids=4, least=200, share=0.3, **k).collect())) for k in ({}, {"entry_block": 50, "query_block": 13}))
    assert a == b and len(a) == 1000


def test_near_vectors_of_large_norm():
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(size=(500, 8)) * 1e-3
    ids = np.arange(500)
    found = mi.nearest_in_block(ids, x, np.zeros(500, int), ids[:20], x[:20], np.ones((20, 1), bool), 10)
    for q in range(20):
        assert [j for i, j in zip(found[0], found[1]) if i == q] == [i for i, _ in brute(ids, x, q)]


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_of_the_defaults_on_embeddings(spark, name):
    rows = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].to_pylist(), np.float64)
    found = {}
    for r in mi.op7_multi_index(spark, f"/root/testdata/{name}").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    true = {int(q): {i for i, _ in brute(ids, x, q)} for q in ids[ids % 100 == 0]}
    recall = sum(len(found[q] & t) for q, t in true.items()) / (10 * len(true))
    print(f"recall on {len(ids)} vectors: {recall:.4f}")
    assert found.keys() == true.keys() and recall >= 0.9


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(1)
    index = mi.MultiIndex(rng.normal(size=(5, 2)), rng.normal(size=(7, 3)), np.ones(35, int))
    q = rng.normal(size=5)
    sums = (mi.squared(q[None, :2], index.first)[0][:, None] + mi.squared(q[None, 2:], index.second)[0]).ravel()
    seen = index.visit(q, 35)
    assert sorted(seen) == list(range(35)) and (np.diff(sums[seen]) >= 0).all()
    assert len(index.visit(q, 4)) == 4


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 1.0]), (2, None), (3, [0.0] * 4), (4, [None, 1.0, 1.0, 1.0]), (5, [nan, 1.0, 1.0, 1.0]), (6, [inf, 1.0, 1.0, 1.0]), (7, [1.0, 2.0]), (None, [1.0] * 4), (8, [1.0, 0.0, 0.0, 1.0]), (8, [1.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, score int")
    found = mi.search(df, df.where("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, 1.0), (2, 8, 1.0), (3, 8, 1.0)]
    assert mi.search(df, df.where("vec_id = 7")).count() == 0  # the only one of its length
    more = df.unionByName(spark.createDataFrame([(9, [1.0, 4.0]), (10, [3.0]), (11, [5.0]), (12, [3.5])], "vec_id long, embedding array<double>"), allowMissingColumns=True)
    found = mi.search(more, more.where("vec_id IN (0, 7, 10)")).collect()
    assert [(r.vec_id, r.score) for r in found if r.query_id == 7] == [(9, 2.0)]
    assert [(r.vec_id, r.score) for r in found if r.query_id == 10] == [(12, 0.5), (11, 2.0)]
    assert [r.vec_id for r in found if r.query_id == 0] == [1, 8, 8]
    assert mi.search(df.limit(0), df.limit(0)).count() == 0
    assert mi.search(df, df.limit(0)).count() == 0


def test_many_lengths(spark):
    rows = [(100 * n + i, [float(i + j) for j in range(n)]) for n in range(1, 12) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mi.search(df, df.where("vec_id % 100 = 1")).collect()
    assert sorted({r.query_id for r in found}) == [100 * n + 1 for n in range(1, 12)]
    assert all(r.vec_id // 100 == r.query_id // 100 for r in found) and len(found) == 22 - sum(1 for n in range(1, 12) if all(x == 0 for x in rows[3 * (n - 1)][1]))
