import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import int8_join, vp_search
from parlance.llm.common import components

from .helpers import SF, clashing


def vectors(n=260, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 4):  # near and exact copies, and scaled ones
        base[i] = base[(i * 7 + 1) % n] + rng.normal(size=dim) * rng.choice([0.0, 0.15, 0.35])
    base[5:40] = base[5]
    base[41] = 3 * base[5]
    return base


def table(spark, x):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 0), (1001, [0.0] * x.shape[1], 0), (1002, [1.0, None], 0), (1003, [nan] * x.shape[1], 0), (1004, [inf] * x.shape[1], 0), (1020, [1.0, 2.0], 0), (1005, [], 0), (None, [1.0] * x.shape[1], 0), (20, [float(v) for v in x[20]], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")


def brute_links(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    low = np.array(ids)
    while True:
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(low))])
        if (new == low).all():
            return near.sum(1), low
        low = new


@pytest.mark.parametrize("block", [8192, 60])
def test_links_equal_brute_force(spark, block):
    x = vectors()
    df = table(spark, x)
    got = {}
    for r in int8_join.link(clashing(df), block=block).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    ids, full = [*range(len(x)), 20], np.vstack([x, x[20]])
    n, low = brute_links(ids, full, 0.9)
    for i, k, c in zip(ids, n.tolist(), low.tolist()):
        assert got[i][0] == (k, c, i == c)
    assert len(got[20]) == 2 and got[20][0] == got[20][1]
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1020):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(0, None, False)]
    assert int8_join.link(df.limit(0)).count() == 0


def test_error_bounds_hold():
    x = vectors(400, 1500, 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, norm, err = int8_join.quantise(x)
    near = int8_join.int8_products(code, code) * scale[:, None] * scale[None, :]
    assert (np.abs(near - u @ u.T) <= norm[:, None] * err[None, :] + err[:, None] * (norm + err)[None, :] + int8_join.SLACK).all()
    assert (int8_join.int8_products(code, code) == code.astype(np.int64) @ code.astype(np.int64).T).all()


@pytest.mark.parametrize("shard,block", [(8192, 1024), (70, 5)])
def test_exact_search_equals_brute_force(spark, shard, block):
    x = vectors()
    df = table(spark, x)
    got = {}
    for r in vp_search.nearest(clashing(df), F.col("vec_id") % 20 == 0, k=7, shard=shard, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    for q, found in got.items():
        s = vp_search.scores(np.tile(x[q], (len(x), 1)), x)
        expect = sorted((-v, i) for i, v in enumerate(s.tolist()) if i != q)[:7]
        assert found == [(i, -v) for v, i in expect]
    assert vp_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_candidates_and_recall(spark):
    few = vp_search.nearest(table(spark, vectors()).where("vec_id IN (0, 1, 2, 1001, 1020)"), F.lit(True), k=20)
    assert few.where("query_id = 1").count() == 2  # itself and other lengths are no candidates
    x = vectors(3000, 16, 9)
    t = vp_search.build(x, list(range(len(x))))
    q = x[::50]
    truth = [set(np.argsort(-(x @ v), kind="stable")[:10].tolist()) for v in q]
    seen = []
    for factor in (1.0, 1.5, 4.0):
        a, b = vp_search.search(t, q, 10, factor)
        seen.append(vp_search.search.visited)
        hit = [len({t.ids[r] for r in b[a == i]} & truth[i]) / 10 for i in range(len(q))]
        if factor == 1.0:
            assert min(hit) >= 0.9  # ties may stand for each other
    assert seen[0] > seen[1] > seen[2]  # relaxed pruning skips more


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (40, 4)], "a long, b long")
    assert sorted(map(tuple, components(e).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7), (40, 1)]
    assert components(e.limit(0)).count() == 0


def test_query_covers_the_table(spark):
    from parlance.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert QUERIES["op2_int8_neardup"](spark, SF).count() == n
    assert QUERIES["op3_vp_search"](spark, SF).groupBy("query_id").count().where("count <> 20").count() == 0
