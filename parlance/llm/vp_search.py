"""Nearest neighbours by inner product with a vantage-point tree per shard."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import ship, written
from parlance.llm.vectors import classes, keyed, matrix

SHARD = 8192  # vectors of a tree
QUERIES = 1024  # queries of a block
LEAF = 128


@dataclass
class Tree:
    """Vectors in leaf order. ``nodes``: (vantage point, inside child, outside
    child, range of distances inside, range outside), or (from, to) of a leaf.

    The inner product becomes a distance by one more coordinate that gives
    all vectors the length of the longest; a query has 0 there."""

    ids: list
    x: np.ndarray
    top: float
    extra: np.ndarray
    nodes: list


def build(x: np.ndarray, ids: list, leaf: int = LEAF, seed: int = 5) -> Tree:
    """Vantage points are drawn by ``seed``; each splits its set at the median
    distance."""
    sq = np.einsum("ij,ij->i", x, x)
    top = float(sq.max())
    extra = np.sqrt(np.maximum(top - sq, 0.0))
    rng = np.random.default_rng(seed)
    order, nodes, at = [], [], 0
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][1 + side] = me
        if len(rows) > leaf:
            v = int(rows[rng.integers(len(rows))])
            d = np.sqrt(np.maximum(((x[rows] - x[v]) ** 2).sum(1) + (extra[rows] - extra[v]) ** 2, 0.0))
            mid = np.median(d)
            near = d <= mid
            if not near.all():
                nodes.append([v, -1, -1, (float(d[near].min()), float(d[near].max())), (float(d[~near].min()), float(d[~near].max()))])
                stack += [(rows[~near], me, 1), (rows[near], me, 0)]
                continue
        nodes.append([at, at + len(rows)])
        order.append(rows)
        at += len(rows)
    order = np.concatenate(order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for n in nodes:
        if len(n) == 5:
            n[0] = int(place[n[0]])
    return Tree([ids[i] for i in order], x[order], top, extra[order], nodes)


def search(tree: Tree, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that hold the ``k`` rows of largest inner product of
    every query, and what ties with the last within rounding.

    All queries go down together; at a node each goes first to the side it
    lies on, and to the other side only if a point there could still be near
    enough: the triangle inequality bounds its distance from below, and
    ``factor`` x bound is held against the distance of the k-th row so far.
    1 is exact; larger factors skip more.
    """
    qn = np.einsum("ij,ij->i", q, q)
    slack = 1e-9 * (1.0 + tree.top + qn)
    kth = np.full(len(q), -np.inf)
    best_q, best_r, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    visited = 0

    def leaf(lo: int, hi: int, who: np.ndarray) -> None:
        nonlocal best_q, best_r, best_s, visited
        visited += len(who) * (hi - lo)
        s = q[who] @ tree.x[lo:hi].T
        a, b = np.nonzero(s >= (kth - slack)[who, None])
        if not len(a):
            return
        fresh = np.zeros(len(q), bool)
        fresh[who[np.unique(a)]] = True
        old = fresh[best_q]
        cq, cr, cs = np.concatenate([best_q[old], who[a]]), np.concatenate([best_r[old], b + lo]), np.concatenate([best_s[old], s[a, b]])
        o = np.lexsort((-cs, cq))
        cq, cr, cs = cq[o], cr[o], cs[o]
        start = np.searchsorted(cq, cq, "left")
        rank = np.arange(len(cq)) - start
        last = np.flatnonzero(rank == k - 1)
        kth[cq[last]] = cs[last]
        keep = cs >= (kth - slack)[cq]
        best_q, best_r, best_s = np.concatenate([best_q[~old], cq[keep]]), np.concatenate([best_r[~old], cr[keep]]), np.concatenate([best_s[~old], cs[keep]])

    def bound(d: np.ndarray, lo: float, hi: float) -> np.ndarray:
        return np.maximum(np.maximum(lo - d, d - hi), 0.0)

    stack = [(0, np.arange(len(q)), None)]
    while stack:
        node, who, lower = stack.pop()
        if lower is not None:
            reach = np.sqrt(np.maximum(qn[who] + tree.top - 2 * kth[who], 0.0))
            open_ = ~(factor * lower > reach + np.sqrt(slack[who]))
            who = who[open_]
        if not len(who):
            continue
        n = tree.nodes[node]
        if len(n) == 2:
            leaf(n[0], n[1], who)
            continue
        v, inside, outside, (ilo, ihi), (olo, ohi) = n
        d = np.sqrt(np.maximum(((q[who] - tree.x[v]) ** 2).sum(1) + tree.extra[v] ** 2, 0.0))
        first = d <= (ihi + olo) / 2
        to_in, to_out = bound(d, ilo, ihi), bound(d, olo, ohi)
        stack += [(inside, who[~first], to_in[~first]), (outside, who[first], to_out[first]), (outside, who[~first], to_out[~first]), (inside, who[first], to_in[first])]
    search.visited = visited
    return best_q, best_r


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component to the last."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s = s + x[:, d] * y[:, d]
    return s


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 1.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k``
    rows of largest inner product of each query row, nearest first, ties to
    the smaller id; a row is no neighbour of a row with its own id.

    Equal vectors are one class that keeps its k + 1 smallest ids (no query
    can return more of them), so copies do not swell a tree. Classes are
    dealt to shards, queries to blocks; every (shard, block) is one group,
    and each group returns at most k rows per query.

    Null, zero, partly null or non-finite vectors and null ids take no part;
    vectors of another length than the query are no candidates; a query id
    on several rows with different vectors is answered for each vector
    together (the best k of all); an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    rows = keyed(df, id_col, vec_col).where("key IS NOT NULL")
    own = written(classes(rows, k + 1), "vectors")
    asked = written(rows.where(queries).select("id", "vec"), "queries")
    n_shards, n_blocks = max(1, -(-own.count() // shard)), max(1, -(-asked.count() // block))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = {int(w): build(matrix(g.vec), [np.asarray(i, np.int64) for i in g.ids]) for w, g in pdf.sort_values("rep").groupby(pdf.vec.map(len))}
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "data": [pickle.dumps(trees)]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = {int(w): (g.id.to_numpy(), matrix(g.vec)) for w, g in pdf.groupby(pdf.vec.map(len))}
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "data": [pickle.dumps(sets)]})

    trees = written(own.withColumn("shard", F.expr(f"pmod(xxhash64(rep), {n_shards})").cast("int")).groupBy("shard").applyInPandas(plant, "shard int, data binary"), "trees")
    blocks = written(asked.withColumn("block", F.expr(f"pmod(xxhash64(id), {n_blocks})").cast("int")).groupBy("block").applyInPandas(pack, "block int, data binary"), "blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = trees.select("shard", upto(n_blocks).alias("block"), "data", F.lit(True).alias("tree")).union(blocks.select(upto(n_shards).alias("shard"), "block", "data", F.lit(False).alias("tree")))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if pdf.tree.nunique() == 2:
            trees_, sets = pickle.loads(pdf.data[pdf.tree].iloc[0]), pickle.loads(pdf.data[~pdf.tree].iloc[0])
            for width, (ids, q) in sets.items():
                if width not in trees_:
                    continue
                t = trees_[width]
                a, b = search(t, q, k + 1, factor)
                s = scores(q[a], t.x[b])
                n = np.array([len(t.ids[r]) for r in b], np.int64)
                got = pd.DataFrame({"query_id": np.repeat(ids[a], n), "vec_id": np.concatenate([t.ids[r] for r in b] or [np.zeros(0, np.int64)]), "score": np.repeat(s, n)})
                got = got[got.query_id != got.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(got.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k))
        return pd.concat(out)

    found = both.groupBy("shard", "block").applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
