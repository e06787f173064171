"""Near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import components, ship, written
from parlance.llm.vectors import classes, keyed, matrix

THRESHOLD = 0.9
BLOCK = 8192  # vectors of a block; a task holds two blocks
TILE = 1024
# Rounding of the float32 product of scales and integer sums, far below this.
SLACK = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of the unit vectors, their scales, the norms of the decoded
    vectors, and the norms of the errors, all per vector."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(1) / 127.0
    code = np.rint(u / scale[:, None]).astype(np.int8)
    back = code * scale[:, None]
    return code, scale, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1) * (1 + 1e-9) + 1e-12


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer dot products: float32 holds sums of up to 1024 products
    of int8 codes without rounding, so wider vectors go in slices."""
    out = a[:, :1024].astype(np.float32) @ b[:, :1024].astype(np.float32).T
    if a.shape[1] > 1024:
        out = out.astype(np.float64)
        for lo in range(1024, a.shape[1], 1024):
            out += a[:, lo : lo + 1024].astype(np.float32) @ b[:, lo : lo + 1024].astype(np.float32).T
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def tile_links(a: dict, b: dict, same: bool, threshold: float):
    """Pairs (row of a, row of b) with cosine >= threshold, in parts. With e
    the error norms and r the norms of the decoded vectors, the true cosine
    is within r_a e_b + e_a r_b + e_a e_b of the product of the codes; only
    pairs that this could lift to the threshold are computed in full."""
    for i in range(0, len(a["id"]), TILE):
        for j in range(i if same else 0, len(b["id"]), TILE):
            s, t = slice(i, i + TILE), slice(j, j + TILE)
            near = int8_products(a["code"][s], b["code"][t]) * (a["scale"][s, None] * b["scale"][None, t]).astype(np.float32)
            bound = a["norm"][s, None] * b["err"][None, t] + a["err"][s, None] * (b["norm"] + b["err"])[None, t]
            p, q = np.nonzero(near >= threshold - bound - SLACK)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            for lo in range(0, len(p), 100_000):
                pp, qq = p[lo : lo + 100_000], q[lo : lo + 100_000]
                ok = cosines(a["vec"][pp], b["vec"][qq]) >= threshold
                yield pp[ok], qq[ok]


def roots(n: int, p: np.ndarray, q: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest row connected to each row by the links (p, q)."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector: ``n_links`` (others with cosine >= threshold), ``component_id``
    (smallest id reachable by links) and ``kept`` (id = component_id).

    Equal vectors are one class with a multiplicity: copies, however many,
    are compared once, and their links are counted by multiplicity. Classes
    are dealt into blocks; each pair of blocks is one group of one task, and
    gives per class a link count and one link to the smallest class that it
    is connected to there, never its pairs.

    Null, zero, partly null or non-finite vectors link with nothing and are
    their own component, as are vectors of another length than all others;
    rows with equal ids are vectors each; a null id links with nothing and
    has no component (``kept`` false). Other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    rows = keyed(df, id_col, vec_col)
    own = written(classes(rows, 0), "vectors")
    n_blocks = max(1, -(-own.count() // block))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for width, g in pdf.groupby(pdf.vec.map(len)):
            g = g.sort_values("rep")
            x = matrix(g.vec)
            code, scale, norm, err = quantise(x)
            parts.append((width, {"id": g.rep.to_numpy(), "n": g.n.to_numpy(), "vec": x.astype(np.float32) if np.array_equal(x, x.astype(np.float32)) else x, "code": code, "scale": scale, "norm": norm, "err": err}))
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "data": [pickle.dumps(parts)]})

    dealt = own.withColumn("block", F.expr(f"pmod(xxhash64(rep), {n_blocks})").cast("int"))
    blocks = written(dealt.groupBy("block").applyInPandas(pack, "block int, data binary"), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    pairs = blocks.select("block", "data", other).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "data")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        by = {int(b): dict(pickle.loads(d)) for b, d in zip(pdf.block, pdf.data)}
        out = []
        for width in by.get(first, {}):
            if width not in by.get(second, {}):
                continue
            a, b = by[first][width], by[second][width]
            a = {**a, "vec": a["vec"].astype(np.float64)}
            b = a if first == second else {**b, "vec": b["vec"].astype(np.float64)}
            n, shift = len(a["id"]), 0 if first == second else len(a["id"])
            ids = a["id"] if first == second else np.concatenate([a["id"], b["id"]])
            copies = a["n"] if first == second else np.concatenate([a["n"], b["n"]])
            links, label = np.zeros(len(ids)), np.arange(len(ids))
            for p, q in tile_links(a, b, first == second, threshold):
                q = q + shift
                links += np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))
                label = roots(len(ids), p, q, label)
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            hit = links > 0
            out.append(pd.DataFrame({"v": ids[hit], "links": links[hit].astype(np.int64), "root": low[label][hit]}))
        return pd.concat(out) if out else pd.DataFrame({"v": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})

    found = written(pairs.groupBy("i", "j").applyInPandas(compare, "v long, links long, root long"), "links")
    linked = found.groupBy("v").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")).where("a <> b"))
    done = own.select("key", "rep", "n").join(linked, F.col("rep") == F.col("v"), "left").drop("v").join(comps, F.col("rep") == F.col("v"), "left")
    done = done.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    out = rows.select("id", "key").join(done, "key", "left")
    comp = F.coalesce("_component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))
