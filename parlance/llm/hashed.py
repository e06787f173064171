"""Sparse binary features by hashing, and factorization machines over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from parlance.llm.common import U64, Words, mix64

PREFIXES = (3, 4, 5)


def doc_terms(data: np.ndarray, offs: np.ndarray, bits: int, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of every document, flat, and where each
    document's terms end. Terms are lower-cased words without the ASCII marks
    around them, and beginnings of longer words."""
    w = Words(data, offs)
    start, end = _bare(data, w.start, w.end)
    doc = w.doc
    some = end > start
    start, end, doc = start[some], end[some], doc[some]
    hashes, docs = [w.range_hash(start, end)], [doc]
    for n in prefixes:
        longer = end - start > n
        s = start[longer]
        hashes.append(mix64(w.range_hash(s, s + n) + U64(n)))
        docs.append(doc[longer])
    term = (np.concatenate(hashes) >> U64(64 - bits)).astype(np.int64)
    return distinct(np.concatenate(docs), term, bits, len(offs) - 1)


def distinct(doc: np.ndarray, term: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << bits) | term)
    return (both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both >> bits, np.arange(n), "right")


_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _bare(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end = start.copy(), end.copy()
    for _ in range(4):  # up to four marks on either side
        s = (end > start) & _MARK[data[np.minimum(start, len(data) - 1)]] if len(data) else np.zeros(0, bool)
        if not s.any():
            break
        start[s] += 1
    for _ in range(4):
        s = (end > start) & _MARK[data[end - 1]] if len(data) else np.zeros(0, bool)
        if not s.any():
            break
        end[s] -= 1
    return start, end


def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over the runs of rows that end at ``ends`` (runs may be empty)."""
    c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return c[ends] - c[np.concatenate([[0], ends[:-1]])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Machine:
    """w0 + sum w_i + sum over pairs <v_i, v_j> of the terms i, j of a document;
    with no factors a plain linear model."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        z = self.bias + sums(self.w[terms], ends)
        if self.v.shape[1]:
            v = self.v[terms]
            z = z + 0.5 * (sums(v, ends) ** 2 - sums(v * v, ends)).sum(1)
        return z


def paired(y: np.ndarray, terms: np.ndarray, ends: np.ndarray, df: np.ndarray, linear: np.ndarray, least: int, share: float = 0.01, errors: float = 8.0) -> np.ndarray:
    """Which terms without a linear weight matter beside another term, and the
    terms they matter beside. All pairs of terms in ``share`` of the documents
    (and ``least``) are looked at: the share of label 1 with both terms, less
    the shares with one, plus the share with neither, is 0 when the terms only
    add up; ``errors`` standard errors are more than chance makes of all pairs.
    """
    n, y1 = len(y), float(y.sum())
    who = np.flatnonzero(df >= max(least, share * n))
    # tiles of bounded memory, whatever the number of terms
    block, rows = (int(np.clip(cells // max(len(who), 1), 16, most)) for cells, most in ((2 << 20, 1024), (4 << 20, 2048)))
    number = np.full(len(df), -1, np.int32)
    number[who] = np.arange(len(who))
    t = number[terms]
    own = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.concatenate([[0], ends])))[t >= 0]
    t = t[t >= 0]
    cuts = np.searchsorted(own, np.arange(0, n + rows, rows))
    s, s1 = df[who].astype(np.float32), np.bincount(t, weights=y[own], minlength=len(who)).astype(np.float32)
    known, hit = linear[who], np.zeros(len(who), bool)
    for lo in range(0, len(who), block):
        hi = min(lo + block, len(who))
        both, both1 = np.zeros((2, len(who) - lo, hi - lo), np.float32)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            x = np.zeros((min(rows, n - i * rows), len(who)), np.float32)
            x[own[a:b] - i * rows, t[a:b]] = 1
            x = x[:, lo:]
            pos = x[y[i * rows : i * rows + len(x)] > 0]
            both += x.T @ x[:, : hi - lo]
            both1 += pos.T @ pos[:, : hi - lo]
        i, i1, j, j1 = s[lo:, None], s1[lo:, None], s[None, lo:hi], s1[None, lo:hi]
        odd, var = np.zeros_like(both), np.zeros_like(both)
        with np.errstate(divide="ignore", invalid="ignore"):
            for sign, c, c1 in ((1, both, both1), (-1, i - both, i1 - both1), (-1, j - both, j1 - both1), (1, n - i - j + both, y1 - i1 - j1 + both1)):
                odd += sign * (c1 / c)
                var += 1 / c
            # without documents in one of the four parts, nothing is known of the pair
            far = np.abs(odd) >= errors * np.sqrt(y1 / n * (1 - y1 / n) * var)
        far &= ~(known[lo:, None] & known[None, lo:hi]) & np.isfinite(var)
        hit[lo:] |= far.any(1)
        hit[lo:hi] |= far.any(0)
    out = np.zeros(len(df), bool)
    out[who[hit]] = True
    return out


def fit(y: np.ndarray, terms: np.ndarray, ends: np.ndarray, bits: int, factors: int, updates: int = 1200, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, least: int = 3, screen: float = 4.0, weight: np.ndarray | None = None, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, three epochs or ``updates`` steps at least; the rarer class weighs as much as the
    other. Terms in fewer than ``least`` documents are left out. A term whose
    share of documents does not differ between the classes by ``screen``
    standard errors has no linear weight, and has factors only if it takes
    part in a pair (``paired``). The result depends on the order of the rows
    only through ``seed``."""
    size = 1 << bits
    n = len(y)
    if not n:
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    begin = np.concatenate([[0], ends[:-1]])
    df = np.bincount(terms, minlength=size)
    seen = df >= least
    if 0 < y.sum() < n:
        with_pos = np.bincount(terms[np.repeat(y > 0, ends - begin)], minlength=size)
        p1, p0, p = with_pos / y.sum(), (df - with_pos) / (n - y.sum()), df / n
        seen &= np.abs(p1 - p0) >= screen * np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (n - y.sum()))) + 1e-12
    linear = seen.copy()
    if factors and 0 < y.sum() < n:
        seen |= paired(y, terms, ends, df, linear, least)
    number = np.cumsum(seen) - 1
    m = int(seen.sum())
    alone = linear[seen]
    rng = np.random.default_rng(seed)
    w, gw = np.zeros(m), np.full(m, 1e-3)
    v, gv = rng.normal(0, 0.01, (m, factors)), np.full((m, factors), 1e-3)
    bias, gb = 0.0, 1e-3
    pos = max(float(y.sum()), 1.0)
    cost = np.where(y > 0, max(1.0, (n - pos) / pos), max(1.0, pos / max(n - pos, 1.0)))
    cost = cost * (weight if weight is not None else 1.0)
    for _ in range(max(3, -(-updates * batch // n))):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            lens = ends[rows] - begin[rows]
            stop = np.cumsum(lens)
            at = np.arange(stop[-1]) + np.repeat(begin[rows] - (stop - lens), lens)
            t = terms[at]
            own = np.repeat(np.arange(len(rows)), lens)
            hit = seen[t]
            t, own = number[t[hit]], own[hit]
            stop = np.cumsum(np.bincount(own, minlength=len(rows)))
            u, inv = np.unique(t, return_inverse=True)
            vt = v[t]
            s = sums(vt, stop)
            z = bias + sums(w[t], stop) + 0.5 * (s**2 - sums(vt * vt, stop)).sum(1)
            g = (sigmoid(z) - y[rows]) * cost[rows] / len(rows)
            gr = np.bincount(inv, weights=g[own], minlength=len(u)) + decay * w[u]
            gw[u] += gr**2
            w[u] -= np.where(alone[u], rate * gr / np.sqrt(gw[u]), 0.0)
            for f in range(factors):
                gr = np.bincount(inv, weights=g[own] * (s[own, f] - vt[:, f]), minlength=len(u)) + decay * v[u, f]
                gv[u, f] += gr**2
                v[u, f] -= 0.3 * rate * gr / np.sqrt(gv[u, f])
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
    full_w, full_v = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    full_w[seen], full_v[seen] = w, v
    return Machine(float(bias), full_w, full_v)


def class_weights(y: np.ndarray, per_row: dict[int, float] | None) -> np.ndarray:
    """Weights of rows that give a sample cut by class the class shares of
    the whole; on average 1."""
    w = np.where(y > 0, *((per_row or {}).get(k, 1.0) for k in (1, 0)))
    return w / w.mean() if len(w) else w


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, steps: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a z + b) by Newton steps on held-back rows, with a
    small ridge so that separable rows stay finite."""
    a, b = 1.0, 0.0
    if not len(z) or y.min() == y.max():
        return a, b
    for _ in range(steps):
        p = sigmoid(a * z + b)
        r = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ z + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
        m = np.array([[h @ (z * z) + 1e-2, h @ z], [h @ z, h.sum() + 1e-2]])
        d = np.linalg.solve(m, g)
        a, b = max(a - d[0], 1e-3), b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)
