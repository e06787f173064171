"""Quality by co-training: a view of the text and a view of the page's
metadata teach each other, then score all documents together."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import U64, Words, crc_mod5, mix64, quoted, ship, text_chunks
from parlance.llm.hashed import Machine, class_weights, distinct, fit, platt, sigmoid
from parlance.llm.toxicity import labelled, per_sampled

BITS = 18
META_BITS = 12
# Rows used for fitting: labelled ones of each class, and a pool without
# labels. Documented bounds; scoring reads everything.
MAX_ROWS = {1: 6_000, 0: 6_000}
MAX_POOL = 12_000
ROUNDS = 3
CONFIDENT = 0.95
PER_ROUND = 1_500  # pseudo-labels that a view gives in a round, by class
META_COLS = ("source", "lang", "n_chars")


def content_terms(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text view: hashed words as written, their beginnings and endings."""
    w = Words(data, offs, lower=False)
    n = w.end - w.start
    hashes, docs = [w.hashes()], [w.doc]
    for k, at in ((3, "b"), (2, "e"), (3, "e")):
        long = n > k
        s = w.start[long] if at == "b" else w.end[long] - k
        hashes.append(mix64(w.range_hash(s, s + k) + U64(k + (16 if at == "e" else 0))))
        docs.append(w.doc[long])
    term = (np.concatenate(hashes) >> U64(64 - bits)).astype(np.int64)
    return distinct(np.concatenate(docs), term, bits, len(offs) - 1)


_KIND = np.zeros(256, np.int64)  # other, lower, upper, digit, space, mark, beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 10, 11, 12, 13]] = 1, 2, 3, 4
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 5
_KIND[128:] = 6


def _level(x: np.ndarray, fine: float = 24.0) -> np.ndarray:
    """A share as a step on a scale that is fine near 0."""
    return np.floor(np.sqrt(np.clip(x, 0, 1)) * fine).astype(np.int64)


def layout_terms(data: np.ndarray, offs: np.ndarray, columns: list[list], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Metadata view: what the page's record says (source, language, size) and
    the shape of its body (lines, kinds of characters, length of words), each
    as a step on a scale. No words."""
    n = len(offs) - 1
    size = np.diff(offs)
    kind = _KIND[data]
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs])
    whole = np.maximum(size, 1)
    w = Words(data, offs, lower=False)
    words = np.maximum(np.diff(w.first), 1)
    lines = per(data == 10) + 1
    # words that repeat within their document
    key = mix64(w.hashes() + w.doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), bool)
    fresh[at] = True
    seen_doc = np.diff(np.concatenate([[0], np.cumsum(fresh)])[w.first])
    steps = [np.full(n, 0), np.floor(2 * np.log2(size + 1)).astype(np.int64), np.floor(2 * np.log2(lines)).astype(np.int64), np.floor(2 * np.log2(words / lines + 1)).astype(np.int64), np.floor(4 * np.log2(size / words + 1)).astype(np.int64), _level(seen_doc / words)]
    steps += [_level(per(kind == k) / whole) for k in range(7)]
    steps += [_level(per(data == ord(c)) / whole, 40.0) for c in "!|#%$&*.,\"'<>{}@/:;?-_=+"]
    docs, terms = [], []
    who = np.arange(n)
    for i, s in enumerate(steps):
        docs.append(who)
        terms.append((mix64((s.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(i + 1)) >> U64(64 - bits)).astype(np.int64))
    for i, col in enumerate(columns):
        text = [("" if x is None else str(x)).encode() for x in col]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        if i == 2:  # a number: by its order of magnitude
            v = np.array([float(x) if x is not None else 0.0 for x in col])
            h = mix64(np.floor(2 * np.log2(np.maximum(v, 0) + 1)).astype(np.uint64) + U64(977))
        else:
            h = mix64(Words(np.frombuffer(b"".join(text), np.uint8), ends).range_hash(ends[:-1], ends[1:]) + U64(1000 + i))
        docs.append(who)
        terms.append((h >> U64(64 - bits)).astype(np.int64))
    return distinct(np.concatenate(docs), np.concatenate(terms), bits, n)


def _with_meta(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = {c.lower(): c for c in docs.columns}
    meta = [quoted(have[c]).cast("string" if c != "n_chars" else "double") if c in have else F.lit(None).cast("string" if c != "n_chars" else "double") for c in META_COLS]
    return docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), *[m.alias(f"m{i}") for i, m in enumerate(meta)])


def _views(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
    at = part.schema.get_field_index("m0")
    return content_terms(data, offs, BITS), layout_terms(data, offs, [part.column(at + i).to_pylist() for i in range(3)], META_BITS)


class View:
    """Rows of one view, picked by number."""

    def __init__(self, cells: list, bits: int):
        self.bits = bits
        self.lens = np.array([len(c) for c in cells], np.int64)
        self.terms = np.concatenate([np.asarray(c, np.int64) for c in cells] or [np.zeros(0, np.int64)])
        self.ends = np.cumsum(self.lens)

    def pick(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(self.lens[who])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[who] - ends, self.lens[who])
        return self.terms[at], ends


def co_train(y: np.ndarray, views: list[View], rounds: int = ROUNDS, confident: float = CONFIDENT, per_round: int = PER_ROUND, behind: dict[int, float] | None = None) -> tuple[list[Machine], np.ndarray]:
    """Models of the views and the weights that combine their logits.

    ``y`` is 0, 1, or -1 for the pool. In a round every view is fitted on its
    labelled rows and calibrated on a fifth that it does not see; what it is
    sure of in the pool goes, with that label, into the other view's rows.
    At the end the calibrated logits are combined by a small ridge fit on the
    held-back fifth. ``behind`` says by class how many labelled rows one row
    stands for; calibration and combination weigh the classes by it.
    """
    known = np.flatnonzero(y >= 0)
    back, train_rows = known[::5], np.setdiff1d(known, known[::5])
    pool = np.flatnonzero(y < 0)
    extra: list[dict[int, int]] = [{} for _ in views]
    share = class_weights(y[back], behind)
    for r in range(rounds + 1):
        fitted = []
        for v, more in zip(views, extra):
            who = np.concatenate([train_rows, np.fromiter(more, np.int64, len(more))])
            target = np.concatenate([y[train_rows], np.fromiter(more.values(), np.float64, len(more))]).astype(float)
            weight = np.concatenate([np.ones(len(train_rows)), np.full(len(more), 0.5)])
            m = fit(target, *v.pick(who), v.bits, 0, weight=weight)
            fitted.append((m, *platt(m.logits(*v.pick(back)), y[back].astype(float), share)))
        if r == rounds or not len(pool):
            break
        for i, (v, (m, a, b)) in enumerate(zip(views, fitted)):
            p = sigmoid(a * m.logits(*v.pick(pool)) + b)
            for label, sure in ((1, p), (0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:per_round]
                for k in pool[best[sure[best] >= confident]].tolist():
                    for j in range(len(views)):
                        if j != i:
                            extra[j].setdefault(k, label)
    z = np.stack([a * m.logits(*v.pick(back)) + b for v, (m, a, b) in zip(views, fitted)] + [np.ones(len(back))], 1)
    t = y[back].astype(float)
    c = np.array([0.7] * len(views) + [0.0])
    start = c.copy()
    if len(back) and t.min() != t.max():
        for _ in range(50):
            p = sigmoid(z @ c)
            g = z.T @ (share * (p - t)) + 0.05 * (c - start)
            h = (z * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + 0.05 * np.eye(len(c))
            c = c - np.linalg.solve(h, g)
    # fold the calibration into the combination: one weight per view, one constant
    weights = np.array([c[i] * a for i, (_, a, _) in enumerate(fitted)] + [c[-1] + sum(c[i] * b for i, (_, _, b) in enumerate(fitted))])
    return [m for m, _, _ in fitted], weights


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[Machine], np.ndarray]:
    """Co-train on a bounded sample, in one task. Without labels of both
    classes, every score is the share of label 1 (0.5 without labels)."""
    ship(docs.sparkSession)
    ids = labelled(labels, label_col, id_col)
    behind = per_sampled(ids, MAX_ROWS)
    few = None
    for y, n in MAX_ROWS.items():
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        few = part if few is None else few.union(part)
    # at most MAX_POOL ids; those that have a label are no part of the pool
    pool = docs.select(quoted(id_col).alias("id")).where("id IS NOT NULL").distinct().join(ids.select("id"), "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(MAX_POOL)
    few = few.union(pool.select("id", F.lit(-1).alias("y")))
    # one row of each id, the one with the smallest hash, chosen before the texts move
    row = ["text", "m0", "m1", "m2"]
    rows = _with_meta(docs, id_col, text_col).join(F.broadcast(few), "id").groupBy("id", "y").agg(F.min_by(F.struct(*row), F.xxhash64(*row)).alias("row"))
    rows = rows.select(F.col("id").cast("string").alias("id"), "y", "row.*")

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches):
            cells = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], e]), pa.int32()), pa.array(t)) for t, e in _views(part, data, offs)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), *cells], names=["id", "y", "content", "layout"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat([*frames, pd.DataFrame({"id": [], "y": [], "content": [], "layout": []})]).sort_values("id", kind="stable")
        y = f.y.to_numpy(np.int64)
        known = y[y >= 0]
        if not len(known) or known.min() == known.max():
            share = known.mean() if len(known) else 0.5
            empty = [Machine(0.0, np.zeros(1 << b, np.float32), np.zeros((1 << b, 0), np.float32)) for b in (BITS, META_BITS)]
            out = empty, np.array([0.0, 0.0, np.log((share + 1e-4) / (1 - share + 1e-4))])
        else:
            out = co_train(y, [View(list(f.content), BITS), View(list(f.layout), META_BITS)], behind=behind)
        yield pd.DataFrame({"model": [pickle.dumps(out)]})

    got = rows.mapInArrow(views, "id string, y int, content array<int>, layout array<int>").repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(got.model)


def score(docs: DataFrame, model: tuple[list[Machine], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole document, from both calibrated views.

    Missing metadata columns and nulls count as the empty value, null text as
    the empty text; repeated rows get equal scores, one row each; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # tables of fixed size
    rows = _with_meta(docs, id_col, text_col)
    schema = docs.select(quoted(id_col), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, c = sent.value
        for part, data, offs in text_chunks(batches):
            z = sum(w * m.logits(*v) for w, m, v in zip(c, machines, _views(part, data, offs))) + c[-1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(z))], names=schema.names)

    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out fold
    (crc32 of the id modulo 5 is 0): id, ``held_out``, ``score`` (higher:
    label 1 likelier), ``predicted`` (1: keep). A null id belongs to no fold."""
    model = train(docs, labels.where(crc_mod5(id_col) != 0), label_col, id_col)
    out = score(docs, model, id_col)
    return out.select(quoted(id_col), F.coalesce(crc_mod5(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
