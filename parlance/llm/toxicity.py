"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import crc_mod5, quoted, ship, text_chunks, without
from parlance.llm.hashed import Machine, class_weights, doc_terms, fit, platt, sigmoid

BITS = 18
FACTORS = 4
# Labelled rows used for fitting, of each class at most: a documented bound.
MAX_ROWS = {1: 4_000, 0: 12_000}


def labelled(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(id, y) of every labelled id. Ids that carry both labels, and null ids
    or labels, are left out."""
    ids = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    return ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("id", "y")


def per_sampled(ids: DataFrame, max_rows: dict[int, int]) -> dict[int, float]:
    """By class, how many labelled ids stand behind one id of the sample."""
    return {r.y: max(1.0, r["count"] / max_rows[r.y]) for r in ids.groupBy("y").count().collect() if max_rows.get(r.y)}


def sample_rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, max_rows: dict[int, int]) -> DataFrame:
    """(id, y, text) of a bounded sample of labelled rows: of each class the
    ids first in the order of an id hash, and of rows with equal ids the one
    with the smallest text hash, chosen before the texts move."""
    parts = [ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n).select("id", "y") for y, n in max_rows.items()]
    few = parts[0]
    for p in parts[1:]:
        few = few.union(p)
    # at most the sum of max_rows rows, so this broadcast is bounded
    texts = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def term_rows(sample: DataFrame, bits: int) -> DataFrame:
    """(y, id, terms) of the sample, hashed where its texts are."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches):
            t, ends = doc_terms(data, offs, bits)
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(t))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), cells], names=["id", "y", "terms"])

    rows = sample.select(F.col("id").cast("string").alias("id"), "y", "text")
    return rows.mapInArrow(run, "id string, y int, terms array<int>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, factors: int = FACTORS, max_rows: dict[int, int] = MAX_ROWS) -> tuple[Machine, tuple[float, float]]:
    """Fit on the bounded sample, in one task, and calibrate on a fifth of it
    that the fit does not see, with the class shares of all labels. Without rows of both classes the model has no
    terms and gives every text the share of label 1 (0 without rows)."""
    ids = labelled(labels, label_col, id_col)
    behind = per_sampled(ids, max_rows)
    rows = term_rows(sample_rows(docs, ids, id_col, text_col, max_rows), bits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([*frames, pd.DataFrame({"id": [], "y": [], "terms": []})]).sort_values("id", kind="stable")
        y = all_.y.to_numpy(float)
        lens = np.array([len(t) for t in all_.terms], np.int64)
        terms = np.concatenate([np.asarray(t, np.int32) for t in all_.terms] or [np.zeros(0, np.int32)])
        del all_  # the sample is held once, as 32-bit terms
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            m = Machine(float(np.log((share + 1e-4) / (1 - share + 1e-4))), np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors), np.float32))
            out = m, (1.0, 0.0)
        else:
            back = np.arange(len(y)) % 5 == 0
            own = np.repeat(back, lens)
            held, terms = terms[own], terms[~own]
            del own
            m = fit(y[~back], terms, np.cumsum(lens[~back]), bits, factors)
            out = m, platt(m.logits(held, np.cumsum(lens[back])), y[back], class_weights(y[back], behind))
        yield pd.DataFrame({"model": [pickle.dumps(out)]})

    got = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(got.model)


def score(docs: DataFrame, model: tuple[Machine, tuple[float, float]], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` with ``score``: the probability of label 1 of its
    whole text.

    Only the text is an input. Null and empty texts have no terms and get the
    bias alone; repeated rows get equal scores, one row each; a column named
    ``score`` gives way to the result; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**bits x (factors + 1) floats, whatever the data
    rows = docs.select(*[quoted(c) for c in without(docs, ["score"])])
    schema = rows.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (a, b) = sent.value
        for part, data, offs in text_chunks(batches, text_col):
            p = sigmoid(a * m.logits(*doc_terms(data, offs, bits)) + b)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=schema.names)

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out fold
    (crc32 of the id modulo 5 is 0): id, ``held_out``, ``score``, ``predicted``.

    A null id belongs to no fold: ``held_out`` is false.
    """
    model = train(docs, labels.where(crc_mod5(id_col) != 0), label_col, id_col)
    out = score(docs.select(quoted(id_col), F.col("text").alias("text")), model)
    return out.select(quoted(id_col), F.coalesce(crc_mod5(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
