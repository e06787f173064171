"""Linear head of many classes against a dense version in numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import linear as ln
from parlance.operators import models as md

TRAIN = [
    ("cheap flights to paris", "travel"), ("book a hotel in rome", "travel"), ("flight delayed again in rome", "travel"),
    ("my card was charged twice", "billing"), ("refund my card", "billing"), ("invoice is wrong", "billing"), ("invoice is wrong", "billing"),
    ("app crashes on start", "tech"), ("cannot login to app", "tech"), ("reset my password", "tech"), ("hello there", "chat"), ("", "chat"),
]
ASKED = ["card refund please", "app login fails", "zzz unknown words", "flight to rome hotel", "", "my my password app"]


def dense(train, asked, rounds):
    """Weights and softmax scores with full matrices."""
    labels = sorted({y for _, y in train})
    n = len(labels)
    cf = Counter(t for y in labels for t in {t for x, l in train if l == y for t in x.split()})
    vocab = sorted(t for t, c in cf.items() if c <= max(1.0, ln.MAX_CLASS_SHARE * n) and c < n)
    at = {t: i for i, t in enumerate(vocab)}

    def vector(text):
        v = np.zeros(len(vocab))
        for t, k in Counter(text.split()).items():
            if t in at:
                v[at[t]] = k * math.log(n / cf[t])
        return v / np.linalg.norm(v) if v.any() else v

    x = np.array([vector(t) for t, _ in train])
    y = np.array([[1.0 if l == c else 0.0 for c in labels] for _, l in train])
    live = x.any(1)
    w, a = np.zeros((len(vocab), n)), np.zeros((len(vocab), n))
    for r in range(rounds):
        s = x @ w
        g = np.where(y > 0, -np.maximum(2 - s, 0), np.maximum(s, 0)) / y.sum(0)
        g[~live] = 0
        grad = x.T @ g + ln.RIDGE * w
        a += grad**2
        w -= ln.RATE * np.divide(grad, np.sqrt(a), out=np.zeros_like(grad), where=a > 0)
    s = np.array([vector(t) for t in asked]) @ w
    return labels, vocab, w, np.exp(s) / np.exp(s).sum(1, keepdims=True), s


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(TRAIN, "Text string, label string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(ASKED)], "qid long, text string")
    return md.fit("linear", df, "Text", "label"), q, dense(TRAIN, ASKED, ln.ROUNDS)


def test_weights_equal_the_dense_version(toy):
    head, _, (_, vocab, w, *_) = toy
    got = np.zeros_like(w)
    for r in head.linear.weights.collect():
        got[vocab.index(r.token), r.cls] = r.w
    assert np.abs(got - w).max() < 1e-6


@pytest.mark.parametrize("k", [1, 3, 4])
def test_top_classes_equal_the_dense_version(toy, k):
    head, q, (labels, _, _, p, s) = toy
    got = {}
    for r in md.predict_topk(head, q, k).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.cls, r.p))
    assert got.keys() == set(range(len(ASKED)))
    for i in range(len(ASKED)):
        order = sorted(range(len(labels)), key=lambda c: (-round(s[i, c], 6), -c))[:k]
        rows = sorted(got[i])
        assert [c for _, c, _ in rows] == order and all(abs(v - p[i, c]) < 1e-6 for _, c, v in rows)
    full = {r.qid: r.proba for r in md.predict_proba(head, q).collect()}
    assert all(np.abs(np.array(full[i]) - p[i]).max() < 1e-6 for i in full) and len(full) == len(ASKED)


def test_saved_head_answers_as_trained(spark, toy, tmp_path):
    head, q, _ = toy
    md.save(head, str(tmp_path))
    back = md.load(spark, str(tmp_path), "linear", "label")
    read = lambda h: sorted((r.qid, r["rank"], r.cls, round(r.p, 9)) for r in md.predict_topk(h, q, 2).collect())
    assert read(back) == read(head) and md.model_id(back) == md.model_id(head)


def test_ten_thousand_classes(spark):
    n = 10_000
    text = F.concat(F.lit("common w"), F.col("id") % n, F.lit(" v"), F.col("id") % 2003, F.lit(" u"), (F.col("id") * 7) % 3001)
    rows = spark.range(2 * n).select("id", text.alias("Text"), F.format_string("c%05d", F.col("id") % n).alias("label"))
    m = ln.train(rows, "Text", "label", rounds=2)
    asked = rows.where("id % 400 = 3").select(F.col("id").alias("qid"), F.col("Text").alias("text"), "label")
    got = ln.score_topk(m, asked, "text", 2).join(asked, "qid").join(m.decode().withColumnRenamed("label", "found"), "cls").where("rank = 1").collect()
    assert m.n_classes == n and len(got) == 50 and all(r.found == r.label for r in got)
    assert m.weights.count() < 0.01 * n * m.features.count()  # pairs that share a token, not all


def test_sums_and_answers_come_without_a_table_of_weights(spark, monkeypatch):
    """Weights tend to tokens x classes; they are learned in the tasks that use
    them, and equal the written ones, whatever the parts that share the classes."""
    from parlance.operators import blocks

    df = spark.createDataFrame([*TRAIN, ("no class", None)], "Text string, label string")
    q = spark.createDataFrame([*((i, t) for i, t in enumerate(ASKED)), (None, "card"), (0, "rome")], "qid long, text string")
    sums = lambda m: sorted((r.cls, r.n, round(r.w, 6), round(r.a, 6)) for r in m.class_sums().collect())
    best = lambda m: sorted((r.qid, r["rank"], r.cls, round(r.p, 6)) for r in ln.score_topk(m, q.where("qid IS NOT NULL"), "text", 2).collect())
    kept = ln.train(df, "Text", "label").written()
    expect = sums(kept), best(kept)
    assert len(expect[0]) == 4 and kept.weights.count() == sum(n for _, n, _, _ in expect[0])

    def never(_self):
        raise AssertionError("weights were written")

    monkeypatch.setattr(ln.LinearModel, "written", never)
    for few, held, piece, width in ((0.2, 1 << 24, 1 << 16, 1), (0.0, 5, 3, 2), (2.0, 1, 1, 99)):
        for name, value in (("FEW", few), ("HELD", held), ("PIECE", piece), ("WEIGHTS", width), ("FEWEST", width)):
            monkeypatch.setattr(blocks, name, value)
        m = ln.train(df, "Text", "label")
        assert (sums(m), best(m)) == expect
