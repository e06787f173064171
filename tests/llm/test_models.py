import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import cotraining, hashed, hmm, toxicity
from parlance.llm.common import crc_mod5
from parlance.llm.queries import QUERIES

from .helpers import clashing, docs, odd_docs, words

SF = "/root/testdata/sf0.01"


def held_accuracy(out, labels, col):
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", col).collect()
    return sum(r.predicted == r[col] for r in rows) / len(rows), len(rows)


@pytest.mark.parametrize("name,col,floor", [("op1_toxicity", "toxic", 0.93), ("op7_cotraining", "quality", 0.9)])
def test_held_out_accuracy(spark, name, col, floor):
    out = QUERIES[name](spark, SF).cache()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where("score < 0 OR score > 1 OR (score >= 0.5) <> (predicted = 1)").count() == 0
    assert {(r.doc_id, r.held_out) for r in out.collect()} == {(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect()}
    accuracy, n = held_accuracy(out, spark.read.parquet(f"{SF}/labels.parquet"), col)
    assert accuracy >= floor and n > 40


def test_held_out_labels_do_not_matter(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(crc_mod5("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(d, x).collect())) for x in (labels, flipped))
    assert a == b


def test_pairs_are_learned_that_linear_weights_miss():
    """Label 1 iff both terms or neither: no linear model gets it right."""
    rng = np.random.default_rng(1)
    n = 600
    a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
    terms = np.stack([np.where(a, 1, 2), np.where(b, 3, 4)], 1)
    y = (a == b).astype(float)
    ends = np.arange(1, n + 1) * 2
    fm = hashed.fit(y, terms.ravel(), ends, 4, 4, screen=0.0)
    linear = hashed.fit(y, terms.ravel(), ends, 4, 0, screen=0.0)
    accuracy = lambda m: ((m.logits(terms.ravel(), ends) > 0) == (y > 0)).mean()
    assert accuracy(fm) > 0.98 and accuracy(linear) < 0.7


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, cotraining.quality):
        df = clashing(odd_docs(spark))
        out = f(df, labels).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out) and {r.held_out for r in out if r.doc_id is None} == {False}
        assert f(df.limit(0), labels).count() == 0
        assert f(df, labels.limit(0)).count() == df.count()


def test_co_training_learns_from_the_pool():
    """Few labels; each view knows the class by its own term in most rows."""
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 1200)
    y = np.where(np.arange(1200) < 60, truth, -1)
    views = []
    for v in range(2):
        cells = [[1 + t if rng.random() < 0.9 else 9, 20 + int(rng.integers(0, 20))] for t in truth]
        views.append(cotraining.View(cells, 6))
    models, c = cotraining.co_train(y, views)
    z = sum(w * m.logits(*v.pick(np.arange(1200))) for w, m, v in zip(c, models, views)) + c[-1]
    assert ((z > 0) == (truth > 0)).mean() > 0.95


# ---------------------------------------------------------------- language model


def brute_base(rows, held):
    tok = {i: [*words(t), None] for i, t in rows}
    c = Counter(w for i, ws in tok.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tok.items()}


def test_base_scores_equal_brute_force_and_model_beats_them(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = QUERIES["op10_hmm"](spark, SF).collect()
    expect = brute_base(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    for r in out:
        n, known, total, base = expect[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in out if r.held_out]
    assert len(out) == len(rows) and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_blocks_do_not_matter_for_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 400)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Aa", "b", "c", "dd", f"x{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    df = docs(spark, [*rows, (200, None), (201, ""), (202, " \n")])
    out = hmm.score(clashing(df), F.col("doc_id") % 3 == 0).collect()
    expect = brute_base([*rows, (200, None), (201, ""), (202, " \n")], lambda i: i % 3 == 0)
    assert len(out) == 123
    for r in out:
        assert (r.n_tokens, r.n_known, r.train_tokens) == expect[r.doc_id][:3] and abs(r.base_score - expect[r.doc_id][3]) < 1e-9 and np.isfinite(r.score) and r.score < 0
    assert hmm.score(df.limit(0), F.lit(False)).count() == 0
    alone = hmm.score(df, F.lit(True)).collect()  # nothing to learn from
    assert all(r.base_score == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in alone)


def test_forward_recursion_and_counts_equal_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    k, size = 3, 1 << hmm.BUCKET_BITS
    emit = np.full((size, k), 1e-9)
    emit[:4] = rng.random((4, k))
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit)
    seqs = [[1, 2, 0], [3, 3, 1, 2, 0], [0]]
    flat, ends = np.concatenate(seqs), np.cumsum([len(s) for s in seqs])
    start, move, em = hmm.empty_counts(k)
    m.counts(flat, ends, np.ones(3, bool), (start, move, em))
    total, starts, moves = [], np.zeros(k), np.zeros((k, k))
    for s in seqs:
        p = {path: m.start[path[0]] * emit[s[0], path[0]] * np.prod([m.move[a, b] * emit[x, b] for a, b, x in zip(path, path[1:], s[1:])]) for path in itertools.product(range(k), repeat=len(s))}
        z = sum(p.values())
        total.append(math.log(z))
        for path, v in p.items():
            starts[path[0]] += v / z
            for a, b in zip(path, path[1:]):
                moves[a, b] += v / z
    assert np.allclose(m.log_likelihood(flat, ends), total) and np.allclose(start, starts) and np.allclose(move, moves) and math.isclose(em.sum(), len(flat))


def test_every_round_learns_from_all_documents(spark):
    """More documents than a sample held: the model is that of rounds over all of them."""
    rng = np.random.default_rng(9)
    texts = [(rng.integers(0, 40, rng.integers(1, 9)) << hmm.SEQ_BITS).tolist() for _ in range(1_700)]
    prior = np.full(1 << hmm.BUCKET_BITS, 1e-9)
    prior[:40] = 1 / 40
    got = hmm._learn(spark.createDataFrame([(t,) for t in texts], "codes array<int>").repartition(5), prior, 2)
    expect = hmm.first_model(prior, 2)
    for _ in range(14):
        into = hmm.empty_counts(2)
        hmm.add_counts(expect, *hmm_flat(texts), into)
        expect = hmm.maximise(into, prior)
    assert np.allclose(got.move, expect.move, atol=1e-9) and np.allclose(got.emit, expect.emit, atol=1e-9) and np.allclose(got.start, expect.start, atol=1e-9)


def hmm_flat(texts):
    return np.concatenate(texts) >> hmm.SEQ_BITS, np.cumsum([len(t) for t in texts])


def test_model_is_a_distribution_over_tokens():
    """Sums over a whole small vocabulary, unknown words included, are 1."""
    total, distinct = np.array([5.0, 7.0]), np.array([1, 3])
    room = total + 0.5 * (distinct + 1)
    counts = [4, 2, 1]
    assert math.isclose(sum((c + 0.5) / room[1] for c in counts) + 0.5 / room[1], 1.0)
