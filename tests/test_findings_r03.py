"""Findings of round 3: tables as folders of files, scoring and training in blocks."""

import math
import random
from collections import Counter

import pytest

from parlance.operators import bayes, blocks, lattice, models, util
from parlance.sources.catalog import Catalog
from parlance.streaming import answers as st

TURNS = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(6) for t in range(5)]


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    rows = spark.createDataFrame(TURNS, st.CONVERSATIONS_SCHEMA)
    rows.repartition(3, "conv_id").write.parquet(f"{tmp_path}/conversations.parquet")
    stream = st.question_stream(spark, str(tmp_path))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    want = Catalog(spark, str(tmp_path)).read("questions")
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 18


# ---------------------------------------------------------------- naive Bayes in blocks
def many_classes(n=100):
    rng = random.Random(5)
    text = lambda m: " ".join(rng.choice(WORDS) for _ in range(m))
    train = [(text(4), f"c{i % n:03d}") for i in range(2 * n)]
    return train, [(i, text(i % 9)) for i in range(60)] + [(60, "never seen"), (61, None)]


WORDS = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]


def dense(train, questions):
    labels = sorted({y for _, y in train})
    cnt = {y: Counter() for y in labels}
    for t, y in train:
        cnt[y].update(t.split())
    docs, vocab = Counter(y for _, y in train), set().union(*cnt.values())
    for qid, text in questions:
        tf = Counter(t for t in (text or "").split() if t in vocab)
        s = [math.log(docs[y] / len(train)) + sum(c * math.log((cnt[y][t] + 1) / (sum(cnt[y].values()) + len(vocab))) for t, c in tf.items()) for y in labels]
        z = sum(map(math.exp, s))
        yield qid, [math.exp(v) / z for v in s]


@pytest.mark.parametrize("least, cells", [(512, 1 << 20), (7, 300)])
def test_many_classes_make_no_pair_rows(spark, monkeypatch, least, cells):
    def pairs(*_a, **_k):
        raise AssertionError("(question, class) pairs as rows")

    monkeypatch.setattr(bayes, "_pairs", pairs)
    monkeypatch.setattr(blocks, "LEAST", least)
    monkeypatch.setattr(blocks, "CELLS", cells)
    train, asked = many_classes()
    model = bayes.train(spark.createDataFrame(train, "Text string, label string"), "Text", "label")
    q = spark.createDataFrame([(*r, 7) for r in asked], "qid long, text string, y int")
    got = {}
    for r in bayes.score_topk(model, q, "text", 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.cls, r.p))
    true = {r.qid: (r.cls, r.p_true) for r in bayes.score_true(model, q, "text", "y").collect()}
    want = dict(dense(train, asked))
    assert got.keys() == want.keys() == true.keys()
    for qid, p in want.items():
        order = sorted(range(len(p)), key=lambda c: (-round(p[c], 12), -c))[:4]
        rows = sorted(got[qid])
        assert all(abs(v - p[c]) < 1e-9 and abs(p[c] - p[o]) < 1e-12 for (_, c, v), o in zip(rows, order, strict=True))
        assert abs(true[qid][1] - p[7]) < 1e-9 and true[qid][0] == rows[0][1]


def test_equal_classes_in_blocks_tie_to_the_higher_index(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 10)
    train = [("one two three", f"c{i:03d}") for i in range(90)]
    model = bayes.train(spark.createDataFrame(train, "Text string, label string"), "Text", "label")
    q = spark.createDataFrame([(1, "three one one"), (1, "two"), (None, "one")], "qid long, text string")
    got = sorted((r.qid or 0, r["rank"], r.cls) for r in bayes.score_topk(model, q, "text", 3).collect())
    top = [(1, 89), (2, 88), (3, 87)]
    assert got == sorted([(0, *t) for t in top] + 2 * [(1, *t) for t in top])


def test_a_null_label_does_not_cost_the_last_class(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 1)  # 8 blocks of 12
    train = [(f"{WORDS[i % 36]} {WORDS[i // 36]}", f"c{i:03d}") for i in range(96)]
    rows = spark.createDataFrame([*train, (WORDS[1], None)], "Text string, label string")
    model = bayes.train(rows, "Text", "label")
    q = spark.createDataFrame([(1, train[95][0])], "qid long, text string")
    got = bayes.score_topk(model, q, "text", 1).join(model.decode(), "cls").collect()
    p = dict(dense(train, [(1, train[95][0])]))[1]
    assert [r.label for r in got] == ["c095"] and abs(got[0].p - p[95]) < 1e-9


# ---------------------------------------------------------------- naive Bayes with few classes
def test_few_classes_make_no_pair_rows(spark, monkeypatch):
    def pairs(*_a, **_k):
        raise AssertionError("(question, token) or (question, class) rows")

    monkeypatch.setattr(bayes, "_pairs", pairs)
    train, asked = many_classes(5)
    model = bayes.train(spark.createDataFrame(train, "Text string, label string"), "Text", "label")
    q = spark.createDataFrame([(*r, 2) for r in asked], "qid long, text string, y int")
    want = dict(dense(train, asked))
    full = {r.qid: r.proba for r in bayes.score_vector(model, q, "text").collect()}
    true = {r.qid: r.p_true for r in bayes.score_true(model, q, "text", "y").collect()}
    best = {r.qid: r.p for r in bayes.score_topk(model, q, "text", 1).collect()}
    for qid, p in want.items():
        assert max(abs(a - b) for a, b in zip(full[qid], p, strict=True)) < 1e-9
        assert abs(true[qid] - p[2]) < 1e-9 and abs(best[qid] - max(p)) < 1e-9


@pytest.mark.parametrize("entries,cells", [(1 << 21, 1 << 22), (64, 1 << 22), (64, 200), (1 << 21, 200)])
def test_linear_pairs_are_summed_in_blocks_and_never_rows(spark, monkeypatch, entries, cells):
    """F8, F10: whatever the groups of rows and the blocks of classes, weights and
    answers equal full matrices, and no (row, class) table is made."""
    import numpy as np

    from parlance.operators import linear as ln
    from tests.test_linear import dense

    def rows_of_pairs(*a):
        raise AssertionError("(row, class) pairs became rows")

    monkeypatch.setattr(ln, "_scores", rows_of_pairs)
    for name, value in (("ENTRIES", entries), ("WEIGHTS", cells), ("FEWEST", 4)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b for a in letters for b in letters[:3]]
    train = [(" ".join(rng.choices(words, k=rng.randint(1, 5))), f"c{rng.randint(0, 22):02d}") for _ in range(90)]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(25)] + ["", "zzz"]
    labels, vocab, w, p, s = dense(train, asked, 3)
    m = ln.train(spark.createDataFrame(train, "Text string, label string"), "Text", "label", rounds=3)
    got = np.zeros_like(w)
    for r in m.weights.collect():
        got[vocab.index(r.token), r.cls] = r.w
    assert np.abs(got - w).max() < 1e-6
    assert {r.cls: r.n for r in m.class_sums().collect()} == Counter(r.cls for r in m.weights.collect())
    q = spark.createDataFrame([*enumerate(asked), (None, "ab")], "qid long, text string")
    out = {}
    again = ln.LinearModel(m.classes, m.features, m.weights, m.label, m.n_classes)  # as a saved model is read
    for model in (m, again):
        for r in sorted(ln.score_topk(model, q, "text", 2).collect(), key=lambda r: (r.qid is None, r.qid, r["rank"])):
            out.setdefault(r.qid, []).append((r.cls, r.p))
    for i in range(len(asked)):
        order = sorted(range(len(labels)), key=lambda c: (-round(s[i, c], 6), -c))[:2]
        assert [c for c, _ in out[i]] == order * 2
        assert all(abs(v - p[i, c]) < 1e-6 for c, v in out[i])
    n = len(labels)
    assert [c for c, _ in out[None]] == [n - 1, n - 2] * 2 and all(abs(v - 1 / n) < 1e-9 for _, v in out[None])


def test_large_models_are_not_broadcast(spark):
    """the rows of a broadcast model are held several times in the driver."""
    few, many = (spark.range(n).selectExpr("cast(id as string) token", "0 cls", "1.0D w") for n in (100, 300_000))
    classes = spark.createDataFrame([(0, "a", 1, 1, 0.0, 1.0)], "cls int, y string, docs long, n_tok long, prior double, ld double")
    assert bayes.NBModel(classes, few, "y").broadcastable()
    assert not bayes.NBModel(classes, many, "y").broadcastable()
    q = spark.createDataFrame([(1, "7 8 8 x"), (2, ""), (3, None)], "qid long, text string")
    got = {r.qid: r.scores for r in bayes.score_vector(bayes.NBModel(classes, many, "y"), q, "text").collect()}
    assert got == {1: [0.0], 2: [0.0], 3: [0.0]}  # three known tokens: 3 - 3 * 1


class _Seen:
    """Stands for an estimator; keeps the number of partitions it gets."""

    def __init__(self, seen):
        self.seen = seen

    def fit(self, rows):
        self.seen.append((rows.rdd.getNumPartitions(), rows.count()))


def test_training_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """few rows came as few partitions, so most cores had none."""
    seen = []
    monkeypatch.setattr(models, "ml_pipeline", lambda *a: _Seen(seen))
    corpus = spark.range(9000).selectExpr("concat('text ', id) t", "id % 3 y").coalesce(1)
    models.fit("logreg", corpus, "t", "y")
    assert seen == [(spark.sparkContext.defaultParallelism, 9000)]
    few = corpus.limit(40)
    assert util.dealt(few) is few  # few rows stay as they are


def test_boosters_get_dealt_rows_and_train_together(spark, monkeypatch):
    """one partition of small rows went through all passes."""
    seen, args = [], {}
    monkeypatch.setattr(models, "OneVsRest", lambda **kw: args.update(kw) or _Seen(seen))
    rows = spark.range(9000).selectExpr("array(double(id), 1.0D) f", "int(id % 3) label_emo").coalesce(1)
    models.train_stack(rows)
    assert seen == [(spark.sparkContext.defaultParallelism, 9000)] and args["parallelism"] > 1


def test_lattice_holds_the_edges_of_a_slice(monkeypatch):
    """the edges of all texts of a batch were held at once."""
    monkeypatch.setattr(lattice, "SLICE_CHARS", 50, raising=False)
    lat = lattice.Lattice([("ab", 5), ("a", 3), ("abc", 4), ("ca", 2)])
    r = random.Random(3)
    texts = ["".join(r.choice("abc 1-") for _ in range(r.choice([0, 1, 9, 70]))) for _ in range(200)]
    alone = [lat.segments([t], True, True)[0] for t in texts]
    sizes, cuts = [], lat.cuts
    monkeypatch.setattr(lat, "cuts", lambda points, bounds: sizes.append(len(points)) or cuts(points, bounds))
    assert lat.segments(texts, True, True) == alone
    assert max(sizes) <= 70 and lat.segments([]) == []
