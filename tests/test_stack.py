"""Out-of-fold features of the stacked model, and softmax in one pass."""

import math
import time

import pytest
from pyspark.sql import functions as F

from parlance.functions import vectors as vx
from parlance.operators import features as ft
from parlance.operators import models as md


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"only{i} " + ("good fine" if i % 3 else "bad sad") + f" w{i % 5}", "up" if i % 3 else "down") for i in range(60)]
    rows += rows[:6] + [(60, "rare text", "rare")]
    df = spark.createDataFrame(rows, "ord long, Question string, EmotionName string")
    return df, df.select("ord", F.col("Question").alias("text"), (F.col("EmotionName") == "up").cast("int").alias("positive"))


def test_no_row_is_scored_by_a_model_that_saw_it(corpus):
    df, sent = corpus
    head = md.fit("nb", df, "Question", "EmotionName")
    got = ft.oof_features(head, df, sent, 3)
    rows = got.collect()
    assert len(rows) == df.count() and {len(r.f) for r in rows} == {4} and {r.fold for r in rows} == {0, 1, 2}
    by_ord = {}
    for r in rows:
        by_ord.setdefault(r.ord, set()).add(r.fold)
    assert all(len(v) == 1 for v in by_ord.values())  # copies share a fold
    fold = ft.fold_of("ord", 3)
    for k in range(3):
        part = df.where(fold != k)
        own = md.fit("nb", part, "Question", "EmotionName")
        assert own.nb.vocab.join(df.where(fold == k).select(F.regexp_extract("Question", r"only\d+", 0).alias("token")).where("token <> ''"), "token").count() == 0
        names = {r.cls: r.EmotionName for r in own.decode.collect()}
        q = df.where(fold == k).select(F.col("ord").alias("qid"), F.col("Question").alias("text")).distinct()
        want = {r.qid: {names[i]: p for i, p in enumerate(r.proba)} for r in md.predict_proba(own, q).collect()}
        order = [r.EmotionName for r in head.decode.orderBy("cls").collect()]
        mine = {r.ord: r for r in rows if r.fold == k}
        assert mine.keys() == want.keys()
        for i, r in mine.items():
            assert all(abs(r.f[c] - want[i].get(n, 0.0)) < 1e-12 for c, n in enumerate(order))


def test_the_class_of_one_fold_is_unknown_there(corpus):
    df, sent = corpus
    head = md.fit("nb", df, "Question", "EmotionName")
    rare = [r.cls for r in head.decode.where("EmotionName = 'rare'").collect()][0]
    row = ft.oof_features(head, df, sent).where("ord = 60").first()
    assert row.f[rare] == 0.0 and row.label_emo == rare
    with pytest.raises(ValueError):
        ft.oof_features(head, df, sent, 1)


def test_softmax_cost_grows_with_the_vector(spark):
    def vector(n):
        return spark.createDataFrame([(i, [1.0 + (i * j) % 17 for j in range(n)]) for i in range(20)], "i long, x array<double>").cache()

    took = {}
    for n in (100, 1000):
        df = vector(n)
        df.count()
        for c in (vx.softmax(F.col("x")), vx.softmax_contrast(F.col("x")), vx.calib_intent(F.col("x"))):
            df.select(c.alias("p")).collect()
            t = time.perf_counter()
            rows = df.select("x", c.alias("p")).collect()
            took[n] = took.get(n, 0) + time.perf_counter() - t
            assert len(rows) == 20
    assert took[1000] < 3 * took[100] + 1.0
    r = vector(5).select("x", vx.softmax(F.col("x")).alias("p"), vx.softmax_contrast(F.col("x")).alias("c"), vx.calib_intent(F.col("x")).alias("k")).collect()[3]
    e = [math.exp(v) for v in r.x]
    assert max(abs(a - b / sum(e)) for a, b in zip(r.p, e)) < 1e-12
    k = max(r.x) - sum(r.x) / 5
    e = [math.exp((v - max(r.x)) * k) for v in r.x]
    assert max(abs(a - b / sum(e)) for a, b in zip(r.c, e)) < 1e-12
    assert max(abs(a - v / sum(map(math.sqrt, r.x))) for a, v in zip(r.k, r.x)) < 1e-12
    assert spark.createDataFrame([(None,), ([],)], "x array<double>").select(vx.softmax(F.col("x")).alias("p")).collect()[0].p is None


def test_models_of_all_folds_read_the_texts_once(spark, corpus, monkeypatch):
    from parlance.operators import bayes

    df, sent = corpus
    head = md.fit("nb", df, "Question", "EmotionName")
    calls, tokens = [], bayes.tokens
    monkeypatch.setattr(bayes, "tokens", lambda c: calls.append(c) or tokens(c))
    ft.oof_features(head, df, sent, 3)
    assert len(calls) <= 2 + 2 * 3  # both tables once to learn, each fold by two models
    odd = [(1, "a b", "x", 0), (1, "a b", "x", 0), (2, None, "x", 1), (3, "b c", None, 1), (4, "", "y", 2), (5, "c", "y", None), (6, "d d", "z", 0)]
    df = spark.createDataFrame(odd, "ord long, t string, label string, fold int")
    for k, got in enumerate(bayes.train_folds(df, "t", "label", "fold", 3)):
        want = bayes.train(df.where(F.col("fold") != k), "t", "label")
        for a, b in ((got.classes, want.classes), (got.weights, want.weights)):
            assert a.schema.names == b.schema.names and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
