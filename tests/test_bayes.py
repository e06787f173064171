import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.operators import bayes

# Han characters one by one, other letter runs whole, digit runs (the engine's tokens).
TOK = re.compile(r"[\u4e00-\u9fff]|[^\W\d_\u4e00-\u9fff]+|\d+")


def _toks(s):
    return TOK.findall(s.lower())


def _dense(train, questions):
    """Brute force: every question x every class."""
    labels = sorted({y for _, y in train})
    docs = Counter(y for _, y in train)
    cnt = {y: Counter() for y in labels}
    for t, y in train:
        cnt[y].update(_toks(t))
    vocab = set().union(*cnt.values())
    n = len(train)
    out = {}
    for qid, text in questions:
        tf = Counter(t for t in _toks(text) if t in vocab)
        s = []
        for y in labels:
            ntok = sum(cnt[y].values())
            s.append(math.log(docs[y] / n) + sum(c * math.log((cnt[y][t] + 1) / (ntok + len(vocab))) for t, c in tf.items()))
        m = max(s)
        z = sum(math.exp(v - m) for v in s)
        out[qid] = [math.exp(v - m) / z for v in s]
    return out


@pytest.fixture(scope="module")
def toy(spark):
    train = [
        ("cheap flights to paris", "travel"), ("book a hotel in rome", "travel"), ("flight delayed again", "travel"),
        ("my card was charged twice", "billing"), ("refund my card", "billing"), ("invoice is wrong", "billing"),
        ("app crashes on start", "tech"), ("cannot login to app", "tech"), ("reset my password", "tech"),
        ("hello there", "chat"), ("瀏覽器打不開", "tech"), ("刷卡 問題", "billing"),
    ]
    questions = [(1, "card refund please"), (2, "app login fails"), (3, "zzz unknown words"), (4, "瀏覽器無法打開"),
                 (5, "flight to rome hotel"), (6, "")]
    tdf = spark.createDataFrame(train, "Text string, label string")
    qdf = spark.createDataFrame(questions, "qid long, text string")
    return bayes.train(tdf, "Text", "label"), qdf, _dense(train, questions)


def test_vector_matches_brute_force(toy):
    model, q, want = toy
    got = {r.qid: r.proba for r in bayes.score_vector(model, q, "text").collect()}
    for qid, p in want.items():
        assert abs(sum(got[qid]) - 1) < 1e-9
        assert max(abs(a - b) for a, b in zip(got[qid], p)) < 1e-9


@pytest.mark.parametrize("k", [1, 2, 4])
def test_sparse_topk_matches_brute_force(toy, k):
    model, q, want = toy
    got = {}
    for r in bayes.score_topk(model, q, "text", k).collect():
        got.setdefault(r.qid, []).append((r.rank, r.cls, r.p))
    for qid, p in want.items():
        order = sorted(range(len(p)), key=lambda c: (-p[c], -c))[:k]
        rows = sorted(got[qid])
        assert [c for _, c, _ in rows] == order
        assert max(abs(pp - p[c]) for _, c, pp in rows) < 1e-9
        assert all(rows[i][2] >= rows[i + 1][2] for i in range(len(rows) - 1))


def test_no_cartesian_in_topk_plan(toy):
    model, q, _ = toy
    plan = bayes.score_topk(model, q, "text", 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_shuffle_path_equals_broadcast_path(toy, monkeypatch):
    model, q, want = toy
    a = sorted((r.qid, r.rank, r.cls, round(r.p, 12)) for r in bayes.score_topk(model, q, "text", 3).collect())
    monkeypatch.setattr(bayes, "MAX_MODEL_BROADCAST_ROWS", 0)
    b = sorted((r.qid, r.rank, r.cls, round(r.p, 12)) for r in bayes.score_topk(model, q, "text", 3).collect())
    assert a == b


def test_exact_ties_go_to_higher_class_index(spark):
    train = [("x y", "a"), ("z w", "b"), ("p q", "c"), ("p q r s", "d")]
    model = bayes.train(spark.createDataFrame(train, "Text string, label string"), "Text", "label")
    q = spark.createDataFrame([(1, "nothing known"), (2, "x")], "qid long, text string")
    got = {}
    for r in bayes.score_topk(model, q, "text", 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.cls))
    # with no known token the score is the prior alone: all four tie, higher index first
    assert [c for _, c in sorted(got[1])] == [3, 2, 1]
    assert sorted(got[2])[0][1] == 0  # "x" only seen in class a


def test_sparse_topk_agrees_with_vector_topk(toy):
    from parlance.functions import vectors as vx

    model, q, _ = toy
    sparse = {(r.qid, r.rank): (r.cls, round(r.p, 12)) for r in bayes.score_topk(model, q, "text", 3).collect()}
    vec = bayes.score_vector(model, q, "text").select("qid", vx.topk(F.col("proba"), 3).alias("t")).collect()
    dense = {(r.qid, i + 1): (e.idx, round(e.p, 12)) for r in vec for i, e in enumerate(r.t)}
    assert sparse.keys() == dense.keys()
    for key, (c, p) in dense.items():
        assert sparse[key][0] == c and abs(sparse[key][1] - p) < 1e-9


def test_heads_with_many_classes(spark):
    """1,000 classes: rankings, full vectors and evaluation, with at most k
    classes per question written."""
    from parlance.operators import models as md

    rows = [(i, f"w{i % 250} v{i % 40} common", f"c{i:04d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "ord long, Text string, label string")
    model = bayes.train(df, "Text", "label")
    q = df.where("ord % 50 = 0").select(F.col("ord").alias("qid"), F.col("Text").alias("text"))
    want = _dense([(t, y) for _, t, y in rows], [(i, t) for i, t, _ in rows if i % 50 == 0])
    got = {}
    for r in bayes.score_topk(model, q, "text", 4).collect():
        got.setdefault(r.qid, []).append((r.rank, r.cls, r.p))
    for qid, p in want.items():
        order = sorted(range(1000), key=lambda c: (-round(p[c], 12), -c))[:4]
        assert [c for _, c, _ in sorted(got[qid])] == order
    vec = bayes.score_vector(model, q, "text").collect()
    assert len(vec) == 20 and all(len(r.proba) == 1000 and abs(sum(r.proba) - 1) < 1e-9 for r in vec)
    per_q = bayes._per_question(model, q, "text", 4)
    assert per_q.count() == 20 and per_q.select(F.max(F.size("top"))).first()[0] <= 4
    head = md.HeadModel("nb", "label", model.decode(), nb=model)
    r = md.eval_report(head, df.where("ord % 50 = 0").union(df.where("ord = 0")), "Text", "x").first()
    loss = [-math.log(want[i][i]) for i in want]
    right = [max(range(1000), key=lambda c: (round(want[i][c], 12), c)) == i for i in want]
    assert r.n == 21 and abs(r.log_loss - (sum(loss) + loss[0]) / 21) < 1e-3 and abs(r.accuracy - (sum(right) + right[0]) / 21) < 1e-3


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("aqe", ["true", "false"])
def test_label_index_is_dense_under_any_setting(spark, reuse, aqe):
    from parlance.operators.encode import dense_index

    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        df = spark.range(30000).select((F.col("id") * 7919 % 20011).alias("x"))
        got = [r.idx for r in dense_index(df, "x").orderBy("x").collect()]
        assert got == list(range(20011))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
