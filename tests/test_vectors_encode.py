import math

from pyspark.sql import functions as F

from parlance.functions import vectors as vx
from parlance.operators import encode as enc


def test_softmax_and_topk(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.5],), ([1000.0, 1001.0],)], "x array<double>")
    r = df.select(vx.softmax(F.col("x")).alias("p"), vx.topk(F.col("x"), 3).alias("t")).collect()
    assert abs(sum(r[0].p) - 1) < 1e-12 and abs(sum(r[1].p) - 1) < 1e-12  # no overflow
    assert [e.idx for e in r[0].t] == [2, 1, 0]  # tie: higher index first
    e = [math.exp(v) for v in (1.0, 3.0, 3.0, 0.5)]
    assert abs(r[0].p[0] - e[0] / sum(e)) < 1e-12


def test_calibrations(spark):
    df = spark.createDataFrame([([0.25, 0.04],)], "x array<double>")
    r = df.select(vx.calib_faq(F.col("x")).alias("a"), vx.calib_intent(F.col("x")).alias("b")).first()
    assert [round(v, 9) for v in r.a] == [0.5, 0.2]
    assert [round(v, 9) for v in r.b] == [round(0.25 / 0.7, 9), round(0.04 / 0.7, 9)]


def test_dense_index_consecutive(spark):
    df = spark.createDataFrame([(v,) for v in [30, 10, 20, 10, 1000, 5]], "v long").repartition(3)
    got = sorted((r.v, r.idx) for r in enc.dense_index(df, "v").collect())
    assert got == [(5, 0), (10, 1), (20, 2), (30, 3), (1000, 4)]


def test_encoders(spark):
    corpus = spark.createDataFrame([(1, "aab"), (2, "abc")], "ord long, t string")
    vocab = enc.char_vocab(corpus, "t")
    ids = {r.ch: r.id for r in vocab.collect()}
    assert ids == {"a": 1, "b": 2, "c": 3}  # count desc, char asc
    padded = {r.ord: r.ids for r in enc.encode_pad(corpus, "t", vocab).collect()}
    assert padded == {1: [1, 1, 2], 2: [1, 2, 3]}
    q = spark.createDataFrame([(1, "zabca"), (2, "a")], "qid long, t string")
    got = {r.qid: r.ids for r in enc.encode_query(q, "t", vocab, F.lit(3)).collect()}
    assert got == {1: [2, 3, 1], 2: [1, 0, 0]}  # front dropped; unknown z would be 4
    m = {r.qid: (r.ids, r.mask) for r in enc.encode_mask(q, "t", vocab, F.lit(3)).collect()}
    assert m == {1: ([4, 1, 2], [1, 1, 1]), 2: ([0, 0, 1], [0, 0, 1])}
