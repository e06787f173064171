"""Stateless stream scoring equals the batch, in one narrow stage."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import models as md
from parlance.streaming import scoring as sc

TRAIN = [("my card was charged twice", "billing"), ("refund my card", "billing"), ("invoice is wrong", "billing"), ("app crashes on start", "tech"), ("cannot login to app", "tech"), ("reset my password", "tech")]


@pytest.fixture(scope="module")
def heads(spark):
    df = spark.createDataFrame(TRAIN, "Text string, label string")
    return {k: md.fit(k, df, "Text", "label") for k in ("logreg", "nb")}


def test_stream_equals_batch(spark, heads, tmp_path):
    rows = [(i, t, None if i % 2 else "0.9") for i, t in enumerate([t for t, _ in TRAIN] + ["card app", None, ""])]
    schema = "qid long, text string, threshold_faq string"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = sc.score_stream(heads["logreg"], stream, out, state)
    assert len(q.recentProgress) >= 3  # several micro-batches
    read = lambda d: sorted((r.qid, r.text, r.threshold_faq, r.cls, r.label, round(r.p, 12)) for r in d.select("qid", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("threshold_faq", F.lit("")).alias("threshold_faq"), "cls", "label", "p").collect())
    got = read(spark.read.parquet(out))
    batch = spark.createDataFrame(rows, schema)
    assert got == read(sc.scored(heads["logreg"], batch)) and len(got) == 9
    vector = {r.qid: max(r.proba) for r in md.predict_proba(heads["logreg"], batch.fillna("", ["text"])).collect()}
    assert all(abs(p - vector[i]) < 1e-9 for i, *_, p in got)
    assert {l for i, *_, l, _ in got if i < 3} == {"billing"} and {l for i, *_, l, _ in got if 3 <= i < 6} == {"tech"}
    sc.score_stream(heads["logreg"], stream, out, state)  # nothing new arrives
    assert read(spark.read.parquet(out)) == got


def test_plan_is_one_narrow_stage(spark, heads):
    df = spark.createDataFrame([(1, "card")], "qid long, text string")
    plan = sc.scored(heads["logreg"], df)._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert "Exchange" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_relational_kinds_are_refused(spark, heads):
    with pytest.raises(ValueError, match="groups per question"):
        sc.scored(heads["nb"], spark.createDataFrame([(1, "x")], "qid long, text string"))
