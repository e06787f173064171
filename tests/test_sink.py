"""The answer sink: repeated, failed and later batches."""

from pyspark.sql import functions as F

from parlance.streaming import sink


def records(spark, rows):
    return spark.createDataFrame(rows, "qid long, answer string, score double").withColumn("demand", F.struct(F.col("score").alias("similarity")))


def test_one_row_per_question_whatever_is_repeated(spark, tmp_path):
    base = str(tmp_path)
    first = records(spark, [(1, "a", 0.5), (2, 'quo"te\n', 0.25), (3, None, None)])
    for _ in range(2):  # the batch runs again after a failure
        sink.write_answers(first, base, 0)
    got = {r.qid: (r.batch_id, r.json) for r in sink.read_answers(spark, base).collect()}
    assert got.keys() == {1, 2, 3} and all(b == 0 for b, _ in got.values())
    sink.write_answers(records(spark, [(2, "new", 1.0), (4, "d", 0.0)]), base, 7)
    back = {r.qid: (r.answer, r.demand.similarity) for r in sink.parsed(sink.read_answers(spark, base), first).collect()}
    assert back == {1: ("a", 0.5), 2: ("new", 1.0), 3: (None, None), 4: ("d", 0.0)}


def test_a_batch_without_its_record_is_not_seen(spark, tmp_path):
    base = str(tmp_path)
    sink.write_answers(records(spark, [(1, "a", 0.5)]), base, 0)
    records(spark, [(1, "half", 0.5), (9, "half", 0.1)]).select("qid", F.to_json(F.struct("answer")).alias("json")).write.json(f"{base}/answers/batch_id=1")
    rows = sink.read_answers(spark, base).collect()
    assert [(r.qid, r.batch_id) for r in rows] == [(1, 0)]
    sink.write_answers(records(spark, []), base, 2)  # an empty batch
    assert sink.read_answers(spark, base).count() == 1
