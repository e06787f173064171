"""The streamed feature cache equals a batch refresh after every change set."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from parlance.operators import features as ft
from parlance.streaming import refresh as rf

SCHEMA = "ord long, seq long, op string, Question string, EmotionName string"
CHANGES = [
    [(i, 0, "put", f"text {i}", "up" if i % 2 else "down") for i in range(40)] + [(None, 0, "put", "no key", "up")],
    # one row changed twice, one deleted, one put again after its delete, one unchanged, an unknown one deleted
    [(1, 1, "put", "first", "up"), (1, 2, "put", "second", "down"), (2, 1, "delete", None, None), (3, 1, "delete", None, None), (3, 2, "put", "back", "up"), (4, 1, "put", "text 4", "down"), (99, 1, "delete", None, None)],
    [(2, 3, "put", None, "up"), (50, 3, "put", "new", "down"), (5, 3, "delete", None, None)],
    [(2, 4, "put", None, "up"), (6, 4, "put", "text 6", "up")],
]


def compute(rows):
    """Features by a rule, and a log of the rows that were computed."""
    f = F.array(F.length(F.coalesce("Question", F.lit(""))).cast("double"), F.lit(0.5))
    return rows.select("ord", "Question", "EmotionName", (F.col("EmotionName") == "up").cast("int").alias("label_emo"), f.alias("f"))


def state(sets):
    """Plain version: the rows after all change sets."""
    now = {}
    for s in sets:
        last = {}
        for o, seq, op, q, e in s:
            if o is not None and (o not in last or (seq, op == "delete") > last[o][:2]):
                last[o] = (seq, op == "delete", q, e)
        for o, (_, gone, q, e) in last.items():
            now.pop(o, None)
            if not gone:
                now[o] = (q, e)
    return now


def table(df):
    return {r.ord: (r.Question, r.EmotionName, r.label_emo, list(r.f)) for r in df.collect()}


def test_equals_batch_refresh_after_every_batch(spark, tmp_path):
    base, src, ckpt = (str(tmp_path / d) for d in ("cache", "in", "state"))
    seen = []

    def logged(rows):
        seen.append(sorted(r.ord for r in rows.select("ord").collect()))
        return compute(rows)

    cache = None
    for k, s in enumerate(CHANGES):
        spark.createDataFrame(s, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        rf.refresh_stream(stream, base, logged, ckpt, buckets=8)
        now = state(CHANGES[: k + 1])
        got = rf.read(spark, base)
        assert got.count() == len(now) and {o: v[:2] for o, v in table(got).items()} == now
        current = spark.createDataFrame([(o, q, e, int(e == "up")) for o, (q, e) in now.items()], "ord long, Question string, EmotionName string, label_emo int")
        # the batch form matches rows by their text, the stream by their key
        batch = ft.refresh(cache, current, 1, lambda rows: compute(rows))
        assert table(batch) == table(got)
        cache = batch
    assert seen[0] == list(range(40))
    assert seen[1] == [1, 3] and seen[2] == [2, 50] and seen[3] == [6]  # the unchanged rows 4 and 2 are not computed again


def test_only_touched_buckets_are_written(spark, tmp_path):
    base = str(tmp_path / "cache")
    for k, s in enumerate(CHANGES[:2]):
        rf.apply_batch(spark.createDataFrame(s, SCHEMA), base, k, compute, 8)
    want = {r.b for r in spark.createDataFrame(CHANGES[1], SCHEMA).select(rf.bucket_of(F.col("ord"), 8).alias("b")).collect()}
    by = {r.bucket: r.batch for r in rf.manifest(spark, base).collect()}
    assert 0 < len(want) < 8 and {b for b, k in by.items() if k == 1} == want
    wrote = {int(d[7:]) for d in os.listdir(f"{base}/data/batch=1") if d.startswith("bucket=")}
    assert wrote <= want


def test_a_repeated_batch_and_one_that_failed_before_its_manifest(spark, tmp_path):
    base = str(tmp_path / "cache")
    rf.apply_batch(spark.createDataFrame(CHANGES[0], SCHEMA), base, 0, compute, 8)
    before = table(rf.read(spark, base))
    rf.apply_batch(spark.createDataFrame(CHANGES[1], SCHEMA), base, 1, compute, 8)
    after = table(rf.read(spark, base))
    shutil.rmtree(f"{base}/manifest/v000002")  # as if the job died before it
    assert table(rf.read(spark, base)) == before
    for _ in range(2):
        rf.apply_batch(spark.createDataFrame(CHANGES[1], SCHEMA), base, 1, compute, 8)
        assert table(rf.read(spark, base)) == after


def test_empty_batches_deleted_tables_and_pruning(spark, tmp_path):
    base = str(tmp_path / "cache")
    assert rf.read(spark, base) is None
    rf.apply_batch(spark.createDataFrame([], SCHEMA), base, 0, compute, 4)
    assert rf.read(spark, base) is None and rf.manifest(spark, base).count() == 4
    rf.apply_batch(spark.createDataFrame(CHANGES[0], SCHEMA), base, 1, compute)
    held = table(rf.read(spark, base))
    rf.apply_batch(spark.createDataFrame([], SCHEMA), base, 2, compute)
    assert table(rf.read(spark, base)) == held
    rf.apply_batch(spark.createDataFrame([(i, 9, "put", "again", "up") for i in range(40)], SCHEMA), base, 3, compute)
    rf.apply_batch(spark.createDataFrame([(i, 9, "put", "more", "up") for i in range(40)], SCHEMA), base, 4, compute)
    assert rf.prune(spark, base) and set(v[0] for v in table(rf.read(spark, base)).values()) == {"more"}
    rf.apply_batch(spark.createDataFrame([(i, 10, "delete", None, None) for i in range(40)], SCHEMA), base, 5, compute)
    assert rf.read(spark, base) is None


@pytest.mark.parametrize("n", [1, 300])
def test_a_hot_row_of_many_changes(spark, tmp_path, n):
    base = str(tmp_path / "cache")
    many = spark.range(n).select(F.lit(7).cast("long").alias("ord"), F.col("id").alias("seq"), F.lit("put").alias("op"), F.concat(F.lit("t"), F.col("id")).alias("Question"), F.lit("up").alias("EmotionName"))
    rf.apply_batch(many, base, 0, compute, 4)
    assert {o: v[0] for o, v in table(rf.read(spark, base)).items()} == {7: f"t{n - 1}"}
