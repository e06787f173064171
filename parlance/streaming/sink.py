"""Answer sink: JSON rows with a commit record by (batch, question) (#7).

A batch, of a job or of a stream, writes its answers to a folder of its own
and then records which questions it answered. A repeated batch replaces both.
Readers take, of every question, the answer of its latest recorded batch: a
batch that failed between the two writes is not seen, and a question answered
again is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.plans import answer as ans
from parlance.sources.catalog import Catalog
from parlance.streaming.answers import question_stream

ROW = "qid bigint, json string"


def write_answers(records: DataFrame, base: str, batch_id: int) -> None:
    """Answer records (any version) as JSON, then the commit record. Of rows
    with one qid in a batch, the one with the smallest JSON text stays."""
    spark = records.sparkSession
    at = f"{base}/answers/batch_id={int(batch_id)}"
    rows = ans.answers_json(records).groupBy("qid").agg(F.min("json").alias("json"))
    rows.write.mode("overwrite").json(at)
    # the record is made from what was written
    done = spark.read.schema(ROW).json(at).select("qid")
    done.write.mode("overwrite").parquet(f"{base}/commits/batch_id={int(batch_id)}")


def read_answers(spark: SparkSession, base: str) -> DataFrame:
    """(qid, batch_id, json): one row per question."""
    done = spark.read.schema("qid bigint, batch_id bigint").parquet(f"{base}/commits")
    last = done.groupBy("qid").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.schema(f"{ROW}, batch_id bigint").json(f"{base}/answers").join(last, ["qid", "batch_id"]).select("qid", "batch_id", "json")


def parsed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The records again, with the columns of ``like``."""
    cols = [c for c in like.columns if c != "qid"]
    schema = like.select(*cols).schema
    return rows.select("qid", F.from_json("json", schema).alias("r")).select("qid", *[F.col(f"r.{c}").alias(c) for c in cols])


def answer_stream_json(cat: Catalog, heads: ans.Heads, base: str, checkpoint: str, version: str = "2", stacked: bool = False) -> None:
    """Answers of a version to every question that arrives, through the sink,
    until the source is drained."""
    for _model in (heads.faq, heads.intent, heads.emo, heads.lookup):
        pass

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        write_answers(ans.answer(cat, heads, version, batch, stacked=stacked), base, batch_id)

    q = question_stream(cat.spark, cat.sf_dir).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
