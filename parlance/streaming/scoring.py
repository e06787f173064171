"""Stateless scoring of a stream by a ``spark.ml`` head (#75).

A fitted pipeline is a chain of row-wise steps, so a question is scored in the
one narrow stage that reads it: append mode, no ``foreachBatch``, no shuffle
and no state. The relational kinds group per question and go through
``answers.answer_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import vectors as vx
from parlance.operators import models as md
from parlance.operators.util import broadcast_if_bounded


def scored(head: md.HeadModel, questions: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``questions``, a table or a stream, with ``cls``, its label
    and ``p``, the probability of that class. A null text scores as an empty
    one; the decode table meets the rows by broadcast below a checked size,
    else by a join that a stream also allows."""
    if head.ml is None:
        raise ValueError(f"kind {head.kind!r} groups per question; only {md.ML_KINDS} score a stream row by row")
    own = md.text_col(head)
    rows = questions.withColumn("_q", F.struct(*questions.columns))
    out = head.ml.transform(rows.select("_q", F.coalesce(F.col(text), F.lit("")).alias(own)))
    best = vx.topk(md.vector_to_array("probability"), 1)
    out = out.select("_q", best.alias("_b")).select("_q", F.col("_b")[0]["idx"].alias("cls"), F.col("_b")[0]["p"].alias("p"))
    out = out.join(broadcast_if_bounded(head.decode), "cls", "left")
    return out.select("_q.*", "cls", head.label, "p")


def score_stream(head: md.HeadModel, questions: DataFrame, out: str, checkpoint: str, text: str = "text"):
    """Append the scored rows of a stream to Parquet under ``out`` until the
    source is drained; the sink's own log keeps a repeated batch from adding
    rows. Returns the finished query."""
    q = scored(head, questions, text).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
