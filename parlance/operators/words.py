"""Frequent words (#21, #27, #34, #35).

explode -> anti join stop words -> count per (length, word) with a
map-side combine -> top k per length. The top-k window carries a partial
group limit, so each task ships at most k words per length to the final
step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import words
from parlance.operators.util import broadcast_if_bounded


def word_counts(df: DataFrame, col: str, stop: DataFrame, lengths: list[int], segmenter=None) -> DataFrame:
    """(word_len, word, cnt) over words of the given lengths, stop words removed.

    ``segmenter`` (Column -> array<string>) replaces the default word split.
    """
    seg = segmenter or words
    w = (
        df.select(F.explode(seg(F.col(col))).alias("word"))
        .withColumn("word_len", F.length("word"))
        .filter(F.col("word_len").isin(lengths))
    )
    stop_words = stop.select(F.col("Text").alias("word")).filter(F.col("word").isNotNull())
    w = w.join(broadcast_if_bounded(stop_words), "word", "left_anti")
    return w.groupBy("word_len", "word").agg(F.count(F.lit(1)).alias("cnt"))


def top_words(df: DataFrame, col: str, stop: DataFrame, lengths: list[int], k: int = 10, segmenter=None) -> DataFrame:
    """Top ``k`` words of each length, by count desc then word asc (#34).

    Output: word_len, rank, word, cnt.
    """
    counts = word_counts(df, col, stop, lengths, segmenter)
    w = Window.partitionBy("word_len").orderBy(F.col("cnt").desc(), F.col("word"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "word_len", "rank", "word", "cnt"
    )


def cloud_words(df: DataFrame, col: str, stop: DataFrame, lengths=(2, 3, 4), k: int = 10) -> DataFrame:
    """Word-cloud input: top words for each length joined by spaces, lengths in order (#35).

    One row: ``cloud`` (the joined string) and ``n_words``.
    """
    top = top_words(df, col, stop, list(lengths), k)
    return top.select(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("word_len", "rank", "word"))), lambda s: s["word"]
            ),
            " ",
        ).alias("cloud"),
        F.count(F.lit(1)).alias("n_words"),
    )

