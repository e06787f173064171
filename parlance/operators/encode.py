"""Label encoding, character vocabulary and fixed-length encodings (#40, #41, #55-#58).

The vocabulary is bounded (``VOCAB_TARGET`` entries), so it travels to
every row as one value of id pages and encoding is a narrow projection: no
explode / join / re-collect of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import chars
from parlance.operators.util import broadcast_if_bounded, materialize

# Vocabulary target size (ids 0..8191), id 0 pads, the last
# used id is the unknown-character id.
VOCAB_TARGET = 2 ** 13
PAD_ID = 0


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Distinct values of ``col`` numbered 0..n-1 in ascending order (#40).

    Range-partitioned sort, row numbers inside each range, then each range
    is offset by the sizes of the ranges before it (a table with one row per
    partition). No step holds more than one range. The ranges are written
    once: a second evaluation of the sort could draw other borders.
    """
    d = materialize(df.select(col).distinct().orderBy(col).withColumn("_pid", F.spark_partition_id()))
    d = d.withColumn("_pos", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    sizes = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, ["_off"])
    return (
        d.join(broadcast_if_bounded(offs, 100_000), "_pid")
        .select(col, (F.col("_off") + F.col("_pos") - 1).cast("int").alias(out))
    )


def label_encode(df: DataFrame, label: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Add ``out`` = index of ``label`` among its sorted distinct values.

    Returns (encoded rows, decode table ``(out, label)``). Numeric labels
    sort as numbers, string labels as strings.
    """
    table = dense_index(df, label, out)
    return df.join(table, label), table.select(out, label)


def char_vocab(df: DataFrame, col: str, target: int = VOCAB_TARGET) -> DataFrame:
    """Character vocabulary: (ch, id, cnt), id 1.. by count desc, char asc (#55).

    Keeps ``target - 2`` characters so that pad (0) and unknown fit in the
    target size. The top-k window ships at most that many rows per task.
    """
    counts = df.select(F.explode(chars(F.col(col))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.orderBy(F.col("cnt").desc(), F.col("ch"))
    return counts.withColumn("id", F.row_number().over(w)).filter(F.col("id") <= target - 2).select("ch", "id", "cnt")


def vocab_pages(vocab: DataFrame) -> Column:
    """The bounded vocabulary as one value: ids in pages of 256 code points,
    and the number of entries. A lookup is two array accesses, however many
    characters the vocabulary holds."""
    cp = F.ascii("ch")
    entry = F.struct(cp.bitwiseAND(F.lit(255)).alias("low"), F.col("id").cast("int").alias("id"))
    page = vocab.groupBy(F.shiftright(cp, 8).alias("page")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.count(F.lit(1)).alias("k"))
    page = page.select("page", "k", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.try_element_at("m", i)).alias("ids"))
    whole = page.agg(F.map_from_entries(F.collect_list(F.struct("page", "ids"))).alias("p"), F.max("page").alias("top"), F.sum("k").cast("int").alias("n"))
    pages = F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.try_element_at("p", i))
    empty = F.array().cast("array<array<int>>")
    return whole.select(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.when(F.col("top").isNotNull(), pages), empty).alias("pages"))).scalar()


def _ids(text: Column, v: Column) -> Column:
    """Ids of the characters; all characters outside the vocabulary share the
    one id after its last (the reference spells them out in bytes)."""

    def one(c: Column) -> Column:
        cp = F.ascii(c)
        return F.coalesce(F.get(F.get(v["pages"], F.shiftright(cp, 8)), cp.bitwiseAND(F.lit(255))), v["n"] + 1)

    return F.transform(chars(text), one)


def pad_post(ids: Column, maxlen: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(maxlen - F.size(ids), F.lit(0))))


def encode_pad(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """ids per text, zero-padded at the end to the corpus' longest text (#56)."""
    maxlen = df.select(F.max(F.length(col))).scalar()
    df = df.withColumn("_v", vocab_pages(vocab)).withColumn("_m", maxlen)
    return df.withColumn(out, pad_post(_ids(F.col(col), F.col("_v")), F.col("_m"))).drop("_v", "_m")


def encode_query(df: DataFrame, col: str, vocab: DataFrame, maxlen: Column, out: str = "ids") -> DataFrame:
    """Encode at scoring time: over-long input loses its front, then pad at the end (#57)."""
    df = df.withColumn("_v", vocab_pages(vocab)).withColumn("_m", maxlen)
    ids = _ids(F.col(col), F.col("_v"))
    kept = F.slice(ids, F.greatest(F.size(ids) - F.col("_m") + 1, F.lit(1)), F.col("_m"))
    return df.withColumn(out, pad_post(kept, F.col("_m"))).drop("_v", "_m")


def encode_mask(df: DataFrame, col: str, vocab: DataFrame, max_length: Column, out: str = "ids") -> DataFrame:
    """Fixed length with attention mask: truncate the tail, pad on the left (#58).

    Adds ``out`` and ``mask`` (1 for a real id, 0 for padding).
    """
    df = df.withColumn("_v", vocab_pages(vocab)).withColumn("_m", max_length)
    kept = F.slice(_ids(F.col(col), F.col("_v")), 1, F.col("_m"))
    df = df.withColumn("_k", kept)
    n_pad = F.greatest(F.col("_m") - F.size("_k"), F.lit(0))
    return (
        df.withColumn(out, F.concat(F.array_repeat(F.lit(PAD_ID), n_pad), F.col("_k")))
        .withColumn("mask", F.concat(F.array_repeat(F.lit(0), n_pad), F.array_repeat(F.lit(1), F.size("_k"))))
        .drop("_v", "_m", "_k")
    )


def corpus_stats(df: DataFrame, col: str, label: str, vocab: DataFrame) -> DataFrame:
    """One row: rows, vocab_size (with pad and unknown), maxlen, n_classes, batch (#41).

    batch = floor(rows ** (1/e)), the reference's batch-size rule.
    """
    v = vocab.select((F.count(F.lit(1)) + 2).alias("vocab_size"))
    s = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.length(col)).alias("maxlen"),
        F.count_distinct(label).alias("n_classes"),
    )
    return s.withColumn("vocab_size", v.scalar()).withColumn(
        "batch", F.floor(F.pow(F.col("n_rows").cast("double"), F.lit(1 / math.e))).cast("long")
    ).select("n_rows", "vocab_size", "maxlen", "n_classes", "batch")
