"""A training-data pipeline over ``documents``: toxicity, near duplicates,
repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of ``documents``. Null texts pass every stage as empty ones, repeated
rows and ids are rows of their own, and an empty table passes empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, mixing, ngram_join, run_index, toxicity
from parlance.llm.common import crc_mod5, written

SHINGLE, PERCENT = 5, 80  # near duplicates: five words, similarity 0.8
PASSAGE = 200  # bytes of a repeated passage; 50 words are longer
TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not mark (score below 0.5). It
    learns from the labels outside the held-out fold and the texts of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod5("doc_id") != 0)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the
    smallest id, of rows with equal ids the one with the smallest text hash,
    of equal rows one. Documents without words are no one's copies; all of
    them stay."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("th"))
    rows = docs.withColumn("_key", key)
    found = ngram_join.join(rows.select("_key", "text"), SHINGLE, PERCENT, id_col="_key")
    keep = written(found.where((F.col("_key") == F.col("component_id")) & (F.col("n_shingles") > 0)).select("_key").distinct(), "kept")
    # both steps go by the key, so the texts are shuffled once
    low = rows.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
    # no byte but the blanks between words
    wordless = docs.where(F.coalesce("text", F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z"))
    return low.union(wordless.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE bytes or more that
    occur more than once; ``n_chars`` follows the text."""
    out = run_index.without_repeats(docs, PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    out = mixing.mix(docs)
    return out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ``ids``, ``n_tokens``, and whether the ids decode
    to the text (``round_trip``)."""
    path = public_tokenizers.path(TOKENIZER)
    out = bpe.encode(docs.select("doc_id", "source", "lang", "text"), path, check=True)
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

# The first stage learns a model, which SQL cannot express; the stages are
# tested one by one against brute force (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
