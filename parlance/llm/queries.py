"""The registered queries of this package: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import bpe, byte_prefix, cotraining, fill_middle, hmm, int8_join, mixing, ngram_join, periods, prefix_counts, run_index, toxicity, vp_search
from parlance.llm.common import crc_mod5, written

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_int8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_join.link(table(spark, sf_dir, "embeddings"))


def op3_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.removals(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.mix(written(docs, "sizes"), size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod5("doc_id") == 1)


def op11_byte_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_prefix.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.with_cycles(table(spark, sf_dir, "documents")), least=12)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_int8_neardup": op2_int8_neardup,
    "op3_vp_search": op3_vp_search,
    "op4_run_index": op4_run_index,
    "op5_bpe": op5_bpe,
    "op6_ngram_join": op6_ngram_join,
    "op7_cotraining": op7_cotraining,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_hmm": op10_hmm,
    "op11_byte_prefix": op11_byte_prefix,
    "op12_fill_middle": op12_fill_middle,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
