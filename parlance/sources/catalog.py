"""Table scan by role (#1) and the input roles of FIXTURES.md.

A ``Catalog`` maps a logical role (``faq``, ``intent``, ``emo`` ...) to a
lazy DataFrame. Roles can come from parquet files, catalog tables or a
JDBC database; the default binding derives every role from the shared
test tables in ``sf_dir`` exactly as FIXTURES.md states, so that Spark and
the DuckDB oracle read the same rows.

Every role carries an ``ord`` column: first-wins semantics (first synonym,
keep-first dedup, first-match lookup) are defined by it, never by file
order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# ---------------------------------------------------------------------------
# Fixed values of the literal roles (FIXTURES.md). Option keys are the ones
# the reference reads; values and model names are ours.
# ---------------------------------------------------------------------------
SYN_ROWS = [
    (1, 10, "le"), (2, 10, "the"), (3, 20, None), (4, 20, "und"), (5, 20, "and"),
    (6, 30, "la"), (7, 30, "le"), (8, 40, "of the"), (9, 40, "of"),
]
STOP_ROWS = ["the", "and", "of", "de", "la", "der", "to", "in"]
OPTION_ROWS = [
    (1, "SimilarityFAQBot", "0.6"), (2, "SimilarityIntentionBot", "0.8"), (3, "ChatBotKind", "1"),
    (4, "4000Faq", "1"), (5, "4000Intention", "2"), (6, "4000Emo", "4"), (7, "SimilarityFAQBot", "0.9"),
]
BOT_MODEL_ROWS = [(1, 1, "nb"), (2, 2, "logreg"), (3, 3, "mlp"), (4, 4, "rf"), (5, 2, "a later name")]
SCRIPT_MAP_ROWS = [(1, "straße", "strasse"), (2, "ß", "ss"), (3, "é", "e"), (4, "ç", "c")]

# Turns of a conversation that a key can tell apart.
TURNS = 1 << 24


def turn_key() -> Column:
    """One number for (conv_id, turn). A turn that would run into the next
    conversation's keys is an error; a null part gives a null key."""
    turn = F.col("turn")
    inside = (turn >= 0) & (turn < TURNS)
    return F.when(turn.isNull() | inside, F.col("conv_id") * TURNS + turn).otherwise(
        F.raise_error(F.concat(F.lit(f"a turn must lie between 0 and {TURNS - 1}, not be "), turn.cast("string"))).cast("bigint")
    )


SYN_SCHEMA = "ord int, SynonymId bigint, Text string"
STOP_SCHEMA = "Text string"
OPTION_SCHEMA = "ord int, Key string, Value string"
BOT_MODEL_SCHEMA = "ord int, Id int, Name string"
SCRIPT_MAP_SCHEMA = "ord int, src string, dst string"


@dataclass
class Catalog:
    """Role -> DataFrame binding.

    ``overrides`` maps a role to a DataFrame, a parquet path, a table name
    (``table:db.t``) or JDBC options (a dict with ``url`` and ``dbtable``).
    Roles without an override are derived from ``sf_dir``.
    """

    spark: SparkSession
    sf_dir: str
    overrides: dict = field(default_factory=dict)

    # -- raw tables ---------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def read(self, role: str) -> DataFrame:
        src = self.overrides.get(role)
        if src is None:
            return getattr(self, f"_role_{role}")()
        return read_source(self.spark, src)

    # -- derived roles (FIXTURES.md) ----------------------------------------
    def _role_faq(self) -> DataFrame:
        conv = self.table("conversations")
        # first user and first assistant text of a conversation, in one aggregate
        first = conv.groupBy("conv_id").agg(
            *[F.min_by("text", F.when(F.col("role") == r, F.col("turn"))).alias(c) for r, c in (("user", "Demand"), ("assistant", "Supply"))]
        )
        return (
            conv.filter(F.col("role") == "user")
            .join(first, "conv_id")
            .select(
                turn_key().alias("ord"),
                F.col("text").alias("Text"),
                F.col("conv_id").alias("FaqSettingId"),
                "Demand",
                "Supply",
            )
        )

    def _role_intent(self) -> DataFrame:
        docs = self.table("documents")
        n_conv = self.table("conversations").select(F.count_distinct("conv_id")).scalar()
        return docs.select(
            F.col("doc_id").alias("ord"),
            F.col("text").alias("Text"),
            F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("int"))
            .otherwise((F.col("doc_id") % 3).cast("int"))
            .alias("Rank"),
            F.col("lang").alias("IntentionName"),
            (F.col("doc_id") % n_conv).alias("FaqSettingId"),
        )

    def _role_emo(self) -> DataFrame:
        return (
            self.table("documents")
            .join(self.table("labels"), "doc_id")
            .select(
                F.col("doc_id").alias("ord"),
                F.col("text").alias("Question"),
                F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("EmotionName"),
            )
        )

    def _role_sent(self) -> DataFrame:
        return (
            self.table("documents")
            .join(self.table("labels"), "doc_id")
            .select(F.col("doc_id").alias("ord"), "text", F.col("quality").alias("positive"))
        )

    def _role_questions(self) -> DataFrame:
        conv = self.table("conversations")
        return conv.filter(F.col("role") == "user").select(
            turn_key().alias("qid"),
            "text",
            F.when(F.col("turn") % 4 == 0, F.lit("0.9")).alias("threshold_faq"),
            F.lit(None).cast("string").alias("threshold_intent"),
        )

    def _role_syn(self) -> DataFrame:
        return self.spark.createDataFrame(SYN_ROWS, SYN_SCHEMA)

    def _role_stop(self) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in STOP_ROWS], STOP_SCHEMA)

    def _role_options(self) -> DataFrame:
        return self.spark.createDataFrame(OPTION_ROWS, OPTION_SCHEMA)

    def _role_bot_model(self) -> DataFrame:
        return self.spark.createDataFrame(BOT_MODEL_ROWS, BOT_MODEL_SCHEMA)

    def _role_script_map(self) -> DataFrame:
        return self.spark.createDataFrame(SCRIPT_MAP_ROWS, SCRIPT_MAP_SCHEMA)


def read_source(spark: SparkSession, src) -> DataFrame:
    """Read one role binding: DataFrame, parquet path, ``table:`` name or JDBC dict."""
    if isinstance(src, DataFrame):
        return src
    if isinstance(src, dict):
        opts = dict(src)
        fmt = opts.pop("format", "jdbc")
        return spark.read.format(fmt).options(**opts).load()
    if isinstance(src, str) and src.startswith("table:"):
        return spark.read.table(src[len("table:"):])
    return spark.read.parquet(src)


def scan_role(cat: Catalog, role: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """``SELECT cols FROM role WHERE ...``: the projection and filter reach the scan."""
    df = cat.read(role)
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df

