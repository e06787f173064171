"""Sentiment, emotion features and the incremental feature cache (#2, #3, #24-#26, #38, #39, #65, #66).

Feature rows: (ord, Question, EmotionName, label_emo, f) with
f = [emotion-head class probabilities..., sentiment].

The cache lives in versioned folders under a base path in shared
storage, one base per kind and model (``cache_base``): features of another
model are never read. Each refresh writes ``v<N+1>`` and never overwrites the version
being read; the highest complete version is current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import bayes

KEYS = ["Question", "EmotionName", "label_emo"]


# ---------------------------------------------------------------------------
# sentiment (#65)
# ---------------------------------------------------------------------------
def train_sentiment(sent: DataFrame) -> bayes.NBModel:
    """Binary NB from a labelled table (text, positive 0/1)."""
    return bayes.train(sent, "text", "positive")


def sentiment(model: bayes.NBModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentiment) = p(positive = 1), 0..1; 0 when the model has no positive class."""
    q = df.select(F.col(key).alias("qid"), F.col(text).alias("text"))
    v = bayes.score_vector(model, q, "text")
    pos = model.classes.select(F.max(F.when(F.col("positive") == 1, F.col("cls")))).scalar()
    return v.withColumn("_pos", pos).select(
        F.col("qid").alias(key),
        F.coalesce(F.get(F.col("proba"), F.col("_pos")), F.lit(0.0)).alias("sentiment"),
    )


# ---------------------------------------------------------------------------
# emotion features (#66)
# ---------------------------------------------------------------------------
def emo_features(emo_head, sent_model: bayes.NBModel, rows: DataFrame) -> DataFrame:
    """Features of corpus rows (ord, Question, EmotionName).

    ``emo_head`` is a ``models.HeadModel`` of any kind. Each distinct row
    key is scored once; balancing copies share the features of their
    original.
    """
    from parlance.operators import models

    label = emo_head.decode.select(F.col("cls").alias("label_emo"), "EmotionName")
    rows = rows.drop("label_emo")
    uniq = rows.select("ord", "Question").distinct()
    q = uniq.select(F.col("ord").alias("qid"), F.col("Question").alias("text"))
    proba = models.predict_proba(emo_head, q, "text").select(F.col("qid").alias("ord"), "proba")
    sent = sentiment(sent_model, uniq, "ord", "Question")
    f = proba.join(sent, "ord").select("ord", F.concat("proba", F.array("sentiment")).alias("f"))
    from parlance.operators.util import broadcast_if_bounded

    return rows.join(broadcast_if_bounded(label), "EmotionName").join(f, "ord").select("ord", "Question", "EmotionName", "label_emo", "f")


# ---------------------------------------------------------------------------
# out-of-fold features (#67)
# ---------------------------------------------------------------------------
FOLDS = 3


def fold_of(key: str, folds: int = FOLDS) -> Column:
    """Fold of a row by hash of its key: copies of a row share a fold, however
    the rows are dealt to tasks."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit("|fold")))
    return (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % folds).cast("int")


def oof_features(emo_head, rows: DataFrame, sent: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Features of corpus rows, each from models that did not see it.

    For every fold, an emotion head of the kind of ``emo_head`` and a
    sentiment model learn from the rows (and the sentiment table's rows) of
    the other folds and give the features of this one. Probabilities are laid
    out by the classes of ``emo_head``; a class that occurs in one fold only
    has probability 0 there. Adds the column ``fold``.
    """
    from parlance.operators import models
    from parlance.operators.util import broadcast_if_bounded, materialize

    if folds < 2:
        raise ValueError("out-of-fold features need two folds or more")
    rows = materialize(rows.drop("label_emo").withColumn("fold", fold_of("ord", folds)))
    sent = materialize(sent.withColumn("fold", fold_of("ord", folds)))
    # copies of a row are scored once
    uniq = materialize(rows.select("ord", "Question", "fold").distinct())
    heads = models.fit_folds(emo_head.kind, rows, "Question", "EmotionName", "fold", folds)
    feelings = bayes.train_folds(sent, "text", "positive", "fold", folds)
    out = None
    for k, (head, feeling) in enumerate(zip(heads, feelings)):
        mine = uniq.where(F.col("fold") == k).select("ord", "Question")
        proba = models.predict_proba(head, mine.select(F.col("ord").alias("qid"), F.col("Question").alias("text")))
        # one number for each emotion
        at = emo_head.decode.join(head.decode.withColumnRenamed("cls", "own"), "EmotionName", "left").orderBy("cls").select("own").collect()
        laid = F.array(*[F.lit(0.0) if r.own is None else F.get("proba", F.lit(r.own)) for r in at])
        part = proba.select(F.col("qid").alias("ord"), laid.alias("proba")).join(sentiment(feeling, mine, "ord", "Question"), "ord")
        part = materialize(part.select("ord", F.concat("proba", F.array("sentiment")).alias("f")))
        out = part if out is None else out.unionByName(part)
    label = emo_head.decode.select(F.col("cls").alias("label_emo"), "EmotionName")
    return rows.join(broadcast_if_bounded(label), "EmotionName").join(out, "ord").select("ord", "Question", "EmotionName", "label_emo", "f", "fold")


# ---------------------------------------------------------------------------
# set logic of the refresh (#24-#26, #38)
# ---------------------------------------------------------------------------
def feature_same(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Key triples present in both (#24)."""
    return cached.select(*KEYS).join(current.select(*KEYS), KEYS, "inner")


def feature_keep(cached: DataFrame, same: DataFrame) -> DataFrame:
    """Cached rows whose Question is in ``same`` (Question only, #25)."""
    return cached.join(same.select("Question"), "Question", "left_semi")


def feature_diff(current: DataFrame, same: DataFrame) -> DataFrame:
    """Current rows whose Question is not in ``same`` (#26). Anti join: null-safe, unlike NOT IN."""
    return current.join(same.select("Question"), "Question", "left_anti")


def refresh(
    cached: DataFrame | None,
    current: DataFrame,
    n_classes: int,
    compute,
) -> DataFrame:
    """New feature table (#39).

    Rebuild everything when there is no cache or its feature width does not
    match ``n_classes + 1``; otherwise keep the cached rows still backed by
    the corpus, compute only the rest, and union. Stale cached rows are
    always pruned (the reference keeps them when nothing is new).
    ``compute`` maps corpus rows to feature rows.
    """
    if cached is None or _width(cached) != n_classes + 1:
        return compute(current).withColumn("origin", F.lit("new"))
    same = feature_same(cached, current)
    kept = feature_keep(cached, same).withColumn("origin", F.lit("kept"))
    new = compute(feature_diff(current, same)).withColumn("origin", F.lit("new"))
    return new.unionByName(kept.select(*new.columns))


def _width(df: DataFrame) -> int:
    """Of the first row: a cache belongs to one model, so all rows are as wide."""
    row = df.select(F.size("f").alias("w")).first()
    return row.w if row else 0


# ---------------------------------------------------------------------------
# versioned cache folders (#2, #3)
# ---------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, base: str, complete: bool = True) -> list[int]:
    """Versions under ``base``; by default only complete ones (with a _SUCCESS marker).

    A write that failed part way leaves a folder without the marker: it is
    never read, and the next write takes a higher number.
    """
    fs, p, jvm = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            if not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[1:]))
    return sorted(out)


def cache_base(root: str, head) -> str:
    """Cache folder of one head: its kind and a digest of the model itself."""
    from parlance.operators import models

    return f"{root}/{head.kind}-{models.model_id(head)}"


def read_cache(spark: SparkSession, base: str) -> DataFrame | None:
    """Current feature table, or None when there is none (#2)."""
    v = versions(spark, base)
    return spark.read.parquet(f"{base}/v{v[-1]:06d}") if v else None


def write_cache(df: DataFrame, base: str) -> str:
    """Write a new version next to the current one (#3); returns its path."""
    spark = df.sparkSession
    v = versions(spark, base, complete=False)
    path = f"{base}/v{(v[-1] + 1 if v else 1):06d}"
    df.write.mode("error").parquet(path)
    return path
