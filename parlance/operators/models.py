"""Model kinds per head, the stacked emotion model, evaluation and persistence
(#4, #5, #59-#64, #67, #68).

Kinds: ``nb`` (relational naive Bayes, ``bayes.py``), ``linear``
(one-versus-rest weights as a table, ``linear.py``) and three ``spark.ml``
estimators over hashed token counts: ``logreg``, ``mlp``, ``rf``. The
reference's neural kinds are re-aimed to these (see README). An unknown
kind raises instead of silently keeping an old model.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import TOKEN
from parlance.functions import vectors as vx
from parlance.operators import bayes, linear
from parlance.operators.encode import dense_index
from parlance.operators.util import dealt, materialize

ML_KINDS = ("logreg", "mlp", "rf")
KINDS = ("nb", "linear") + ML_KINDS
# Hashed feature width per kind (the MLP's first layer is dense).
FEATURES = {"logreg": 1 << 18, "rf": 1 << 12, "mlp": 1 << 10}
SEED = 42
# Classes whose boosters are trained at the same time.
STACK_PARALLELISM = 4


@dataclass
class HeadModel:
    kind: str
    label: str
    decode: DataFrame  # cls, label
    nb: bayes.NBModel | None = None
    ml: PipelineModel | None = None
    linear: linear.LinearModel | None = None


def _estimator(kind: str, n_classes: int):
    if kind == "logreg":
        return LogisticRegression(featuresCol="x", labelCol="y", maxIter=60, regParam=1e-3, family="multinomial")
    if kind == "rf":
        return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=40, maxDepth=12, seed=SEED)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(
            featuresCol="x", labelCol="y", layers=[FEATURES["mlp"], 64, max(n_classes, 2)], maxIter=80, seed=SEED
        )
    raise ValueError(f"unknown model kind {kind!r}; expected one of {KINDS}")


def ml_pipeline(kind: str, text: str, n_classes: int) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False, toLowercase=True),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=FEATURES[kind]),
            IDF(inputCol="_tf", outputCol="x"),
            _estimator(kind, n_classes),
        ]
    )


def fit(kind: str, corpus: DataFrame, text: str, label: str) -> HeadModel:
    """Train one head of ``kind`` on ``corpus`` (text -> label) (#59-#62)."""
    if kind not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}; expected one of {KINDS}")
    if kind == "nb":
        m = bayes.train(corpus, text, label)
        return HeadModel(kind, label, m.decode(), nb=m)
    if kind == "linear":
        m = linear.train(corpus, text, label).written()
        return HeadModel(kind, label, m.decode(), linear=m)
    index = materialize(dense_index(corpus, label, "cls"))
    n = index.count()
    rows = corpus.select(text, label).join(index, label).select(text, F.col("cls").cast("double").alias("y"))
    model = ml_pipeline(kind, text, n).fit(dealt(rows))
    return HeadModel(kind, label, index.select("cls", label), ml=model)


def fit_folds(kind: str, corpus: DataFrame, text: str, label: str, fold: str, folds: int) -> list[HeadModel]:
    """For each fold the head of the rows of all other folds. ``nb`` reads the texts once for all heads."""
    if kind == "nb":
        return [HeadModel(kind, label, m.decode(), nb=m) for m in bayes.train_folds(corpus, text, label, fold, folds)]
    return [fit(kind, corpus.where(F.col(fold) != k), text, label) for k in range(folds)]


def predict_proba(head: HeadModel, q: DataFrame, text: str = "text") -> DataFrame:
    """(qid, proba): class probabilities by class index (#63)."""
    if head.nb is not None:
        return bayes.score_vector(head.nb, q, text).select("qid", "proba")
    if head.linear is not None:
        return linear.score_vector(head.linear, q, text)
    out = head.ml.transform(q.select("qid", F.col(text).alias(text_col(head))))
    return out.select("qid", vector_to_array("probability").alias("proba"))


def predict_topk(head: HeadModel, q: DataFrame, k: int, text: str = "text", balance: list[float] | None = None) -> DataFrame:
    """(qid, rank, cls, p). ``nb`` and ``linear`` use their exact sparse top-k;
    ML kinds rank their vector. ``balance`` is taken off the classes' log scores first (#50)."""
    if head.nb is not None:
        return bayes.score_topk(head.nb.shifted(balance) if balance else head.nb, q, text, k)
    if head.linear is not None and not balance:
        return linear.score_topk(head.linear, q, text, k)
    v = predict_proba(head, q, text)
    if balance:
        logs = F.transform("proba", lambda p: F.log(F.greatest(p, F.lit(1e-300))))
        v = v.select("qid", vx.softmax(vx.offset(logs, F.array(*[F.lit(float(b)) for b in balance]))).alias("proba"))
    t = v.select("qid", F.posexplode(vx.topk(F.col("proba"), k)).alias("pos", "e"))
    return t.select("qid", (F.col("pos") + 1).alias("rank"), F.col("e.idx").alias("cls"), F.col("e.p").alias("p"))


def text_col(head: HeadModel) -> str:
    return head.ml.stages[0].getInputCol()


# ---------------------------------------------------------------------------
# evaluation (#64)
# ---------------------------------------------------------------------------
def eval_report(head: HeadModel, rows: DataFrame, text: str, split_name: str) -> DataFrame:
    """One row: head label, kind, split, n, accuracy, log_loss (mean -ln p(true class)).

    Balanced corpora repeat rows: every distinct ``ord`` is scored once and
    counts as often as it occurs. A label the head does not know has
    probability 0 and is never right.
    """
    times = rows.groupBy("ord", text, head.label).agg(F.count(F.lit(1)).alias("_w"))
    q = times.select(F.col("ord").alias("qid"), F.col(text).alias("text"), head.label, "_w")
    q = materialize(q.join(head.decode.withColumnRenamed("cls", "y"), head.label, "left").select("qid", "text", "y", "_w"))
    if head.nb is not None:
        got = bayes.score_true(head.nb, q, "text", "y").select("qid", "cls", F.col("p_true").alias("p"))
    elif head.linear is not None:
        got = linear.score_true(head.linear, q, "text", "y").select("qid", "cls", F.col("p_true").alias("p"))
    else:
        proba = predict_proba(head, q.select("qid", "text")).join(q.select("qid", "y"), "qid")
        got = proba.select("qid", vx.argmax(F.col("proba")).alias("cls"), F.get(F.col("proba"), F.col("y")).alias("p"))
    j = q.select("qid", "y", "_w").join(got, "qid")
    n = F.sum("_w")
    return j.agg(
        n.alias("n"),
        (F.sum(F.col("_w") * F.coalesce(F.col("cls") == F.col("y"), F.lit(False)).cast("double")) / n).alias("accuracy"),
        (F.sum(F.col("_w") * -F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-15)))) / n).alias("log_loss"),
    ).select(
        F.lit(head.label).alias("head"), F.lit(head.kind).alias("kind"), F.lit(split_name).alias("split"),
        "n", F.round("accuracy", 4).alias("accuracy"), F.round("log_loss", 4).alias("log_loss"),
    )


def model_id(head: HeadModel) -> str:
    """Identity of a trained model: equal for equal ``nb`` statistics, also
    after a reload; ML kinds carry the identity given when they were fitted."""
    if head.ml is not None:
        return head.ml.uid
    parts = []
    tables = [(head.linear.classes, ["cls", head.label, "docs"]), (head.linear.weights, ["token", "cls", F.round("w", 6)])] if head.linear else None
    for df, cols in tables or ((head.nb.classes, ["cls", head.label, "docs", "n_tok"]), (head.nb.weights, ["token", "cls", F.round("w", 9)])):
        h = F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
        parts += list(df.agg(F.count(F.lit(1)), h).first())
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16]


# ---------------------------------------------------------------------------
# persistence (#4, #5)
# ---------------------------------------------------------------------------
def save(head: HeadModel, path: str) -> None:
    """Write the model under ``path/<kind>``, replacing an older one."""
    base = f"{path}/{head.kind}"
    head.decode.write.mode("overwrite").parquet(f"{base}/decode")
    if head.nb is not None:
        head.nb.save(f"{base}/nb")
    elif head.linear is not None:
        head.linear.save(f"{base}/linear")
    else:
        head.ml.write().overwrite().save(f"{base}/ml")


def load(spark: SparkSession, path: str, kind: str, label: str) -> HeadModel:
    """Load a saved head; raises if it was never trained."""
    base = f"{path}/{kind}"
    decode = spark.read.parquet(f"{base}/decode")
    if kind == "nb":
        return HeadModel(kind, label, decode, nb=bayes.NBModel.load(spark, f"{base}/nb", label))
    if kind == "linear":
        return HeadModel(kind, label, decode, linear=linear.LinearModel.load(spark, f"{base}/linear", label))
    return HeadModel(kind, label, decode, ml=PipelineModel.load(f"{base}/ml"))


# ---------------------------------------------------------------------------
# stacked emotion model (#67, #68)
# ---------------------------------------------------------------------------
def train_stack(features: DataFrame, kind: str = "gbt") -> OneVsRestModel | PipelineModel:
    """Booster on emotion features (probabilities + sentiment), text excluded (#67).

    ``gbt``: one binary gradient-boosted tree model per class (OneVsRest);
    ``rf``: one random forest.
    """
    rows = dealt(features.select("f", F.col("label_emo").cast("double").alias("y"))).select(array_to_vector("f").alias("x"), "y")
    if kind == "gbt":
        return OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=4, seed=SEED), featuresCol="x", labelCol="y", parallelism=STACK_PARALLELISM).fit(rows)
    if kind == "rf":
        return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=40, seed=SEED).fit(rows)
    raise ValueError(f"unknown stack kind {kind!r}")


def load_stack(path: str, kind: str = "gbt"):
    """A stacked model saved by ``stack.write()`` (#5)."""
    return OneVsRestModel.load(path) if kind == "gbt" else RandomForestClassificationModel.load(path)


def score_stack(stack, features: DataFrame, decode: DataFrame, balance: list[float] | None = None, raw: bool = False) -> DataFrame:
    """Raw class scores -> optional offset -> argmax -> label (#68).

    ``features``: (qid, f). With ``raw`` the raw score vector is returned.
    """
    out = stack.transform(features.select("qid", array_to_vector("f").alias("x")))
    scores = vector_to_array("rawPrediction")
    if balance is not None:
        scores = vx.offset(scores, F.array(*[F.lit(float(b)) for b in balance]))
    out = out.select("qid", scores.alias("raw"))
    if raw:
        return out
    names = decode.select(F.transform(F.array_sort(F.collect_list(F.struct(*decode.columns))), lambda s: s[decode.columns[1]])).scalar()
    return out.withColumn("_n", names).select("qid", F.element_at("_n", vx.argmax(F.col("raw")) + 1).alias("emotion"))
