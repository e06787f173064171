"""Linear head for very many classes (#59, #62, the ``linear`` kind).

One-versus-rest squared hinge with a fixed bias of -1 for every class:

    score(q, c) = sum_t v(q, t) w(t, c)            (bias taken off)
    loss(r, c)  = max(0, 2 - score)^2 / 2  if c is the class of r, else
                  max(0, score)^2 / 2

A row and a class that share no weighted token have score 0 and, as
negatives, no loss and no gradient. So every sum runs over the (row, class)
pairs that share a token. Weights tend to tokens x classes; a class learns from
all rows and from no other class, so tasks share the classes and the weights
are a table (token, cls, w) only where a model is kept.

Features: v = tf x ln(C / cf), cf being the number of classes that use the
token, rows scaled to length 1. Tokens of more than ``MAX_CLASS_SHARE`` of the
classes carry little and would pair every row with every class; they are left
out, as is a token of all classes, whose v is 0 anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators import blocks
from parlance.operators.encode import dense_index
from parlance.operators.util import broadcast_if_bounded, materialize

MAX_CLASS_SHARE = 0.25
ROUNDS = 8
RATE = 0.5
RIDGE = 1e-3
# Features are kept to so many decimals, weights too: sums in another order agree.
DIGITS = 9


class LinearModel:
    """``classes``: (cls, label, docs), ``features``: (token, idf), ``weights``:
    (token, cls, w), or ``learner``, which learns them where they are used."""

    def __init__(self, classes: DataFrame, features: DataFrame, weights: DataFrame | None, label: str, n_classes: int, learner: blocks.Hinge | None = None):
        self.classes, self.features, self.label, self.n_classes = classes, features, label, n_classes
        self.table, self.learner = weights, learner
        self.lists: DataFrame | None = None  # token, cls[], w[]: the weights of a token and a block of classes in one row

    def written(self) -> "LinearModel":
        """The model with its weights written as a table, for one that is used many times."""
        if self.lists is None and self.learner is not None:
            self.lists = materialize(self.learner.lists())
        return self

    @property
    def weights(self) -> DataFrame:
        """(token, cls, w)"""
        if self.table is not None:
            return self.table
        return self.written().lists.select("token", F.inline(F.arrays_zip("cls", "w")))

    def by_block(self) -> DataFrame:
        if self.table is not None:
            return blocks.packed(self.table, self.features.count(), self.n_classes)
        return self.written().lists

    def class_sums(self) -> DataFrame:
        """(cls, n, w, a): number, sum and sum of sizes of a class's weights."""
        if self.lists is None and self.learner is not None:
            return self.learner.sums()
        return blocks.class_sums(self.by_block())

    def parts(self, x: DataFrame, k: int) -> DataFrame:
        """See ``blocks.linear_parts``."""
        if self.lists is None and self.learner is not None:
            return self.learner.parts(x, k)
        return blocks.linear_parts(x, self.features.select("token"), self.by_block(), self.n_classes, k, DIGITS)

    def decode(self) -> DataFrame:
        return self.classes.select("cls", self.label)

    def save(self, path: str) -> None:
        for name in ("classes", "features", "weights"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, label: str) -> "LinearModel":
        classes, features, weights = (spark.read.parquet(f"{path}/{n}") for n in ("classes", "features", "weights"))
        return cls(classes, features, weights, label, classes.count())


def _vectors(rows: DataFrame, key: str, text: str, features: DataFrame, carry: list[str]) -> DataFrame:
    """(key, carry..., token, v): unit rows of known tokens."""
    tf = rows.select(key, *carry, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, *carry, "token").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(broadcast_if_bounded(features), "token").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return raw.withColumn("v", F.round(F.col("x") / norm, DIGITS)).select(key, *carry, "token", "v")


def _scores(x: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., cls, s) of pairs that share a weighted token; partial sums
    combine before they meet, and AQE splits a hot token."""
    return x.join(broadcast_if_bounded(weights, 200_000), "token").groupBy(*keys, "cls").agg(F.sum(F.col("v") * F.col("w")).alias("s"))


def train(corpus: DataFrame, text: str, label: str, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> LinearModel:
    """Full-batch Adagrad, one class after the other (``blocks.Hinge``). A class
    weighs its gradients by its own number of rows. Equal rows count as often
    as they occur. The weights are learned where they are used; a model that is
    used many times should be ``written``."""
    index = materialize(dense_index(corpus, label, "cls"))
    n = index.count()
    rows = corpus.select(F.monotonically_increasing_id().alias("row"), text, label).join(broadcast_if_bounded(index), label)
    rows = materialize(rows.select("row", text, F.col("cls").alias("y")))
    used = rows.select("y", F.explode(tokens(F.col(text))).alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("cf"))
    most = max(1.0, MAX_CLASS_SHARE * n)
    idf = F.round(F.log(F.lit(float(n)) / F.col("cf")), DIGITS)
    features = materialize(used.where((F.col("cf") <= most) & (F.col("cf") < n)).select("token", idf.alias("idf")))
    x = _vectors(rows, "row", text, features, ["y"])
    docs = rows.groupBy(F.col("y").alias("cls")).agg(F.count(F.lit(1)).alias("docs"))
    classes = materialize(index.join(docs, "cls").select("cls", label, "docs"))
    learner = blocks.Hinge(x, features.select("token"), classes.select("cls", "docs"), n, rounds, rate, ridge, DIGITS)
    return LinearModel(classes, features, None, label, n, learner)


def _matched(model: LinearModel, questions: DataFrame, text: str, carry: list[str] = []) -> DataFrame:
    x = _vectors(questions.select("qid", *carry, F.col(text).alias("_t")), "qid", "_t", model.features, carry)
    return _scores(x, model.weights, ["qid", *carry])


def score_topk(model: LinearModel, questions: DataFrame, text: str, k: int) -> DataFrame:
    """(qid, rank, cls, p): the k best classes, exactly; p is the softmax of
    the scores over all classes, those without a shared token at score 0.
    Tie rule: score desc, then class index desc. A question meets the classes
    block by block (``blocks``), so its pairs with classes are never rows."""
    x = _vectors(questions.select("qid", F.col(text).alias("_t")), "qid", "_t", model.features, [])
    parts = model.parts(x, k)
    per_q = parts.groupBy("qid").agg(F.sum("z").alias("z"), F.flatten(F.collect_list("top")).alias("e"))
    n = F.lit(model.n_classes)
    # a question without a token of the model scores 0 with every class
    low = F.greatest(n - k, F.lit(0)).cast("int")
    none = F.transform(F.sequence(low, (n - 1).cast("int")), lambda c: F.struct(F.lit(0.0).alias("s"), c.alias("cls")))
    d = questions.select("qid").join(per_q, "qid", "left").withColumn("e", F.coalesce("e", none)).withColumn("z", F.coalesce("z", n.cast("double")))
    d = d.select("qid", "z", F.posexplode(F.slice(F.reverse(F.array_sort("e")), 1, k)).alias("pos", "t"))
    return d.select("qid", (F.col("pos") + 1).alias("rank"), F.col("t.cls").alias("cls"), (F.exp("t.s") / F.col("z")).alias("p"))


def score_true(model: LinearModel, questions: DataFrame, text: str, true: str) -> DataFrame:
    """(qid, true, cls, p_true): the best class, and the probability of the
    class in column ``true`` (null if there is none)."""
    m = _matched(model, questions.select("qid", true, text), text, [true]).withColumn("s", F.round("s", DIGITS))
    per_q = m.groupBy("qid").agg(F.sum(F.exp("s")).alias("z"), F.count(F.lit(1)).alias("m"), F.max(F.when(F.col("cls") == F.col(true), F.col("s"))).alias("st"))
    best = score_topk(model, questions, text, 1).select("qid", "cls")
    d = questions.select("qid", true).join(per_q, "qid", "left").join(best, "qid")
    z = F.coalesce("z", F.lit(0.0)) + (model.n_classes - F.coalesce("m", F.lit(0)))
    return d.select("qid", true, "cls", F.when(F.col(true).isNotNull(), F.exp(F.coalesce("st", F.lit(0.0))) / z).alias("p_true"))


def score_vector(model: LinearModel, questions: DataFrame, text: str) -> DataFrame:
    """(qid, proba) over all classes. One number per (question, class): ask
    for it only where the whole vector is the result."""
    from parlance.functions.vectors import softmax

    every = questions.select("qid").withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(model.n_classes - 1)))).withColumn("s", F.lit(0.0))
    s = every.unionByName(_matched(model, questions, text)).groupBy("qid", "cls").agg(F.sum("s").alias("s"))
    v = s.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "s"))), lambda e: e["s"]).alias("v"))
    return v.select("qid", softmax(F.col("v")).alias("proba"))
