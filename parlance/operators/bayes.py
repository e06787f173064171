"""Relational multinomial naive Bayes (#59-#61, #63, the ``nb`` kind).

Model (Laplace smoothing, in-vocabulary tokens only):

    score(q, c) = prior_c + sum_t tf(q,t) * (ln(cnt(t,c) + 1) - ln(n_c + V))
                = b_c(L_q) + sum_{t in q, cnt(t,c) > 0} tf(q,t) * ln(cnt(t,c) + 1)
    b_c(L)      = prior_c - L * ln(n_c + V),   L_q = sum of tf over q's vocabulary tokens

Scoring never stores (question, class) pairs. Questions are dealt by qid
once; tokens are counted, joined to the weights and summed per class inside
those partitions. Classes that share no token with a question enter through
b_c(L), which depends on the question only through its length L. Per
question only its k best matched classes and two numbers leave the stage:

    Z_q  = exp(logB(L_q)) + sum_{c matched} (exp(s_qc) - exp(b_c(L_q)))
    topk(q) is inside  topk(matched) U topk_base(L_q)

(a matched class always scores above its own base, so an unmatched class
outside topk_base(L_q) has k classes ahead of it). logB(L) and topk_base(L)
come from a table with one entry per distinct L.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators import blocks
from parlance.operators.encode import dense_index
from parlance.operators.util import broadcast_if_bounded, materialize

MAX_LENGTHS_BROADCAST = 200_000
# (token, class) weights under which the model is broadcast to the question partitions.
# A row takes 100 to 200 bytes, some three times over in the driver, and a job can
# hold the models of several steps at once.
MAX_MODEL_BROADCAST_ROWS = 200_000
# Classes up to which a question's sums are columns of one aggregate.
MAX_COLUMN_CLASSES = 16
# Classes beyond which (question, class) pairs are summed in blocks and never rows.
MAX_PAIRED_CLASSES = 64


@dataclass
class NBModel:
    classes: DataFrame  # cls, label, docs, n_tok, prior, ld
    weights: DataFrame  # token, cls, w
    label: str

    @property
    def vocab(self) -> DataFrame:
        return self.weights.select("token").distinct()

    def by_token(self) -> DataFrame:
        """(token, e: array<struct<cls, w>>): the model as one row per token."""
        return self.weights.groupBy("token").agg(F.collect_list(F.struct("cls", "w")).alias("e"))

    def broadcastable(self) -> bool:
        return self.weights.limit(MAX_MODEL_BROADCAST_ROWS + 1).count() <= MAX_MODEL_BROADCAST_ROWS

    def decode(self) -> DataFrame:
        return self.classes.select("cls", self.label)

    def shifted(self, balance: list[float]) -> "NBModel":
        """The model whose score of class i is lower by ``balance[i]`` (#50)."""
        b = F.get(F.array(*[F.lit(float(x)) for x in balance]), F.col("cls"))
        return NBModel(self.classes.withColumn("prior", F.col("prior") - F.coalesce(b, F.lit(0.0))), self.weights, self.label)

    def save(self, path: str) -> None:
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str, label: str) -> "NBModel":
        return cls(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/weights"), label)


def doc_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): term frequencies, combined map-side."""
    return (
        df.select(key, F.explode(tokens(F.col(text))).alias("token"))
        .groupBy(key, "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def train(corpus: DataFrame, text: str, label: str) -> NBModel:
    """Fit on ``corpus``; duplicate rows (balancing copies) count as separate documents.

    Token counts per (token, class) are combined map-side and written once;
    class statistics and the vocabulary size are read from that table.
    """
    index = materialize(dense_index(corpus, label, "cls"))
    rows = corpus.select(text, label).join(broadcast_if_bounded(index), label).select(text, "cls")
    counts = materialize(
        rows.select("cls", F.explode(tokens(F.col(text))).alias("token"))
        .groupBy("token", "cls")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    docs = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("docs"))
    return _model(index, counts, docs, label)


def train_folds(corpus: DataFrame, text: str, label: str, fold: str, folds: int) -> list[NBModel]:
    """For each fold the model of the rows of all other folds, as ``train`` gives it.

    Texts are read once: token counts per (token, label, fold) are combined
    map-side and written, and every model adds up those of its folds.
    """
    each = materialize(
        corpus.select(label, fold, F.explode(tokens(F.col(text))).alias("token"))
        .groupBy("token", label, fold)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    sizes = materialize(corpus.groupBy(label, fold).agg(F.count(F.lit(1)).alias("docs")))
    models = []
    for k in range(folds):
        index = materialize(dense_index(sizes.where(F.col(fold) != k), label, "cls"))
        mine, docs = (df.where(F.col(fold) != k).join(broadcast_if_bounded(index), label) for df in (each, sizes))
        counts = materialize(mine.groupBy("token", "cls").agg(F.sum("cnt").alias("cnt")))
        models.append(_model(index, counts, docs.groupBy("cls").agg(F.sum("docs").alias("docs")), label))
    return models


def _model(index: DataFrame, counts: DataFrame, docs: DataFrame, label: str) -> NBModel:
    """Model from the class index, (token, cls, cnt) and (cls, docs)."""
    per_class = docs.join(counts.groupBy("cls").agg(F.sum("cnt").alias("n_tok")), "cls", "left").fillna(0, ["n_tok"])
    per_class = materialize(per_class.join(index, "cls"))
    n_docs = per_class.select(F.sum("docs")).scalar()
    v = counts.select(F.count_distinct("token")).scalar()
    classes = materialize(
        per_class.withColumn("_N", n_docs)
        .withColumn("_V", v)
        .select(
            "cls",
            label,
            "docs",
            "n_tok",
            (F.log(F.col("docs").cast("double")) - F.log(F.col("_N").cast("double"))).alias("prior"),
            F.log((F.col("n_tok") + F.col("_V")).cast("double")).alias("ld"),
        )
    )
    weights = counts.select("token", "cls", F.log((F.col("cnt") + 1).cast("double")).alias("w"))
    return NBModel(classes, weights, label)


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------
def _pairs(model: NBModel, questions: DataFrame, text: str, carry: list[str] = []) -> DataFrame:
    """(qid, carry..., L, cls, m, b): matched (question, class) pairs, by qid.

    A plan, not a table: with a broadcastable model it is part of the one
    stage that begins with the exchange of the questions by qid. Larger
    models meet the tokens in a shuffle join on token, which AQE splits
    where a token is hot; the pairs are combined before they go back to qid.
    """
    dealt = questions.select("qid", *carry, F.col(text).alias("_t")).repartition("qid")
    qt = dealt.select("qid", *carry, F.explode(tokens(F.col("_t"))).alias("token"))
    qt = qt.groupBy("qid", *carry, "token").agg(F.count(F.lit(1)).alias("tf"))
    classes = model.classes.select("cls", "prior", "ld")
    if model.broadcastable():
        j = qt.join(F.broadcast(model.by_token()), "token")
        j = j.withColumn("L", F.sum("tf").over(Window.partitionBy("qid")))
        j = j.select("qid", *carry, "L", "tf", F.inline("e"))
        m = j.groupBy("qid", *carry, "cls").agg(F.sum(F.col("tf") * F.col("w")).alias("m"), F.first("L").alias("L"))
    else:
        # one entry per token carries its tf into L
        w = model.weights.join(model.weights.groupBy("token").agg(F.min("cls").alias("_low")), "token")
        j = qt.join(w, "token")
        m = j.groupBy("qid", *carry, "cls").agg(
            F.sum(F.col("tf") * F.col("w")).alias("m"), F.sum(F.when(F.col("cls") == F.col("_low"), F.col("tf"))).alias("_l")
        )
        m = m.repartition("qid").withColumn("L", F.sum("_l").over(Window.partitionBy("qid"))).drop("_l")
    b = F.col("prior") - F.col("L") * F.col("ld")
    return m.join(broadcast_if_bounded(classes), "cls").select("qid", *carry, "L", "cls", "m", b.alias("b"))


def _few(model: NBModel) -> list | None:
    """Rows (cls, prior, ld) of a model with few classes, by class, else None."""
    rows = model.classes.select("cls", "prior", "ld").limit(MAX_COLUMN_CLASSES + 1).collect()
    return sorted(rows) if len(rows) <= MAX_COLUMN_CLASSES else None


def _sums(model: NBModel, questions: DataFrame, text: str, few: list) -> DataFrame:
    """(qid, n, L, m): per qid its rows, known tokens and matched sums, one for
    each class of ``few`` (null where it shares no token).

    Every occurrence of a token meets the weights of all classes; the sums
    combine in the task that reads the text, so a text is not shuffled and no
    (question, token) row is kept. A model too large to be broadcast meets
    the tokens in a shuffle join."""
    of = [F.sum(F.when(F.col("cls") == c.cls, F.col("w"))).alias(f"w{i}") for i, c in enumerate(few)]
    by_token = model.weights.groupBy("token").agg(F.lit(1).alias("_in"), *of)
    by_token = F.broadcast(by_token) if model.broadcastable() else by_token
    t = questions.select("qid", F.posexplode_outer(tokens(F.col(text))).alias("pos", "token")).join(by_token, "token", "left")
    n, known = F.sum((F.coalesce("pos", F.lit(0)) == 0).cast("long")), F.coalesce(F.sum("_in"), F.lit(0)).cast("long")
    sums = t.groupBy("qid").agg(n.alias("n"), known.alias("L"), *[F.sum(f"w{i}").alias(f"m{i}") for i in range(len(few))])
    return sums.select("qid", "n", "L", F.array(*[F.col(f"m{i}") for i in range(len(few))]).cast("array<double>").alias("m"))


def _per_question_columns(model: NBModel, questions: DataFrame, text: str, k: int, true: str | None, few: list) -> DataFrame:
    """``_per_question`` for few classes, from one row of sums per question."""
    carry = [true] if true else []

    def cell(i: int, c) -> F.Column:
        b = F.lit(c.prior) - F.col("L") * F.lit(c.ld)
        return F.when(F.get("m", F.lit(i)).isNotNull(), F.struct((b + F.get("m", F.lit(i))).alias("s"), F.lit(c.cls).alias("cls"), b.alias("b")))

    kind = "array<struct<s:double,cls:int,b:double>>"
    s = _sums(model, questions.where("qid IS NOT NULL"), text, few)
    s = s.withColumn("e", F.reverse(F.array_sort(F.array_compact(F.array(*[cell(i, c) for i, c in enumerate(few)]).cast(kind)))))
    s = s.withColumn("hi", F.get("e", F.lit(0))["s"])
    extra = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - F.col("hi")) - F.exp(x["b"] - F.col("hi")))
    top = F.transform(F.slice("e", 1, k), lambda x: F.struct(x["s"].alias("s"), x["cls"].alias("cls")))
    s = s.select("qid", "L", "hi", F.when(F.size("e") > 0, extra).alias("extra"), top.alias("top"), "m")
    out = questions.select("qid", *carry).join(s, "qid", "left").fillna(0, ["L"])
    if true:
        at = F.array_position(F.array(*[F.lit(c.cls) for c in few]).cast("array<int>"), F.col(true).cast("int"))
        out = out.withColumn("m_true", F.get("m", (at - 1).cast("int")))
    return materialize(out.drop("m").withColumn("top", F.coalesce("top", F.array().cast("array<struct<s:double,cls:int>>"))))


def _per_question(model: NBModel, questions: DataFrame, text: str, k: int, true: str | None = None) -> DataFrame:
    """(qid, L, hi, extra, top[, true, m_true]), one row per question, written once.

    ``top``: the k best matched classes; hi: the best matched score; extra:
    sum of exp(s - hi) - exp(b - hi) over matched classes. ``true`` names a
    column with a class index whose matched sum is wanted. With many classes
    the pairs are summed block by block (``blocks``), with few the sums are
    columns of one aggregate.
    """
    carry = [true] if true else []
    few = _few(model)
    if few:
        return _per_question_columns(model, questions, text, k, true, few)
    if model.classes.count() > MAX_PAIRED_CLASSES:
        return _per_question_blocks(model, questions, text, k, true)
    by_score = Window.partitionBy("qid").orderBy(F.col("s").desc(), F.col("cls").desc())
    s = _pairs(model, questions, text, carry).withColumn("s", F.col("b") + F.col("m"))
    s = s.withColumn("r", F.row_number().over(by_score)).withColumn("hi", F.first("s").over(by_score))
    aggs = [
        F.first("L").alias("L"),
        F.first("hi").alias("hi"),
        F.sum(F.exp(F.col("s") - F.col("hi")) - F.exp(F.col("b") - F.col("hi"))).alias("extra"),
        F.collect_list(F.when(F.col("r") <= k, F.struct("s", "cls"))).alias("top"),
    ]
    if true:
        aggs.append(F.max(F.when(F.col("cls") == F.col(true), F.col("m"))).alias("m_true"))
    per_q = s.groupBy("qid").agg(*aggs)
    out = questions.select("qid", *carry).join(per_q, "qid", "left").fillna(0, ["L"])
    return materialize(out.withColumn("top", F.coalesce("top", F.array().cast("array<struct<s:double,cls:int>>"))))


def _per_question_blocks(model: NBModel, questions: DataFrame, text: str, k: int, true: str | None) -> DataFrame:
    """``_per_question`` for many classes: the parts of a question, one of
    each class block, are put together."""
    carry = [true] if true else []
    weights = model.weights.select(F.xxhash64("token").alias("h"), "cls", "w")
    qt = questions.where("qid IS NOT NULL").select("qid", *carry, F.explode(tokens(F.col(text))).alias("token"))
    qt = qt.select("qid", *carry, F.xxhash64("token").alias("h")).groupBy("qid", *carry, "h").agg(F.count(F.lit(1)).alias("tf"))
    known = qt.join(weights.select("h").distinct(), "h").groupBy("qid", "h").agg(F.sum("tf").alias("tf"))
    bags = known.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("h", "tf"))).alias("e"), F.sum("tf").alias("L"))
    bags = materialize(bags.select("qid", "L", F.col("e.h").alias("h"), F.col("e.tf").alias("tf")))
    parts = blocks.nb_parts(bags, model.classes.select("cls", "prior", "ld"), weights, k)
    per_q = parts.groupBy("qid").agg(F.max("hi").alias("hi"), F.collect_list(F.struct("hi", "extra")).alias("p"), F.flatten(F.collect_list("top")).alias("top"))
    extra = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["extra"] * F.exp(x["hi"] - F.col("hi")))
    per_q = per_q.select("qid", "hi", extra.alias("extra"), F.slice(F.reverse(F.array_sort("top")), 1, k).alias("top"))
    per_q = bags.select("qid", "L").join(per_q, "qid", "left")
    if true:
        hit = qt.join(weights, (qt["h"] == weights["h"]) & (qt[true] == weights["cls"]))
        per_q = per_q.join(hit.groupBy("qid").agg(F.sum(F.col("tf") * F.col("w")).alias("m_true")), "qid", "left")
    out = questions.select("qid", *carry).join(per_q, "qid", "left").fillna(0, ["L"])
    return materialize(out.withColumn("top", F.coalesce("top", F.array().cast("array<struct<s:double,cls:int>>"))))


def base_terms(model: NBModel, lengths: DataFrame, k: int) -> DataFrame:
    """Per distinct L: logB = log sum_c exp(b_c(L)) and the top-k classes by b_c(L).

    Classes with equal (prior, ld) are one group (their base scores are
    equal); a group keeps its k highest class indices for the tie rule.
    Every group meets every distinct length in its own task, and the sums
    per length are combined there before the exchange on L.
    """
    w = Window.partitionBy("prior", "ld").orderBy(F.col("cls").desc())
    groups = model.classes.select("cls", "prior", "ld").withColumn("_r", F.row_number().over(w))
    groups = groups.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("prior", "ld"))).where(F.col("_r") <= k)
    # one value with the distinct lengths of the questions
    ls = lengths.select(F.array_sort(F.collect_set("L"))).scalar()
    at = groups.withColumn("_ls", ls).select("cls", "_r", "cnt", "prior", "ld", F.explode("_ls").alias("L"))
    at = at.withColumn("b", F.col("prior") - F.col("L") * F.col("ld"))
    first = at.where("_r = 1")
    top = first.groupBy("L").agg(F.max("b").alias("_M"))
    log_b = first.join(broadcast_if_bounded(top, MAX_LENGTHS_BROADCAST), "L").groupBy("L").agg(
        (F.first("_M") + F.log(F.sum(F.col("cnt") * F.exp(F.col("b") - F.col("_M"))))).alias("logB")
    )
    wl = Window.partitionBy("L").orderBy(F.col("b").desc(), F.col("cls").desc())
    best = at.withColumn("_k", F.row_number().over(wl)).where(F.col("_k") <= k)
    best = best.groupBy("L").agg(F.collect_list(F.struct(F.col("b").alias("s"), "cls")).alias("base_top"))
    return log_b.join(best, "L")


def _with_base(model: NBModel, per_q: DataFrame, k: int) -> DataFrame:
    """Adds base_top, hi2 and Zp = Z / exp(hi2)."""
    base = base_terms(model, per_q, k)
    d = per_q.join(broadcast_if_bounded(base, MAX_LENGTHS_BROADCAST), "L")
    d = d.withColumn("hi2", F.greatest("hi", "logB"))
    rest = F.coalesce(F.col("extra") * F.exp(F.col("hi") - F.col("hi2")), F.lit(0.0))
    return d.withColumn("Zp", F.exp(F.col("logB") - F.col("hi2")) + rest)


def score_topk(model: NBModel, questions: DataFrame, text: str, k: int, carry: list[str] = []) -> DataFrame:
    """(qid, rank, cls, p): the k most probable classes per question, exactly.

    Tie rule: p desc, then class index desc. The last steps are array
    expressions on one row per question.
    """
    d = _with_base(model, _per_question(model, questions, text, k), k)
    mine = F.transform("top", lambda t: t["cls"])
    rest = F.filter("base_top", lambda t: ~F.array_contains(mine, t["cls"]))
    ranked = F.slice(F.reverse(F.array_sort(F.concat("top", rest))), 1, k)
    out = d.select("qid", "hi2", "Zp", F.posexplode(ranked).alias("pos", "t"))
    return out.select("qid", (F.col("pos") + 1).alias("rank"), F.col("t.cls").alias("cls"), (F.exp(F.col("t.s") - F.col("hi2")) / F.col("Zp")).alias("p"))


def score_true(model: NBModel, questions: DataFrame, text: str, true: str) -> DataFrame:
    """(qid, true, cls, p_true): the best class, and the probability of the
    class in column ``true`` (null if there is none), for evaluation (#64)."""
    d = _with_base(model, _per_question(model, questions, text, 1, true), 1)
    c = model.classes.select(F.col("cls").alias(true), "prior", "ld")
    d = d.join(broadcast_if_bounded(c), true, "left")
    s = F.col("prior") - F.col("L") * F.col("ld") + F.coalesce("m_true", F.lit(0.0))
    best = F.when(F.size("top") == 0, F.get("base_top", F.lit(0))).otherwise(
        F.greatest(F.get("top", F.lit(0)), F.get("base_top", F.lit(0)))
    )
    return d.select("qid", true, best["cls"].alias("cls"), (F.exp(s - F.col("hi2")) / F.col("Zp")).alias("p_true"))


def score_vector(model: NBModel, questions: DataFrame, text: str) -> DataFrame:
    """(qid, scores, proba): log scores and probabilities over all classes, by class index.

    The output holds one number per (question, class), so the base scores
    of all classes are laid beside each question's matched sums and added
    up inside the question's partition. Ask for it only where the whole
    vector is the result; rankings use ``score_topk``.
    """
    from parlance.functions.vectors import softmax

    few = _few(model)
    if few:
        # a null qid has no length, and rows with one qid add up their bases
        s = _sums(model, questions, text, few).withColumn("L", F.when(F.col("qid").isNull(), 0).otherwise(F.col("L")))
        cells = [F.col("n") * (F.lit(c.prior) - F.col("L") * F.lit(c.ld)) + F.coalesce(F.get("m", F.lit(i)), F.lit(0.0)) for i, c in enumerate(few)]
        s = s.select("qid", F.array(*cells).alias("scores"))
        return s.select("qid", "scores", softmax(F.col("scores")).alias("proba"))
    matched = _pairs(model, questions, text)
    # one value as long as one output vector
    carr = model.classes.select(F.array_sort(F.collect_list(F.struct("cls", "prior", "ld")))).scalar()
    lens = matched.groupBy("qid").agg(F.first("L").alias("L"))
    q = questions.select("qid").repartition("qid").join(lens, "qid", "left").fillna(0, ["L"]).withColumn("_c", carr)
    base = q.select("qid", "L", F.inline("_c")).select("qid", "cls", (F.col("prior") - F.col("L") * F.col("ld")).alias("s"))
    both = base.unionByName(matched.select("qid", "cls", F.col("m").alias("s")))
    s = both.groupBy("qid", "cls").agg(F.sum("s").alias("s"))
    v = s.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "s"))), lambda e: e["s"]).alias("scores"))
    return v.select("qid", "scores", softmax(F.col("scores")).alias("proba"))


def predict(model: NBModel, questions: DataFrame, text: str) -> DataFrame:
    """(qid, cls, p): the most probable class (top-1)."""
    return score_topk(model, questions, text, 1).select("qid", "cls", "p")
