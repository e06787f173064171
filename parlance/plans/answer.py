"""Question answering (#22, #28, #29, #65, #68-#74).

questions -> synonyms -> FAQ head top-k (sparse, exact) + intent head vector
-> first-match lookups (Demand / Supply / intent of each ranked FAQ)
-> emotion (punctuation stripped, emotion head, optional offset, argmax)
-> record (v1 flat, v2 nested) -> fallback routing by thresholds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import bayes
from parlance.operators import features as ft
from parlance.operators import models as md
from parlance.operators.util import broadcast_if_bounded, materialize
from parlance.plans import corpus as cp
from parlance.sources.catalog import Catalog

BOT_NAME = "parlance"
# Fixed answer text when the fallback has no answer (the reference's "busy" text).
BUSY_TEXT = "聊天小幫手忙碌中"
FALLBACK_BOT = "ChatBot"
K_FAQ = 4
K_INTENT = 4


class Heads:
    """Corpora and the three heads, each built on first use.

    Without ``trained`` the heads are relational naive Bayes; ``trained``
    (of ``jobs.train_all`` or ``jobs.load_all``) brings heads of any kind and
    the stacked emotion model.
    """

    def __init__(self, cat: Catalog, trained=None):
        self.cat = cat
        self.trained = trained

    @cached_property
    def corpus_faq(self) -> DataFrame:
        return cp.corpus_faq(self.cat)

    @cached_property
    def corpus_intent(self) -> DataFrame:
        return cp.corpus_intent(self.cat)

    @cached_property
    def corpus_emo(self) -> DataFrame:
        return cp.corpus_emo(self.cat)

    def _head(self, name: str, corpus: str, text: str, label: str) -> md.HeadModel:
        if self.trained is not None:
            return self.trained.heads[name]
        return md.fit("nb", getattr(self, corpus), text, label)

    @cached_property
    def faq(self) -> md.HeadModel:
        return self._head("faq", "corpus_faq", "Text", "FaqSettingId")

    @cached_property
    def intent(self) -> md.HeadModel:
        return self._head("intent", "corpus_intent", "Text", "IntentionName")

    @cached_property
    def emo(self) -> md.HeadModel:
        return self._head("emo", "corpus_emo", "Question", "EmotionName")

    @cached_property
    def sentiment(self) -> bayes.NBModel:
        return ft.train_sentiment(self.cat.read("sent"))

    @cached_property
    def lookup(self) -> DataFrame:
        """The FAQ lookup, written once for all scorings and micro-batches."""
        return materialize(faq_lookup(self.corpus_faq, self.corpus_intent))

    @cached_property
    def stack(self):
        """Booster on out-of-fold [emotion probabilities, sentiment] of the emotion corpus (#67)."""
        if self.trained is not None and self.trained.stack is not None:
            return self.trained.stack
        return md.train_stack(ft.oof_features(self.emo, self.corpus_emo, self.cat.read("sent")))


def build_heads(cat: Catalog) -> Heads:
    return Heads(cat)


def prepare_questions(cat: Catalog, questions: DataFrame | None = None) -> DataFrame:
    """Questions get synonyms but no stop-word removal (the reference's serving path)."""
    q = cat.read("questions") if questions is None else questions
    return tx.replace_synonyms(q, "text", cat.read("syn"))


def faq_lookup(corpus_faq: DataFrame, corpus_intent: DataFrame) -> DataFrame:
    """First Demand / Supply (FAQ corpus) and first IntentionName (intent corpus)
    per FaqSettingId, in ``ord`` order (#28). A first value that is null stays null.
    """
    f = corpus_faq.groupBy("FaqSettingId").agg(
        F.min_by("Demand", "ord").alias("demand"), F.min_by("Supply", "ord").alias("supply")
    )
    i = corpus_intent.groupBy("FaqSettingId").agg(F.min_by("IntentionName", "ord").alias("faq_intent"))
    return f.join(i, "FaqSettingId", "left")


def rank_faq_long(heads: Heads, q: DataFrame, k: int = K_FAQ) -> DataFrame:
    """(qid, rank, faq_id, similarity, demand, faq_intent, supply): ranked FAQs (#69).

    Similarities are probabilities rounded to 3 places.
    """
    top = md.predict_topk(heads.faq, q, k)
    top = top.join(broadcast_if_bounded(heads.faq.decode), "cls").select(
        "qid", "rank", F.col("FaqSettingId").alias("faq_id"), "p"
    )
    look = heads.lookup.withColumnRenamed("FaqSettingId", "faq_id")
    return top.join(look, "faq_id", "left").select(
        "qid", "rank", "faq_id", F.round("p", 3).alias("similarity"), "demand", "faq_intent", "supply"
    )


def intent_scores(heads: Heads, q: DataFrame, k: int = K_INTENT) -> DataFrame:
    """(qid, pred_intent, intent_sims[k]): the intent head's k best classes."""
    top = md.predict_topk(heads.intent, q, k)
    top = top.join(broadcast_if_bounded(heads.intent.decode), "cls")
    return top.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("IntentionName"))).alias("pred_intent"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.round("p", 3).alias("p")))), lambda s: s["p"]).alias("intent_sims"),
    )


def emotion(heads: Heads, q: DataFrame, balance: list[float] | None = None) -> DataFrame:
    """(qid, emotion): punctuation stripped, emotion head, optional offset, argmax, decode."""
    qq = q.withColumn("text", tx.strip_punct("text"))
    top = md.predict_topk(heads.emo, qq, 1, balance=balance)
    return top.join(broadcast_if_bounded(heads.emo.decode), "cls").select("qid", F.col("EmotionName").alias("emotion"))


def emotion_stacked(heads: Heads, q: DataFrame, balance: list[float] | None = None) -> DataFrame:
    """(qid, emotion) through the stacked model: punctuation stripped, emotion
    probabilities + sentiment, booster raw scores, optional offset, argmax (#68)."""
    qq = q.select("qid", tx.strip_punct("text").alias("text"))
    proba = md.predict_proba(heads.emo, qq)
    sent = ft.sentiment(heads.sentiment, qq, "qid", "text")
    feats = proba.join(sent, "qid").select("qid", F.concat("proba", F.array("sentiment")).alias("f"))
    return md.score_stack(heads.stack, feats, heads.emo.decode, balance)


def rank_faq(heads: Heads, q: DataFrame) -> DataFrame:
    """v2 tuple per question: ids[4], sims[4], demand[4], faq_intent[4], answer,
    pred_intent, intent_sims[4] (#69)."""
    lf = rank_faq_long(heads, q)
    per_q = lf.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "faq_id", "similarity", "demand", "faq_intent", "supply"))).alias("r"))
    per_q = per_q.select(
        "qid",
        F.transform("r", lambda s: s["faq_id"]).alias("faq_ids"),
        F.transform("r", lambda s: s["similarity"]).alias("faq_sims"),
        F.transform("r", lambda s: s["demand"]).alias("demands"),
        F.transform("r", lambda s: s["faq_intent"]).alias("faq_intents"),
        F.col("r")[0]["supply"].alias("answer"),
    )
    return per_q.join(intent_scores(heads, q), "qid", "left")


def rank_faq_v1(heads: Heads, q: DataFrame) -> DataFrame:
    """v1 tuple: referral ids = ranks 2-4, intent sims[3] (#70)."""
    r = rank_faq(heads, q)
    return r.select(
        "qid",
        F.col("faq_intents").alias("intents"),
        "pred_intent",
        F.slice("faq_ids", 2, 3).alias("next_ids"),
        F.col("faq_ids")[0].alias("best_id"),
        "demands",
        F.col("faq_sims").alias("faq_ps"),
        F.slice("intent_sims", 1, 3).alias("intent_ps"),
        "answer",
    )


def options_row(cat: Catalog) -> DataFrame:
    return cp.option_values(cat)


def threshold_resolve(cat: Catalog, q: DataFrame) -> DataFrame:
    """Per-question thresholds: the request's value if it parses, else the option (#74)."""
    o = options_row(cat)
    t_faq = o.select("SimilarityFAQBot").scalar()
    t_int = o.select("SimilarityIntentionBot").scalar()
    return q.select(
        "qid",
        F.coalesce(F.col("threshold_faq").try_cast("double"), t_faq).alias("t_faq"),
        F.coalesce(F.col("threshold_intent").try_cast("double"), t_int).alias("t_intent"),
    )


def unanswerable(sim_faq: F.Column, sim_intent: F.Column, t_faq: F.Column, t_intent: F.Column) -> F.Column:
    """Both best similarities strictly below their thresholds (#22)."""
    return (sim_faq < t_faq) & (sim_intent < t_intent)


def answer_v1(cat: Catalog, heads: Heads, q: DataFrame | None = None, external: DataFrame | None = None,
              stacked: bool = False) -> DataFrame:
    """v1 record per question (#71).

    The v1 path never routes to the fallback bot (the reference has that
    branch disabled); ``external`` is accepted for a uniform signature.
    ``stacked`` takes the emotion from the stacked model instead of the
    emotion head's argmax.
    """
    q = materialize(prepare_questions(cat, q))
    r = rank_faq(heads, q)
    e = emotion_stacked(heads, q) if stacked else emotion(heads, q)
    d = r.join(e, "qid", "left")
    return d.select(
        "qid",
        F.lit(BOT_NAME).alias("Bot"),
        F.col("answer").alias("Answer"),
        F.col("demands")[0].alias("Question"),
        F.col("faq_ids")[0].alias("Answer_faqsettingid"),
        F.slice("demands", 2, 3).alias("Referral"),
        F.slice("faq_ids", 2, 3).alias("Referral_faqsettingid"),
        F.slice("faq_intents", 2, 3).alias("Referral_intent"),
        F.col("faq_sims").alias("Similarity"),
        "emotion",
        F.col("faq_intents")[0].alias("intent"),
        F.lit(1).alias("type"),
        F.lit(1).alias("end"),
        F.col("faq_sims")[0].alias("max_prob"),
        "pred_intent",
        F.col("intent_sims")[0].alias("pred_intent_prob"),
    )


def answer_v2(cat: Catalog, heads: Heads, q: DataFrame | None = None, external: DataFrame | None = None,
              stacked: bool = False) -> DataFrame:
    """v2 record per question: nested demand and referral[3], with fallback routing (#72, #73).

    When both best similarities are under their thresholds (#22, #74) the
    bot is the fallback bot, the answer comes from ``external`` (qid,
    answer) or is the fixed busy text, and FAQ ids, texts and referral
    similarities are zeroed; the best similarity and the intents stay.
    """
    q = materialize(prepare_questions(cat, q))
    r = rank_faq(heads, q)
    e = emotion_stacked(heads, q) if stacked else emotion(heads, q)
    t = threshold_resolve(cat, q)
    d = _with_external(r.join(e, "qid", "left").join(t, "qid"), external)
    fb = unanswerable(F.col("faq_sims")[0], F.col("intent_sims")[0], F.col("t_faq"), F.col("t_intent"))

    def entry(i: int, zero_sim: bool):
        sim = F.col("faq_sims")[i]
        return F.struct(
            F.when(fb, F.lit(0).cast("long")).otherwise(F.col("faq_ids")[i]).alias("faqId"),
            (F.when(fb, F.lit(0.0)).otherwise(sim) if zero_sim else sim).alias("similarity"),
            F.when(fb, F.lit(None).cast("string")).otherwise(F.col("demands")[i]).alias("text"),
            F.col("faq_intents")[i].alias("intent"),
        )

    referral = F.filter(F.array(*[entry(i, True) for i in (1, 2, 3)]), lambda s: s["intent"].isNotNull() | s["faqId"].isNotNull())
    return d.select(
        "qid",
        F.when(fb, F.lit(FALLBACK_BOT)).otherwise(F.lit(BOT_NAME)).alias("bot"),
        F.when(fb, F.coalesce("_ext", F.lit(BUSY_TEXT))).otherwise(F.col("answer")).alias("answer"),
        entry(0, False).alias("demand"),
        referral.alias("referral"),
        "emotion",
        F.lit(1).alias("type"),
        F.lit(1).alias("end"),
        F.col("pred_intent").alias("predIntent"),
        F.col("intent_sims")[0].alias("predIntentProb"),
    )


def answer(cat: Catalog, heads: Heads, version: str = "1", q: DataFrame | None = None,
           external: DataFrame | None = None, stacked: bool = False) -> DataFrame:
    """Answer records of a version; any version other than '1' or '2' is rejected."""
    if version == "1":
        return answer_v1(cat, heads, q, external, stacked)
    if version == "2":
        return answer_v2(cat, heads, q, external, stacked)
    raise ValueError(f"unknown answer version {version!r}; expected '1' or '2'")


def _with_external(d: DataFrame, external: DataFrame | None) -> DataFrame:
    """Optional answers from another service, as a table (qid, answer)."""
    if external is None:
        return d.withColumn("_ext", F.lit(None).cast("string"))
    return d.join(external.select("qid", F.col("answer").alias("_ext")), "qid", "left")


def answers_json(records: DataFrame) -> DataFrame:
    """Answer sink form: (qid, json) (#7)."""
    cols = [c for c in records.columns if c != "qid"]
    return records.select("qid", F.to_json(F.struct(*cols)).alias("json"))
