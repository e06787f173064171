"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Each reads the shared tables of ``sf_dir`` (through the role catalog) and
runs over all of their rows. Arrays and doubles are flattened or rounded
at the edge so that the SQL oracle can compare values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import vectors as vx
from parlance.operators import bayes
from parlance.operators import encode as enc
from parlance.operators import filters as flt
from parlance.operators import sampling as smp
from parlance.operators import words as wd
from parlance.plans import answer as ans
from parlance.plans import corpus as cp
from parlance.sources.catalog import Catalog, turn_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def corpus_faq(spark, sf_dir):
    return cp.corpus_faq(Catalog(spark, sf_dir))


@query
def corpus_intent(spark, sf_dir):
    return cp.corpus_intent(Catalog(spark, sf_dir))


@query
def corpus_emo(spark, sf_dir):
    return cp.corpus_emo(Catalog(spark, sf_dir))


@query
def top_words(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return wd.top_words(cp.corpus_emo(cat), "Question", cat.read("stop"), [2, 3, 4], 10)


@query
def cloud_words(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return wd.cloud_words(cp.corpus_emo(cat), "Question", cat.read("stop"))


FLAGSHIP = "answer_v1"


def _ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# -- cleaning ---------------------------------------------------------------
@query
def synonym_canon(spark, sf_dir):
    """Canonical word of each synonym term and how many FAQ phrases contain the term (#8, #23)."""
    cat = Catalog(spark, sf_dir)
    return tx.synonym_usage(cat.read("faq"), "Text", cat.read("syn"))


@query
def synonym_replace(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return tx.replace_synonyms(cat.read("faq"), "Text", cat.read("syn")).select("ord", "Text")


@query
def synonym_to_one(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return tx.replace_all_to_one(cat.read("faq"), "Text", cat.read("syn")).select("ord", "Text")


@query
def stopword_exclude(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return tx.exclude_stopwords(cat.read("intent"), "Text", cat.read("stop")).select("ord", "Text")


@query
def strip_punct(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return cat.read("questions").select("qid", tx.strip_punct("text").alias("text"))


@query
def script_convert(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return tx.script_convert(cat.read("emo"), ["Question", "EmotionName"], cat.read("script_map")).select(
        "ord", "Question", "EmotionName"
    )


# -- filters ----------------------------------------------------------------
@query
def length_quantile(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    i = cat.read("intent")
    return spark.range(1).select(
        F.round(flt.length_quantile(i, "Text", 0.8), 6).alias("q80"),
        F.round(flt.length_quantile(i, "Text", 0.5), 6).alias("q50"),
    )


@query
def length_band(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return flt.length_band(cat.read("intent"), "Text", 2, 0.8).select("ord", F.length("Text").alias("n_chars"))


@query
def rank_filter(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return flt.rank_filter(cat.read("intent")).select("ord", "Rank")


@query
def dedup_first(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return flt.dedup_first(cat.read("intent"), "Text").select("ord", "IntentionName")


# -- sizes and sampling -----------------------------------------------------
@query
def class_sizes(spark, sf_dir):
    return smp.class_sizes(cp.emo_cleaned(Catalog(spark, sf_dir)), "EmotionName")


@query
def second_size(spark, sf_dir):
    sizes = smp.class_sizes(cp.emo_cleaned(Catalog(spark, sf_dir)), "EmotionName")
    return spark.range(1).select(smp.second_size(sizes).alias("s"))


@query
def balance_cap(spark, sf_dir):
    return smp.balance_cap(cp.emo_cleaned(Catalog(spark, sf_dir)), "EmotionName").select("ord", "EmotionName")


@query
def balance_topup(spark, sf_dir):
    return cp.corpus_emo(Catalog(spark, sf_dir)).select("ord", "EmotionName")


@query
def holdout_split(spark, sf_dir):
    return smp.holdout_split(cp.corpus_intent(Catalog(spark, sf_dir))).select("ord", "split")


# -- encoding ---------------------------------------------------------------
@query
def label_encode(spark, sf_dir):
    faq = cp.corpus_faq(Catalog(spark, sf_dir))
    rows, _ = enc.label_encode(faq, "FaqSettingId", "label_faq")
    return rows.select("ord", "FaqSettingId", "label_faq")


@query
def char_vocab(spark, sf_dir):
    return enc.char_vocab(cp.corpus_intent(Catalog(spark, sf_dir)), "Text")


@query
def encode_pad(spark, sf_dir):
    faq = cp.corpus_faq(Catalog(spark, sf_dir))
    out = enc.encode_pad(faq, "Text", enc.char_vocab(faq, "Text"))
    return out.select("ord", _ids_str(F.col("ids")).alias("ids"))


@query
def encode_query(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    faq = cp.corpus_faq(cat)
    maxlen = faq.select(F.max(F.length("Text"))).scalar()
    out = enc.encode_query(cat.read("questions"), "text", enc.char_vocab(faq, "Text"), maxlen)
    return out.select("qid", _ids_str(F.col("ids")).alias("ids"))


@query
def encode_mask(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    faq = cp.corpus_faq(cat)
    maxlen = faq.select(F.max(F.length("Text"))).scalar()
    out = enc.encode_mask(cat.read("questions"), "text", enc.char_vocab(faq, "Text"), maxlen)
    return out.select("qid", _ids_str(F.col("ids")).alias("ids"), _ids_str(F.col("mask")).alias("mask"))


@query
def corpus_stats(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    parts = []
    for head, df, col, label in (
        ("faq", cp.corpus_faq(cat), "Text", "FaqSettingId"),
        ("intent", cp.corpus_intent(cat), "Text", "IntentionName"),
        ("emo", cp.corpus_emo(cat), "Question", "EmotionName"),
    ):
        parts.append(enc.corpus_stats(df, col, label, enc.char_vocab(df, col)).withColumn("head", F.lit(head)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- options ------------------------------------------------------------------
@query
def threshold_resolve(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return ans.threshold_resolve(cat, cat.read("questions"))


@query
def refresh_options(spark, sf_dir):
    """Refresh: rebuild the corpora, resolve options and model kinds (#30, #31, #54)."""
    cat = Catalog(spark, sf_dir)
    o = cp.option_values(cat).select(
        F.col("SimilarityFAQBot").alias("t_faq"), F.col("SimilarityIntentionBot").alias("t_intent")
    )
    kinds = cp.model_choice(cat)
    n = spark.range(1).select(
        cp.corpus_faq(cat).select(F.count(F.lit(1))).scalar().alias("n_faq"),
        cp.corpus_intent(cat).select(F.count(F.lit(1))).scalar().alias("n_intent"),
        cp.corpus_emo(cat).select(F.count(F.lit(1))).scalar().alias("n_emo"),
    )
    return _one_row(o, kinds, n)


def _one_row(*dfs):
    out = dfs[0]
    for d in dfs[1:]:
        for c in d.columns:
            out = out.withColumn(c, d.select(c).scalar())
    return out


# -- relational NB heads ------------------------------------------------------
def _classes(model):
    return model.classes.select(
        "cls", model.label, "docs", "n_tok", F.round("prior", 6).alias("prior"), F.round("ld", 6).alias("ld")
    )


@query
def train_faq(spark, sf_dir):
    return _classes(bayes.train(cp.corpus_faq(Catalog(spark, sf_dir)), "Text", "FaqSettingId"))


@query
def train_intent(spark, sf_dir):
    return _classes(bayes.train(cp.corpus_intent(Catalog(spark, sf_dir)), "Text", "IntentionName"))


@query
def train_emo(spark, sf_dir):
    return _classes(bayes.train(cp.corpus_emo(Catalog(spark, sf_dir)), "Question", "EmotionName"))


@query
def train_linear(spark, sf_dir):
    """Linear FAQ head: per class its rows, weights and their sums (#59)."""
    from parlance.operators import linear as ln

    m = ln.train(cp.corpus_faq(Catalog(spark, sf_dir)), "Text", "FaqSettingId", rounds=3)
    out = m.classes.join(m.class_sums(), "cls", "left")
    return out.select("cls", "FaqSettingId", "docs", F.coalesce("n", F.lit(0)).alias("n_weights"), F.round("w", 2).alias("w_sum"), F.round("a", 2).alias("w_abs"))


@query
def rank_linear(spark, sf_dir):
    """The linear FAQ head's best class for every question, and its score (#59, #69)."""
    from parlance.operators import linear as ln

    cat = Catalog(spark, sf_dir)
    m = ln.train(cp.corpus_faq(cat), "Text", "FaqSettingId", rounds=3)
    top = ln.score_topk(m, ans.prepare_questions(cat), "text", 1)
    return top.join(m.decode(), "cls").select("qid", "FaqSettingId", F.round("p", 3).alias("p"))


def _intent_vectors(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    model = bayes.train(cp.corpus_intent(cat), "Text", "IntentionName")
    return bayes.score_vector(model, ans.prepare_questions(cat), "text")


def _long(df, col):
    return df.select("qid", F.posexplode(col).alias("cls", "p")).select("qid", "cls", F.round("p", 3).alias("p"))


@query
def predict_proba(spark, sf_dir):
    return _long(_intent_vectors(spark, sf_dir), "proba")


@query
def softmax(spark, sf_dir):
    """Softmax of tempered scores (a tenth of the log scores) (#45)."""
    return _long(_intent_vectors(spark, sf_dir), vx.softmax(F.transform("scores", lambda s: s / 10)))


@query
def softmax_contrast(spark, sf_dir):
    return _long(_intent_vectors(spark, sf_dir), vx.softmax_contrast(F.col("proba")))


@query
def calib_intent(spark, sf_dir):
    return _long(_intent_vectors(spark, sf_dir), vx.calib_intent(F.col("proba")))


@query
def round_scores(spark, sf_dir):
    v = _intent_vectors(spark, sf_dir)
    return v.select("qid", F.posexplode(vx.round_list(F.col("proba"), 1)).alias("cls", "p"))


@query
def topk_classes(spark, sf_dir):
    v = _intent_vectors(spark, sf_dir)
    t = v.select("qid", F.posexplode(vx.topk(F.col("proba"), 2)).alias("pos", "e"))
    return t.select("qid", (F.col("pos") + 1).alias("rank"), F.col("e.idx").alias("cls"), F.round("e.p", 3).alias("p"))


@query
def score_offset(spark, sf_dir):
    """Emotion with a per-class offset on the raw scores before argmax (#50)."""
    cat = Catalog(spark, sf_dir)
    heads = ans.build_heads(cat)
    return ans.emotion(heads, ans.prepare_questions(cat), balance=[0.0, 5.0, 0.0, -5.0])


@query
def rank_faq(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    heads = ans.build_heads(cat)
    return ans.rank_faq_long(heads, ans.prepare_questions(cat))


@query
def calib_faq(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    model = bayes.train(cp.corpus_faq(cat), "Text", "FaqSettingId")
    top = bayes.score_topk(model, ans.prepare_questions(cat), "text", 4)
    return top.select("qid", "rank", F.round(F.sqrt(F.col("p") * 100) / 10, 3).alias("p"))


@query
def faq_lookup(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return ans.faq_lookup(cp.corpus_faq(cat), cp.corpus_intent(cat))


@query
def answer_v1(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return _flat_v1(ans.answer_v1(cat, ans.build_heads(cat)))

# -- sources ----------------------------------------------------------------
@query
def scan_role(spark, sf_dir):
    """Role scan with projection and filter; both reach the parquet scan (#1)."""
    from parlance.sources.catalog import scan_role as scan

    cat = Catalog(spark, sf_dir)
    return scan(cat, "intent", ["ord", "IntentionName"], F.col("IntentionName") == "en")


@query
def questions(spark, sf_dir):
    """Question source (#6)."""
    return Catalog(spark, sf_dir).read("questions")


# -- sentiment and emotion features ----------------------------------------
def _features_parts(spark, sf_dir, band=cp.EMO_BAND):
    from parlance.operators import features as ft
    from parlance.operators import models as md

    cat = Catalog(spark, sf_dir)
    corpus = cp.corpus_emo(cat, band)
    head = md.fit("nb", corpus, "Question", "EmotionName")
    sent = ft.train_sentiment(cat.read("sent"))
    return cat, corpus, head, sent


def _flat_f(df, n=5):
    return [F.round(F.get(F.col("f"), i), 3).alias(f"f{i}") for i in range(n)]


@query
def sentiment(spark, sf_dir):
    from parlance.operators import features as ft

    cat = Catalog(spark, sf_dir)
    model = ft.train_sentiment(cat.read("sent"))
    s = ft.sentiment(model, cat.read("questions"), "qid", "text")
    return s.select("qid", F.round("sentiment", 3).alias("sentiment"))


@query
def emo_features(spark, sf_dir):
    from parlance.operators import features as ft

    _cat, corpus, head, sent = _features_parts(spark, sf_dir)
    f = ft.emo_features(head, sent, corpus)
    return f.select("ord", "EmotionName", "label_emo", *_flat_f(f))


def _cached_and_current(spark, sf_dir):
    """Cache = the emotion corpus of an earlier refresh (band .7); current = band .8."""
    from parlance.operators import encode as enc2

    cat = Catalog(spark, sf_dir)
    old = cp.corpus_emo(cat, (4, 0.7))
    cur = cp.corpus_emo(cat)
    o, _ = enc2.label_encode(old, "EmotionName", "label_emo")
    c, _ = enc2.label_encode(cur, "EmotionName", "label_emo")
    return o, c


@query
def feature_same(spark, sf_dir):
    from parlance.operators import features as ft

    o, c = _cached_and_current(spark, sf_dir)
    return ft.feature_same(o, c).select("EmotionName", "label_emo", F.md5("Question").alias("q"))


@query
def feature_keep(spark, sf_dir):
    from parlance.operators import features as ft

    o, c = _cached_and_current(spark, sf_dir)
    return ft.feature_keep(o, ft.feature_same(o, c)).select("ord", "EmotionName", "label_emo")


@query
def feature_diff(spark, sf_dir):
    from parlance.operators import features as ft

    o, c = _cached_and_current(spark, sf_dir)
    return ft.feature_diff(c, ft.feature_same(o, c)).select("ord", "EmotionName", "label_emo")


@query
def feature_refresh(spark, sf_dir):
    """Versioned cache of one model: v1 = features of the earlier corpus, v2 =
    incremental refresh (#2, #3, #39)."""
    import uuid

    from parlance.operators import features as ft
    from parlance.session import ensure_checkpoint_dir

    cat, cur, head, sent = _features_parts(spark, sf_dir)
    base = ft.cache_base(f"{ensure_checkpoint_dir(spark)}/features-{uuid.uuid4().hex}", head)
    ft.write_cache(ft.emo_features(head, sent, cp.corpus_emo(cat, (4, 0.7))), base)
    cur = cur.join(head.decode.select(F.col("cls").alias("label_emo"), "EmotionName"), "EmotionName")
    n_classes = head.decode.count()
    new = ft.refresh(ft.read_cache(spark, base), cur, n_classes, lambda rows: ft.emo_features(head, sent, rows))
    ft.write_cache(new, base)
    out = ft.read_cache(spark, base)
    return out.select("ord", "EmotionName", "label_emo", "origin", *_flat_f(out))


@query
def feature_stream(spark, sf_dir):
    """The cache after two streamed change sets: the rows of the earlier corpus,
    then those of the current one and deletes of rows that left it (#39)."""
    from parlance.operators import features as ft
    from parlance.streaming import answers as st
    from parlance.streaming import refresh as rf

    cat, cur, head, sent = _features_parts(spark, sf_dir)
    root, state = st.stream_folders(spark)
    base, src = ft.cache_base(root, head), f"{root}/changes"
    row = ["ord", "Question", "EmotionName"]
    old, new = (c.select(*row).distinct() for c in (cp.corpus_emo(cat, (4, 0.7)), cur))
    gone = old.join(new, "ord", "left_anti").withColumn("op", F.lit("delete"))
    sets = [old.withColumn("op", F.lit("put")), new.withColumn("op", F.lit("put")).unionByName(gone)]
    for k, changes in enumerate(sets):
        changes.withColumn("seq", F.lit(k).cast("long")).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ord long, Question string, EmotionName string, op string, seq long").parquet(src)
        rf.refresh_stream(stream, base, lambda rows: ft.emo_features(head, sent, rows), state)
    out = rf.read(spark, base)
    return out.select("ord", "EmotionName", "label_emo", *_flat_f(out))


# -- models ---------------------------------------------------------------------
@query
def eval_report(spark, sf_dir):
    """Intent head (nb) trained on the hash train split; accuracy and log loss per split (#64)."""
    from parlance.operators import models as md

    split = smp.holdout_split(cp.corpus_intent(Catalog(spark, sf_dir)))
    train = split.filter(F.col("split") == "train")
    head = md.fit("nb", train, "Text", "IntentionName")
    return md.eval_report(head, train, "Text", "train").unionByName(
        md.eval_report(head, split.filter(F.col("split") == "test"), "Text", "test")
    )


@query
def model_roundtrip(spark, sf_dir):
    """Save, load and re-score each kind on the intent head: equal predictions (#4, #5)."""
    from parlance.operators import models as md
    from parlance.plans.jobs import model_path

    cat = Catalog(spark, sf_dir)
    corpus = cp.corpus_intent(cat)
    q = ans.prepare_questions(cat)
    out = None
    for kind in ("nb", "logreg"):
        head = md.fit(kind, corpus, "Text", "IntentionName")
        path = model_path(spark, f"roundtrip-{kind}")
        md.save(head, path)
        back = md.load(spark, path, kind, "IntentionName")
        a = md.predict_proba(head, q).select("qid", F.col("proba").alias("a"))
        b = md.predict_proba(back, q).select("qid", F.col("proba").alias("b"))
        r = a.join(b, "qid").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((vx.argmax(F.col("a")) == vx.argmax(F.col("b"))).cast("int")).alias("n_equal"),
        ).withColumn("kind", F.lit(kind))
        out = r if out is None else out.unionByName(r)
    return out


@query
def train_all(spark, sf_dir):
    """Options choose the kind of each head; train, save, stack (#62, #76)."""
    from parlance.plans import jobs

    cat = Catalog(spark, sf_dir)
    return jobs.train_all(cat, jobs.model_path(spark, "train_all-" + hashlib.md5(sf_dir.encode()).hexdigest()[:12])).status


@query
def load_all(spark, sf_dir):
    """Train and save from the tables under a path of its own, then load all."""
    import uuid

    from parlance.plans import jobs

    cat = Catalog(spark, sf_dir)
    path = jobs.model_path(spark, f"load_all-{uuid.uuid4().hex}")
    jobs.train_all(cat, path)
    return jobs.load_all(cat, path).status


@query
def stack_features(spark, sf_dir):
    """Out-of-fold features of the emotion corpus: each row scored by models
    that learned from the other folds (#67)."""
    from parlance.operators import features as ft

    cat, corpus, head, _sent = _features_parts(spark, sf_dir)
    f = ft.oof_features(head, corpus, cat.read("sent"))
    return f.select("ord", "EmotionName", "label_emo", "fold", *_flat_f(f))


@query
def train_stack(spark, sf_dir):
    """Stacked emotion booster learned from out-of-fold features; its choices
    on the features of the whole head (#67)."""
    from parlance.operators import features as ft
    from parlance.operators import models as md

    cat, corpus, head, sent = _features_parts(spark, sf_dir)
    stack = md.train_stack(ft.oof_features(head, corpus, cat.read("sent")))
    f = ft.emo_features(head, sent, corpus)
    return md.score_stack(stack, f.select(F.col("ord").alias("qid"), "f").distinct(), head.decode)


@query
def score_emotion(spark, sf_dir):
    """Questions -> punctuation stripped -> features -> stacked model -> emotion (#68)."""
    from parlance.operators import features as ft
    from parlance.operators import models as md

    cat, corpus, head, sent = _features_parts(spark, sf_dir)
    stack = md.train_stack(ft.oof_features(head, corpus, cat.read("sent")))
    q = ans.prepare_questions(cat).select("qid", tx.strip_punct("text").alias("text"))
    proba = md.predict_proba(head, q)
    s = ft.sentiment(sent, q, "qid", "text")
    feats = proba.join(s, "qid").select("qid", F.concat("proba", F.array("sentiment")).alias("f"))
    return md.score_stack(stack, feats, head.decode)


@query
def segment_words(spark, sf_dir):
    """Words of the FAQ phrases found again after their blanks and signs are
    taken out, by a lattice over the words of the intent table (#11, #34)."""
    from parlance.operators import lattice as lt

    cat = Catalog(spark, sf_dir)
    seg = lt.segmenter(lt.word_counts_as_dictionary(cat.read("intent"), "Text"), letters=True)
    joined = F.lower(F.regexp_replace("Text", r"[^\p{L}\p{N}]+", ""))
    return cat.read("faq").select("ord", joined.alias("t")).select("ord", F.array_join(seg(F.col("t")), " ").alias("words"))


# -- answers ----------------------------------------------------------------------
@query
def rank_faq_v1(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    r = ans.rank_faq_v1(ans.build_heads(cat), ans.prepare_questions(cat))
    cols = [F.col("qid"), "pred_intent", "best_id", "answer"]
    for c, name, n in (("next_ids", "next_id", 3), ("demands", "demand", 4), ("intents", "intent", 4), ("faq_ps", "faq_p", 4), ("intent_ps", "intent_p", 3)):
        cols += [F.get(c, i).alias(f"{name}_{i + 1}") for i in range(n)]
    return r.select(*cols)


def _external_answers(cat):
    """Answers of the other service, as a table: the next assistant turn of the conversation."""
    conv = cat.table("conversations")
    nxt = conv.filter(F.col("role") == "assistant").select(
        (turn_key() - 1).alias("qid"), F.col("text").alias("answer")
    )
    return nxt


@query
def route_fallback(spark, sf_dir):
    """Threshold routing to the fallback bot with answers from a table (#22, #73, #74)."""
    cat = Catalog(spark, sf_dir)
    return _flat_v2(ans.answer_v2(cat, ans.build_heads(cat), external=_external_answers(cat)))


def _flat_v2(a):
    return a.select(
        "qid", "bot", "answer",
        F.col("demand.faqId").alias("faq_id"), F.col("demand.similarity").alias("similarity"),
        F.col("demand.text").alias("demand_text"),
        *[F.get("referral", F.lit(i))["faqId"].alias(f"referral_faq_id_{i + 1}") for i in range(3)],
        *[F.get("referral", F.lit(i))["similarity"].alias(f"referral_similarity_{i + 1}") for i in range(3)],
        F.col("demand.intent").alias("intent"),
        *[F.get("referral", F.lit(i))["intent"].alias(f"referral_intent_{i + 1}") for i in range(3)],
        "emotion", "predIntent", "predIntentProb",
    )


@query
def answers_sink(spark, sf_dir):
    """v2 records through the JSON sink, the batch written twice as after a
    failure, read back and parsed (#7, #72)."""
    import uuid

    from parlance.session import ensure_checkpoint_dir
    from parlance.streaming import sink

    cat = Catalog(spark, sf_dir)
    a = ans.answer_v2(cat, ans.build_heads(cat), external=_external_answers(cat))
    base = f"{ensure_checkpoint_dir(spark)}/streams/sink-{uuid.uuid4().hex}"
    for _again in range(2):
        sink.write_answers(a, base, 0)
    return _flat_v2(sink.parsed(sink.read_answers(spark, base), a))


@query
def answer_v2(spark, sf_dir):
    """v2 records with the emotion from the stacked model, as the reference answers."""
    cat = Catalog(spark, sf_dir)
    return ans.answer_v2(cat, ans.build_heads(cat), stacked=True)


@query
def answers_json(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return ans.answers_json(ans.answer_v2(cat, ans.build_heads(cat)))


def _flat_v1(a):
    flat = [F.col(c) for c in a.columns if c not in ("Referral", "Referral_faqsettingid", "Referral_intent", "Similarity")]
    for c, n in (("Referral", 3), ("Referral_faqsettingid", 3), ("Referral_intent", 3), ("Similarity", 4)):
        flat += [F.get(F.col(c), i).alias(f"{c}_{i + 1}") for i in range(n)]
    return a.select(*flat)


@query
def answer_stream(spark, sf_dir):
    """Stream of user turns answered per micro-batch; equals the batch answers (#75)."""
    from parlance.streaming import answers as st

    cat = Catalog(spark, sf_dir)
    heads = ans.build_heads(cat)
    out, state = st.stream_folders(spark)
    st.answer_stream(cat, heads, out, state, shape=_flat_v1)
    return spark.read.parquet(out).drop("batch_id")


@query
def answer_hot_swap(spark, sf_dir):
    """Stream of user turns answered by published heads: all that an answer
    needs of a model is read from its version (#75, #76)."""
    from parlance.streaming import answers as st
    from parlance.streaming import hotswap as hs

    cat = Catalog(spark, sf_dir)
    out, state = st.stream_folders(spark)
    base = f"{out}-models"
    hs.publish(spark, base, lambda folder: hs.save_heads(ans.build_heads(cat), folder))
    hs.serve_answers(cat, st.question_stream(spark, sf_dir), base, out, state, shape=_flat_v1)
    return spark.read.parquet(out).drop("batch_id")


@query
def score_stream(spark, sf_dir):
    """Stream of user turns scored by a logreg intent head, append mode, one
    narrow stage (#63, #75)."""
    from parlance.operators import models as md
    from parlance.streaming import answers as st
    from parlance.streaming import scoring as sc

    cat = Catalog(spark, sf_dir)
    head = md.fit("logreg", cp.corpus_intent(cat), "Text", "IntentionName")
    out, state = st.stream_folders(spark)
    sc.score_stream(head, st.question_stream(spark, sf_dir), out, state)
    return spark.read.parquet(out).select("qid", "cls", "IntentionName", F.round("p", 3).alias("p"))
