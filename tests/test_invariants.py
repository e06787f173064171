from pyspark.sql import functions as F

from conftest import SF_SMALL
from parlance.operators import features as ft
from parlance.operators import models as md
from parlance.operators import sampling as smp
from parlance.plans import answer as ans
from parlance.plans import corpus as cp
from parlance.sources.catalog import Catalog


def test_faq_lookup_missing_is_null(spark):
    faq = spark.createDataFrame(
        [(2, 7, None, "s2"), (1, 7, "d1", None), (3, 8, "d3", "s3")], "ord long, FaqSettingId long, Demand string, Supply string"
    )
    intent = spark.createDataFrame([(1, 7, "i7")], "ord long, FaqSettingId long, IntentionName string")
    got = {r.FaqSettingId: (r.demand, r.supply, r.faq_intent) for r in ans.faq_lookup(faq, intent).collect()}
    # first row by ord wins, even when its value is null; an id absent from the intent table is null
    assert got == {7: ("d1", None, "i7"), 8: ("d3", "s3", None)}


def test_corpora_unique_and_refresh_covers_current(spark):
    cat = Catalog(spark, SF_SMALL)
    faq = cp.corpus_faq(cat)
    assert faq.count() == faq.select("Text").distinct().count()
    old = cp.corpus_emo(cat, (4, 0.7)).withColumn("label_emo", F.lit(0))
    cur = cp.corpus_emo(cat).withColumn("label_emo", F.lit(0))
    same = ft.feature_same(old, cur)
    kept_q = ft.feature_keep(old, same).select("Question").distinct()
    diff_q = ft.feature_diff(cur, same).select("Question").distinct()
    assert kept_q.join(diff_q, "Question").count() == 0
    assert kept_q.union(diff_q).distinct().count() == cur.select("Question").distinct().count()


def test_save_load_equal_and_accuracy_floor(spark, tmp_path):
    cat = Catalog(spark, SF_SMALL)
    corpus = cp.corpus_intent(cat)
    for kind in ("nb", "logreg"):
        head = md.fit(kind, corpus, "Text", "IntentionName")
        md.save(head, str(tmp_path / kind))
        back = md.load(spark, str(tmp_path / kind), kind, "IntentionName")
        q = corpus.select(F.col("ord").alias("qid"), F.col("Text").alias("text"))
        a = md.predict_proba(head, q).select("qid", F.col("proba").alias("a"))
        b = md.predict_proba(back, q).select("qid", F.col("proba").alias("b"))
        # equal up to the order of floating-point sums
        diff = a.join(b, "qid").select(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("d"))
        assert diff.agg(F.max("d")).first()[0] < 1e-9


def test_accuracy_on_rows_that_training_does_not_see(spark):
    split = smp.holdout_split(cp.corpus_intent(Catalog(spark, SF_SMALL)))
    for kind in ("nb", "logreg"):
        head = md.fit(kind, split.filter("split = 'train'"), "Text", "IntentionName")
        rep = md.eval_report(head, split.filter("split = 'test'"), "Text", "test").first()
        assert rep.n > 10 and rep.accuracy >= 0.8, (kind, rep)


def test_evaluation_counts_rows_once_and_cache_follows_the_model(spark, tmp_path):
    corpus = cp.corpus_emo(Catalog(spark, SF_SMALL))  # balanced: rows repeat
    head = md.fit("nb", corpus, "Question", "EmotionName")
    assert md.eval_report(head, corpus, "Question", "train").first().n == corpus.count()
    md.save(head, str(tmp_path))
    assert md.model_id(md.load(spark, str(tmp_path), "nb", "EmotionName")) == md.model_id(head)
    other = md.fit("nb", corpus.limit(10), "Question", "EmotionName")
    assert ft.cache_base("x", other) != ft.cache_base("x", head)


def test_unknown_kind_raises(spark):
    import pytest

    cat = Catalog(spark, SF_SMALL)
    with pytest.raises(ValueError):
        md.fit("gpt2", cp.corpus_intent(cat), "Text", "IntentionName")


def test_cache_versions_skip_incomplete(spark, tmp_path):
    base = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, [0.5, 0.5])], "ord long, f array<double>")
    assert ft.read_cache(spark, base) is None
    ft.write_cache(df, base)
    (tmp_path / "cache" / "v000002").mkdir()  # a write that died before committing
    p3 = ft.write_cache(df.withColumn("ord", F.lit(3).cast("long")), base)
    assert p3.endswith("v000003")
    assert ft.read_cache(spark, base).first().ord == 3
    assert ft.versions(spark, base) == [1, 3]


def test_options_by_first_row(spark):
    import pytest

    from parlance.sources.catalog import OPTION_ROWS, OPTION_SCHEMA

    def options(rows):
        return Catalog(spark, SF_SMALL, {"options": spark.createDataFrame(rows, OPTION_SCHEMA)})

    assert cp.option_values(options(OPTION_ROWS)).first().SimilarityFAQBot == 0.6  # a later row says 0.9
    with pytest.raises(Exception, match="is missing"):
        cp.option_values(options(OPTION_ROWS[1:6])).collect()
    with pytest.raises(Exception, match="not a number"):
        cp.option_values(options([(0, "4000Faq", "many"), *OPTION_ROWS])).collect()


def test_unknown_model_id_falls_back_for_all_three(spark):
    from parlance.sources.catalog import OPTION_ROWS, OPTION_SCHEMA

    rows = [(0, "4000Emo", "99"), *OPTION_ROWS]
    cat = Catalog(spark, SF_SMALL, {"options": spark.createDataFrame(rows, OPTION_SCHEMA)})
    assert cp.model_choice(cat).first().asDict() == cp.DEFAULT_KINDS
    assert cp.model_choice(Catalog(spark, SF_SMALL)).first().asDict() == {"faq_kind": "nb", "intent_kind": "logreg", "emo_kind": "rf"}


def test_options_choose_the_heads_that_answer_and_loading_changes_nothing(spark, tmp_path):
    from parlance.plans import jobs

    cat = Catalog(spark, SF_SMALL)
    kinds = {"faq_kind": "nb", "intent_kind": "logreg", "emo_kind": "nb"}
    assert {r.status for r in jobs.load_all(cat, str(tmp_path), kinds).status.collect()} == {"not trained"}
    done = jobs.train_all(cat, str(tmp_path), kinds, stack_kind="rf")
    back = jobs.load_all(cat, str(tmp_path), kinds, stack_kind="rf")
    assert [r.status for r in back.status.collect()] == ["loaded"] * 4 and back.heads["intent"].kind == "logreg"
    cols = ["qid", "pred_intent", "emotion", "Answer_faqsettingid", "pred_intent_prob"]
    read = lambda t: sorted(map(tuple, ans.answer_v1(cat, ans.Heads(cat, t), stacked=True).select(*cols).collect()))
    a = read(done)
    assert a == read(back) and len(a) > 0
    assert a != sorted(map(tuple, ans.answer_v1(cat, ans.Heads(cat)).select(*cols).collect()))
