
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from parlance.llm import cotraining, hashed, toxicity

from .helpers import SF, docs


def test_pairs_are_learned_with_the_production_parameters():
    """Two mentions, each in half of the texts of either class; label 1 iff
    both or neither, beside terms that say nothing."""
    rng = np.random.default_rng(1)
    n = 1200
    a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
    y = (a == b).astype(float)
    noise = rng.random((n, 200)) < rng.uniform(0.02, 0.6, 200)
    own, terms = np.nonzero(np.concatenate([np.stack([a, 1 - a, b, 1 - b], 1), noise], 1))
    ends = np.searchsorted(own, np.arange(n), "right")
    cut = ends[799]
    m = hashed.fit(y[:800], terms[:cut], ends[:800], 10, 4)
    z = m.logits(terms[cut:], ends[800:] - cut)
    assert ((z > 0) == (y[800:] > 0)).mean() > 0.95 and not m.w[:4].any()
    # labels of chance: no term takes part in a pair
    chance = rng.permutation(y)
    df = np.bincount(terms, minlength=1 << 10)
    assert not hashed.paired(chance, terms, ends, df, np.zeros(1 << 10, bool), 3).any()


def test_half_means_the_same_below_and_above_the_caps(spark):
    """One text is label 1 for 3 of 10 ids, whatever the caps make of the
    shares: it is not marked, and its score is near 0.3."""
    rows = [(i, "borderline words here" if i % 2 else "clean words only here", int(i % 2 and i % 20 in (1, 7, 13))) for i in range(4000)]
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "borderline words here")], "doc_id long, text string")
    for caps in ({1: 4000, 0: 4000}, {1: 500, 0: 500}):
        got = toxicity.score(probe, toxicity.train(texts, labels, max_rows=caps)).first().score
        assert 0.2 < got < 0.4, (caps, got)


def test_co_training_weighs_the_classes_by_all_labels():
    """Of 600 rows of either class, a row of label 1 stands for three."""
    rng = np.random.default_rng(4)
    y = np.arange(1200) % 2
    views = [cotraining.View([[1 + int(rng.random() < 0.5 + 0.2 * k), 5] for k in y], 6) for _ in range(2)]
    mean = {}
    for name, behind in (("even", None), ("threefold", {1: 3.0, 0: 1.0})):
        models, c = cotraining.co_train(y, views, behind=behind)
        z = sum(w * m.logits(*v.pick(np.arange(1200))) for w, m, v in zip(c, models, views)) + c[-1]
        w = hashed.class_weights(y, behind)
        mean[name] = (w * hashed.sigmoid(z)).sum() / w.sum()
    assert abs(mean["even"] - 0.5) < 0.08 and abs(mean["threefold"] - 0.75) < 0.08


def test_the_fit_sees_one_row_of_a_repeated_id(spark):
    """Label 1 belongs to an id with 300 rows among 40 others."""
    rows = [(i, f"words of {i}") for i in range(40)] + [(99, f"copy {i}") for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "id long, y int")
    got = toxicity.sample_rows(texts, ids, "doc_id", "text", {1: 100, 0: 100}).collect()
    assert len(got) == 41 and len({r.id for r in got}) == 41
    again = toxicity.sample_rows(texts.orderBy(F.desc("text")), ids, "doc_id", "text", {1: 100, 0: 100}).collect()
    assert sorted(got) == sorted(again)


def test_co_training_sees_one_row_of_a_repeated_id(spark):
    """Rows of one labelled id and of one without a label are repeated; the
    fit gets every id once."""
    rows = [(i, f"words of {i}") for i in range(30)] + [(i, f"copy {k}") for i in (4, 25) for k in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text", *[F.lit(None).cast(t) for t in ("string", "string", "double")])).alias("text"))
    (m, c), (m1, c1) = cotraining.train(texts, labels), cotraining.train(once, labels)
    assert np.allclose(c, c1) and all(np.allclose(a.w, b.w) for a, b in zip(m, m1))


def test_documents_without_words_all_stay(spark):
    """Rows without an id and words, also equal ones, are no copies; rows
    with words are."""
    rows = [(None, "", "en", f"s{i}") for i in range(5)] + [(1, t, "en", "s") for t in (" \n", " \n", None, "\t\x0b", " ", " ")]
    df = docs(spark, [*rows, (2, "one two", "en", "a"), (3, "one two", "en", "b")])
    out = corpus_pipeline.drop_near_copies(spark, df, SF).collect()
    left = [(r.doc_id, r.text, r.source) for r in out]
    assert sorted(left, key=str) == sorted([(a, b, d) for a, b, _, d in rows[:-1]] + [(2, "one two", "a")], key=str)
