"""Every stage against a plain version of it, on its own input."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import mixing, toxicity
from parlance.llm.common import crc_mod5, written

from .helpers import SF, jaccard_components, odd_docs, repeat_masks


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        nxt = written(stage(spark, docs, SF), name)
        out.append((docs, nxt))
        docs = nxt
    return out


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_columns(spark, steps):
    cols = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(P.STAGES) == 5 and all(out.columns == cols for _, out in steps[:-1])


def test_toxic_documents_go_and_others_stay(spark, steps):
    docs, out = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = toxicity.score(docs, toxicity.train(docs, labels.where(crc_mod5("doc_id") != 0)))
    assert rows(out, "doc_id", "text") == rows(score.where("score < 0.5"), "doc_id", "text")
    kept = out.join(labels, "doc_id")
    assert kept.where("toxic = 0").count() >= 0.98 * docs.join(labels, "doc_id").where("toxic = 0").count()


def test_one_of_each_group_stays(steps):
    docs, out = steps[1]
    given = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    low, _ = jaccard_components([t for _, t in given], 5, 80)
    assert rows(out, "doc_id") == sorted(((given[i][0],) for i in set(low)), key=str)


def test_passages_are_cut(steps):
    docs, out = steps[2]
    given = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    masks = repeat_masks([t.encode() for _, t in given], P.PASSAGE)
    expect = [(i, bytes(b for b, m in zip(t.encode(), mask) if not m).decode("utf-8", "ignore")) for (i, t), mask in zip(given, masks)]
    assert sorted(map(tuple, out.select("doc_id", "text").collect())) == expect
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0


def test_mix_emits_its_copies(steps):
    docs, out = steps[3]
    expect = mixing.mix(docs).where("copies > 0").select("doc_id", "copies")
    assert rows(out.groupBy("doc_id").count(), "doc_id", "count") == rows(expect, "doc_id", "copies")


def test_tokens_are_the_library_s(steps):
    import public_tokenizers

    docs, out = steps[4]
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    expect = sorted((i, t.encode(x, add_special_tokens=False).ids) for i, x in map(tuple, docs.select("doc_id", "text").collect()))
    assert sorted((r.doc_id, list(r.ids)) for r in out.collect()) == expect
    assert out.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_odd_rows_pass_every_stage(spark):
    for df in (odd_docs(spark), odd_docs(spark).limit(0)):
        docs = written(df, "odd")
        for name, stage in P.STAGES:
            docs = written(stage(spark, docs, SF), name)
            assert docs.count() > 0 if df.count() else docs.count() == 0


def test_run_is_the_stages(spark, steps):
    assert rows(P.run(spark, SF), "doc_id", "n_tokens") == rows(steps[4][1], "doc_id", "n_tokens")
