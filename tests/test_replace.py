"""Ordered replacement through the trie equals the plain loop."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import replace as rp

WORDS = st.text("abc瀏", min_size=0, max_size=4)


def loop(text, pairs):
    for term, target in pairs:
        if term:
            text = text.replace(term, target)
    return text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=8), st.lists(st.text("abc瀏x", max_size=30), max_size=5))
def test_equals_the_loop(pairs, texts):
    assert rp.Replacer(pairs).apply(texts) == [loop(t, pairs) for t in texts]


def test_many_pairs_that_feed_each_other():
    random.seed(1)
    word = lambda k: "".join(random.choices("abcde", k=k))
    # targets are no longer than terms: texts that grow with every pair would not end
    pairs = [(word(k), word(random.randint(0, k))) for k in random.choices([2, 3, 4], k=1000)]
    texts = ["".join(random.choices("abcdefg ", k=400)) for _ in range(10)]
    assert rp.Replacer(pairs).apply(texts) == [loop(t, pairs) for t in texts]


def frames(spark):
    syn = [(i, i // 3, None if i % 7 == 0 else f"w{i % 50}") for i in range(120)] + [(200, 99, ""), (201, 99, "w1")]
    df = spark.createDataFrame([(1, "w1 w2 w30w4"), (2, None), (3, ""), (3, "w49w48 x"), (5, "w1" * 4000)], "ord long, t string")
    return spark.createDataFrame(syn, "ord int, SynonymId bigint, Text string"), df.withColumn("term", F.lit("kept"))


def test_trie_path_equals_projection(spark, monkeypatch):
    syn, df = frames(spark)
    read = lambda d: sorted(map(tuple, d.collect()), key=str)
    runs = [lambda: tx.replace_synonyms(df, "t", syn), lambda: tx.replace_all_to_one(df, "t", syn, "-"), lambda: tx.replace_all_to_one(df, "t", syn)]
    monkeypatch.setattr(tx, "MAX_INLINE_PAIRS", 10_000)
    want = [read(r()) for r in runs]
    monkeypatch.setattr(tx, "MAX_INLINE_PAIRS", 2)
    assert [read(r()) for r in runs] == want
    monkeypatch.setattr(rp, "PART_PAIRS", 7)  # parts are applied one after another
    assert [read(r()) for r in runs] == want
    assert tx.replace_synonyms(df.limit(0), "t", syn).count() == 0 and len(want[0]) == 5


def test_script_map_with_many_entries(spark):
    m = spark.createDataFrame([(i, chr(0x4E00 + i), chr(0x4E00 + i + 1)) for i in range(60)] + [(99, "一丁", "X")], "ord int, src string, dst string")
    df = spark.createDataFrame([(1, "一丁一")], "ord long, t string")
    # the phrase first; then each character becomes the next one, up to the last
    assert tx.script_convert(df, ["t"], m).first().t == "X" + chr(0x4E00 + 60)


def test_usage_counts_rows(spark):
    syn = spark.createDataFrame([(1, 1, "ab"), (2, 1, "b"), (3, 2, "zz"), (4, 2, None), (5, 3, "ab"), (6, 4, "")], "ord int, SynonymId bigint, Text string")
    df = spark.createDataFrame([("abab",), ("xb",), (None,), ("",)], "t string")
    got = {(r.SynonymId, r.term, r.first_word): r.n_rows for r in tx.synonym_usage(df, "t", syn).collect()}
    assert got == {(1, "ab", "ab"): 1, (1, "b", "ab"): 2, (3, "ab", "ab"): 1, (4, "", ""): 3}


def test_a_thousand_times_the_pairs_cost_little_more():
    random.seed(2)
    word = lambda k: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    texts = [" ".join(word(6) for _ in range(40)) for _ in range(2000)]
    took = []
    for n in (100, 100_000):
        own = rp.Replacer([(word(7), word(7)) for _ in range(n)])
        t = time.perf_counter()
        own.apply(texts)
        took.append(time.perf_counter() - t)
    assert took[1] < 3 * took[0] + 0.2
