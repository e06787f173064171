"""Word lattice: best path against all paths, and the operators that use it."""

import random
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import lattice as lt
from parlance.operators import words as wd


def every_cut(run):
    for gaps in product((0, 1), repeat=len(run) - 1):
        out, at = [], 0
        for i, g in enumerate(gaps, 1):
            if g:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


def brute(words, run):
    own = lt.Lattice(words)
    price = {w: int(own.cost[i]) for i, (w, _) in enumerate([x for x in words if x[0]])}
    cost = lambda cut: sum(price.get(w, own.unknown if len(w) == 1 else 1 << 60) for w in cut)
    # the least sum, then the longer last word, and so on backwards
    return min(every_cut(run), key=lambda c: (cost(c), [-len(w) for w in reversed(c)]))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("上下中大", min_size=1, max_size=4), st.integers(1, 50), max_size=8), st.lists(st.text("上下中大人", min_size=1, max_size=9), min_size=1, max_size=4))
def test_least_cost_path(words, runs):
    words = list(words.items())
    assert lt.Lattice(words).segments(runs) == [brute(words, r) for r in runs]


def test_segments_join_to_the_text():
    own = lt.Lattice([("瀏覽器", 5), ("打不開", 4), ("網站", 3), ("問題", 9)])
    texts = ["瀏覽器打不開, OK 42x", "", "the 網站!有問題\n", "ภาษาไทย", "カタカナ語", "a b", "。", "瀏覽器" * 3000]
    got = own.segments(texts)
    assert ["".join(g) for g in got] == texts
    assert got[0] == ["瀏覽器", "打不開", ", ", "OK", " ", "42x"]
    assert got[2] == ["the", " ", "網站", "!", "有", "問題", "\n"] and len(got[7]) == 3000
    assert own.segments(texts, words_only=True)[2] == ["the", "網站", "有", "問題"]


LEXICON = ["瀏覽器", "問題", "網站", "刷卡", "很慢", "打不開", "請問", "失敗", "更新", "密碼", "登入", "客服"]


def sentences(n):
    random.seed(7)
    return [random.choices(LEXICON, k=random.randint(1, 6)) for _ in range(n)]


def test_dictionary_from_the_corpus_makes_stop_and_top_words_bite(spark):
    cut = sentences(400)
    df = spark.createDataFrame([(i, "".join(c)) for i, c in enumerate(cut)] + [(1000, None), (1001, "")], "ord long, t string")
    words = lt.count_words(df, "t", min_count=5, cohesion=5.0).cache()
    assert {r.word for r in words.collect() if len(r.word) > 1} >= set(LEXICON)
    own = lt.lattice(words)
    assert own.segments(["".join(c) for c in cut]) == cut  # every word is found again
    stop = spark.createDataFrame([("瀏覽器",), ("很慢",)], "Text string")
    got = {r.ord: r.t for r in tx.exclude_stopwords(df, "t", stop, segmenter=lt.segmenter(words)).collect()}
    assert got == {**{i: "".join(w for w in c if w not in ("瀏覽器", "很慢")) for i, c in enumerate(cut)}, 1000: None, 1001: ""}
    plain = {r.ord: r.t for r in tx.exclude_stopwords(df, "t", stop).collect()}
    assert sum("瀏覽器" in (t or "") for t in plain.values()) > 50  # whole sentences are segments there
    top = wd.top_words(df, "t", stop, [2, 3], 20, segmenter=lt.segmenter(words, words_only=True)).collect()
    want = {w: sum(c.count(w) for c in cut) for w in LEXICON if w not in ("瀏覽器", "很慢")}
    assert {r.word: r.cnt for r in top} == want


def test_counts_are_those_of_a_plain_count(spark):
    random.seed(3)
    texts = ["".join(random.choices("上下中大x ", k=random.randint(0, 40))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    got = {r.word: r.n for r in lt.count_words(df, "t", max_len=3, min_count=2, cohesion=1.5).collect()}
    grams = {}
    for t in texts:
        for run in t.replace("x", " ").split():
            for k in (1, 2, 3):
                for i in range(len(run) - k + 1):
                    grams[run[i : i + k]] = grams.get(run[i : i + k], 0) + 1
    total = sum(n for w, n in grams.items() if len(w) == 1)
    want = {w: n for w, n in grams.items() if len(w) == 1 or (n >= 2 and min(n * total / (grams[w[:i]] * grams[w[i:]]) for i in range(1, len(w))) >= 1.5)}
    assert got == want


def test_spaced_words_are_found_again(spark):
    words = spark.createDataFrame([("the", 50), ("cat", 5), ("at", 20), ("sat", 5), ("thec", 1)], "word string, n long")
    seg = lt.segmenter(words, letters=True)
    df = spark.createDataFrame([("thecatsat",), (None,)], "t string")
    assert [r.s for r in df.select(seg(F.col("t")).alias("s")).collect()] == [["the", "cat", "sat"], None]


def test_a_dictionary_beyond_its_size_is_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(lt, "MAX_WORDS", 1)
    with pytest.raises(ValueError, match="at most"):
        lt.lattice(spark.createDataFrame([("a", 1), ("b", 1)], "word string, n long"))
