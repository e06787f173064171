from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.sources.catalog import SYN_ROWS, SYN_SCHEMA, STOP_ROWS, SCRIPT_MAP_ROWS, SCRIPT_MAP_SCHEMA


def _one(spark, s, col="t"):
    return spark.createDataFrame([(1, s)], f"ord long, {col} string")


def test_synonym_canon_skips_null_first(spark):
    syn = spark.createDataFrame(SYN_ROWS, SYN_SCHEMA)
    canon = {r.SynonymId: r.first_word for r in tx.synonym_canon(syn).select("SynonymId", "first_word").distinct().collect()}
    assert canon == {10: "le", 20: "und", 30: "la", 40: "of the"}


def test_ordered_replace_chains(spark):
    syn = spark.createDataFrame(SYN_ROWS, SYN_SCHEMA)
    # the -> le (group 10), then le -> la (group 30): earlier outputs feed later pairs
    out = tx.replace_synonyms(_one(spark, "the cat and a dog"), "t", syn).first().t
    assert out == "la cat und a dog"


def test_replace_to_one_deletes(spark):
    syn = spark.createDataFrame(SYN_ROWS, SYN_SCHEMA)
    out = tx.replace_all_to_one(_one(spark, "the and x"), "t", syn).first().t
    assert out == "  x"


def test_stopwords_keep_separators(spark):
    stop = spark.createDataFrame([(s,) for s in STOP_ROWS], "Text string")
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, None), (3, "The end.")], "ord long, t string")
    got = {r.ord: r.t for r in tx.exclude_stopwords(df, "t", stop).collect()}
    assert got == {1: " cat   dog", 2: None, 3: "The end."}


def test_stopwords_join_path_equals_inline(spark, monkeypatch):
    stop = spark.createDataFrame([(s,) for s in STOP_ROWS], "Text string")
    df = spark.createDataFrame(
        [(1, "the cat and the dog"), (2, "in la de der"), (3, ""), (4, None), (1, "the dog")], "ord long, t string"
    )
    read = lambda: sorted(((r.ord, r.t) for r in tx.exclude_stopwords(df, "t", stop).collect()), key=str)
    a = read()
    assert (4, None) in a and (2, "   ") in a and (1, " dog") in a and (1, " cat   dog") in a
    monkeypatch.setattr(tx, "MAX_INLINE_STOPWORDS", 0)
    assert read() == a


def test_chunked_fold_equals_single(spark, monkeypatch):
    syn = spark.createDataFrame(SYN_ROWS, SYN_SCHEMA)
    df = spark.createDataFrame([(1, "the cat and of the le"), (2, "le la the")], "ord long, t string")
    a = {r.ord: r.t for r in tx.replace_synonyms(df, "t", syn).collect()}
    monkeypatch.setattr(tx, "MAX_INLINE_PAIRS", 2)
    b = {r.ord: r.t for r in tx.replace_synonyms(df, "t", syn).collect()}
    assert a == b


def test_strip_punct_ascii_only(spark):
    out = _one(spark, "a,b!c？d").select(tx.strip_punct("t").alias("t")).first().t
    assert out == "abc？d"


def test_script_convert_longest_first(spark):
    m = spark.createDataFrame(SCRIPT_MAP_ROWS, SCRIPT_MAP_SCHEMA)
    out = tx.script_convert(_one(spark, "straße ß é ç"), ["t"], m).first().t
    assert out == "strasse ss e c"


def test_segment_is_lossless_and_tokens(spark):
    r = _one(spark, "瀏覽器打不開, OK 42x").select(
        F.array_join(tx.segment("t"), "").alias("j"), tx.tokens("t").alias("k"), tx.chars("t").alias("c")
    ).first()
    assert r.j == "瀏覽器打不開, OK 42x"
    assert r.k == ["瀏", "覽", "器", "打", "不", "開", "ok", "42", "x"]
    assert len(r.c) == 14


def test_stopword_pattern_separator_words(spark):
    stop = spark.createDataFrame([("the",), (", ",), ("a.b",)], "Text string")
    df = spark.createDataFrame([(1, "the, cat, the,dog a.b"), (2, "there, ,  x")], "ord long, t string")
    got = {r.ord: r.t for r in tx.exclude_stopwords(df, "t", stop).collect()}
    # segments: the|, |cat|, |the|,|dog| |a|.|b  -> drop "the" and ", " only
    assert got == {1: "cat,dog a.b", 2: "there, ,  x"}


def test_custom_segmenter_char_bigrams(spark):
    from pyspark.sql import functions as F

    stop = spark.createDataFrame([("不開",)], "Text string")
    df = spark.createDataFrame([(1, "瀏覽器打不開")], "ord long, t string")

    def pairs(c):  # non-overlapping two-character segments
        return F.regexp_extract_all(c, F.lit("(?s).{1,2}"), 0)

    out = tx.exclude_stopwords(df, "t", stop, segmenter=pairs).first().t
    assert out == "瀏覽器打"
