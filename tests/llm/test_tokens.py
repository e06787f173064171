import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import bpe, prefix_counts
from parlance.llm.vocab import load

from .helpers import SF, clashing, odd_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


TEXTS = st.text(st.one_of(st.sampled_from(" \n\t'  abcSTREVELLDMxyz019.,!?<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_ids_and_counts_equal_the_library(texts):
    library = Tokenizer.from_file(PATH)
    texts = [*texts, "<|endoftext|>".join(texts), "x'll " + texts[0]]
    expect = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, ends = bpe.Pieces(load(PATH)).encode(*buffers(texts))
    begin = np.concatenate([[0], ends[:-1]])
    assert [ids[a:b].tolist() for a, b in zip(begin, ends)] == expect
    assert bpe.decode_texts(load(PATH), ids, ends) == [library.decode(e, skip_special_tokens=False) for e in expect]
    assert prefix_counts.table_of(PATH).totals(*buffers(texts)).tolist() == [len(e) for e in expect]


def test_every_prefix_has_its_count(library):
    random.seed(2)
    texts = ["it's  a\n\n  test, they'll 're <|endoftext|> 12 345", "   ", "a" * 200, "".join(random.choice("abcd ") for _ in range(300)), "日本 語テキスト"]
    for t in texts:
        p = prefix_counts.TextPrefixes(prefix_counts.table_of(PATH), t)
        for k in range(len(t) + 1):
            assert p.at(k) == len(library.encode(t[:k], add_special_tokens=False).ids)
        for budget in (0, 1, 5, 10_000):
            assert p.at(p.fit(budget)) <= budget


def test_long_words_and_runs(library):
    random.seed(4)
    texts = ["a" * 3000, "ab" * 2000, "".join(random.choice("etaoin") for _ in range(5000)), " " * 999, "!?" * 500]
    ids, ends = bpe.Pieces(load(PATH)).encode(*buffers(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert prefix_counts.table_of(PATH).totals(*buffers(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_queries_on_odd_rows_and_clashing_columns(spark, library):
    df = clashing(odd_docs(spark))
    rows = {(r.doc_id, r.text) for r in df.collect()}
    got = [tuple(r) for r in bpe.digests(df, PATH).collect()]
    expect = []
    for r in df.collect():
        e = library.encode(r.text or "", add_special_tokens=False).ids
        expect.append((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(expect, key=str) and rows
    counts = prefix_counts.token_counts(df, PATH, limit=3).collect()
    expect = [(i, len((t or "").encode()), n, n > 3) for (i, n, _, _), t in zip(expect, [r.text for r in df.collect()])]
    assert sorted(map(tuple, counts), key=str) == sorted(expect, key=str)
    assert bpe.digests(df.limit(0), PATH).count() == 0 and prefix_counts.token_counts(df.limit(0), PATH).count() == 0


def test_encode_then_decode_gives_the_text(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    ids = bpe.encode(df.select("doc_id", "text"), PATH, check=True)
    assert ids.where("NOT round_trip").count() == 0
    back = bpe.decode(ids, PATH).select("doc_id", "decoded").join(df, "doc_id")
    assert back.where(F.col("decoded") != F.col("text")).count() == 0 and back.count() == df.count()
