import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import byte_prefix as B
from parlance.llm.vocab import classes

from .helpers import SF, clashing, docs, odd_docs

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = st.text(st.one_of(st.sampled_from(" \n\t'  abcstrevelldmxyz019.,!?<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


def library(path=PATH):
    v = B.load(path)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(zip(v.bytes, v.ids.tolist())), special_tokens={})


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(name):
    path = P.path(name)
    enc, v = library(path), B.load(path)
    store = B.Store(v)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(TEXTS, min_size=1, max_size=6))
    def check(texts):
        texts = [*texts, "x'll  " + texts[0], texts[-1] * 9, "<|endoftext|>"]
        ids, at = store.gather(1, *store.look_up(*buffers(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [enc.encode_ordinary(t) for t in texts]
        back, _ = v.to_bytes(ids)
        assert back.tobytes() == "".join(texts).encode()

    check()


def test_every_prefix_ends_in_its_last_token():
    enc, v = library(), B.load(PATH)
    random.seed(5)
    for word in [b"information", b"x" * 130, bytes(random.choices(b"etaoinsh", k=150)), "日本語".encode(), bytes(random.choices(range(256), k=90))]:
        last, _, _ = v.prefixes([word])[0]
        for k in range(1, len(word) + 1):
            assert v.ids[last[k - 1]] == enc._encode_single_piece(word[:k])[-1]


def test_long_pieces():
    enc, v = library(), B.load(PATH)
    random.seed(4)
    texts = ["a" * 100_000, "ab" * 20_000, "".join(random.choices("etaoin", k=100_000)), " " * 9999, "!?" * 5000]
    store = B.Store(v)
    ids, at = store.gather(1, *store.look_up(*buffers(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [enc.encode_ordinary(t) for t in texts]


def whole(v, text):
    raw, last = text.encode(), []
    start, end, _ = v.split(*buffers([text]))
    for a, b in zip(start.tolist(), end.tolist()):
        last += v.prefixes([raw[a:b]])[0][0].tolist()
    return start, v.ids[np.array(last, np.int64)]


def test_edits_equal_a_new_encoding():
    enc, v = library(), B.load(PATH)
    random.seed(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "'", "'ll", "x1", "é", "日本", "!?", "aaaa" * 10, "e" * 90, " th", "'l"]
    for _ in range(600):
        text = "".join(random.choices(parts, k=random.randint(0, 30)))
        at = random.randint(0, len(text))
        until = random.randint(at, min(len(text), at + random.choice([0, 1, 5, 100])))
        more = "".join(random.choices(parts, k=random.randint(0, 3)))
        new, ids, starts, last, _ = B.edited(v, text, *whole(v, text), at, until, more)
        want = whole(v, new)
        assert new == text[:at] + more + text[until:] and ids == enc.encode_ordinary(new)
        assert starts == want[0].tolist() and last == want[1].tolist()


def test_edits_and_appends_do_only_what_is_near():
    v = B.load(PATH)
    random.seed(6)
    words = " ".join("".join(random.choices("etaoinshr", k=8)) for _ in range(5000))
    *_, work = B.edited(v, words, *whole(v, words), 20_000, 20_001, "zz")
    assert work < 100
    *_, work = B.edited(v, words, *whole(v, words), len(words), len(words), " more")
    assert work < 30
    word = "".join(random.choices("etaoinshr", k=20_000))  # one piece
    *_, work = B.edited(v, word, *whole(v, word), 10_000, 10_001, "z")
    assert work < 2000


def test_dataframes_of_odd_rows_and_edits(spark):
    enc = library()
    df = clashing(odd_docs(spark)).withColumn("starts", F.lit("x"))
    got = B.encode(df, PATH, prefixes=True)
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in df.collect())
    assert all(r.ids == enc.encode_ordinary(r.text or "") and len(r["last"]) == len((r.text or "").encode()) for r in rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in B.decode(got, PATH).collect())
    edits = got.withColumn("at", F.when(F.col("doc_id") % 2 == 0, 3)).withColumn("to", F.col("at") + 2).withColumn("more", F.when(F.col("doc_id") % 3 > 0, " 'll é"))
    before = {(r.doc_id, r.text, r.more): r for r in edits.collect()}
    after = B.edit(edits, PATH, "at", "to", "more").collect()
    want = []
    for i, t, m in before:
        t, a = t or "", len(t or "") if i is None or i % 2 else min(3, len(t or ""))
        want.append((i, t[:a] + (m or "") + t[a + 2 :] if i is not None and i % 2 == 0 else t + (m or "")))
    assert sorted({(r.doc_id, r.text) for r in after}, key=str) == sorted(set(want), key=str)
    assert all(r.ids == enc.encode_ordinary(r.text) for r in after)
    assert B.encode(df.limit(0), PATH, prefixes=True).count() == 0 and B.edit(edits.limit(0), PATH, "at", "to", "more").count() == 0


def test_query_equals_the_library(spark):
    enc = library()
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text")).union(docs(spark, [(-1, "x" * 200_000)]).select("doc_id", "text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in df.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert sorted(map(tuple, B.digests(df, PATH).collect()), key=str) == sorted(want, key=str)


def test_a_file_that_merges_cannot_reach_is_refused(tmp_path):
    import base64

    lines = [bytes([b]) for b in range(256)] + [b"abc"]
    f = tmp_path / "x.tiktoken"
    f.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(lines)))
    with pytest.raises(ValueError, match="lower ranks"):
        B.Ranks(str(f))


def test_split_classes_equal_the_library():
    """Every code point beside a letter, a number and another sign."""
    ranks = {bytes([b]): b for b in range(256)}
    for x in b"a1!":
        for lead in range(256):
            ranks[bytes([x, lead])] = len(ranks)
    enc = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = np.full(0x110000, 3, np.uint8)
    for kind, x in ((1, "a"), (2, "1"), (0, "!")):
        found[[c for c in points if enc.encode_ordinary(x + chr(c))[0] >= 256]] = kind
    assert (found[points] == classes()[points]).all()
