import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import periods as R
from parlance.llm.common import mix64

from .helpers import SF, clashing, docs, odd_docs


def brute(w, least=12):
    """(start, end, period) of all runs, by start and period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def hashes(w):
    return mix64(np.array(w, np.uint64) + np.uint64(5))


@st.composite
def streams(draw):
    out = []
    for _ in range(draw(st.integers(0, 5))):
        k, n = draw(st.sampled_from([1, 2, 2, 3, 5])), draw(st.sampled_from([0, 1, 5, 12, 13, 30, 60, 120]))
        w = draw(st.lists(st.integers(0, k - 1), min_size=n, max_size=n))
        if n > 3 and draw(st.booleans()):
            a = draw(st.integers(0, n - 1))
            p = draw(st.integers(1, max(1, (n - a) // 2)))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append(w)
    return out


@settings(max_examples=300, deadline=None)
@given(streams(), st.sampled_from([12, 12, 2, 3, 7, 20]), st.sampled_from([1, 3, 7, 50, 1000]))
def test_runs_equal_brute_force_however_words_are_appended(stream, least, step):
    flat = hashes([x for d in stream for x in d])
    first = np.concatenate([[0], np.cumsum([len(d) for d in stream])]).astype(np.int64)
    assert list(map(tuple, R.find(flat, first, least, step).T.tolist())) == [(d, *r) for d, w in enumerate(stream) for r in brute(w, least)]


def test_a_square_is_caught_with_its_last_word():
    c, w = R.Catchers(2), [9, 1, 2, 3, 1, 2, 3, 1, 5]
    seen = []
    for i, x in enumerate(w):
        c.append(hashes([x]), [0, 1], goes_on=i > 0)
        seen.append([tuple(r) for r in c.caught[1:].T.tolist() if r[2] == 3 and r[1] - r[0] >= 6])
    assert seen[5] == [] and seen[6] == [(1, 7, 3)] and seen[7] == [(1, 8, 3)] and seen[8] == [(1, 8, 3)]
    assert [(0, 1, 8, 3)] == list(map(tuple, c.finish().T.tolist()))


def test_long_and_aperiodic_texts():
    assert R.find(hashes([7] * 300_000), [0, 300_000]).T.tolist() == [[0, 0, 300_000, 1]]
    unit = list(range(10_000))
    assert R.find(hashes(unit * 7 + [3]), [0, 70_001]).T.tolist() == [[0, 0, 70_000, 10_000]]
    w = [bin(i).count("1") & 1 for i in range(3000)]  # overlap-free
    assert list(map(tuple, R.find(hashes(w), [0, len(w)], step=100).T.tolist())) == [(0, *r) for r in brute(w)]


def cycled(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, w):
    found = brute(w)
    out = {i for s, e, p in found for i in range(s + p, e)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(((s - e, s, p) for s, e, p in found), default=None)
    cells = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    return doc_id, len(found), *cells, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in out))


@pytest.fixture(scope="module")
def table(spark):
    random.seed(8)
    more = [(300 + i, " ".join(random.choices("ab", k=random.randint(1, 90)))) for i in range(60)]
    more += [(500, "é 日本 " * 40), (501, "x\x0b" * 3000), (502, "A a " * 20), (503, " x " * 13), (504, "w" * 100_000 + " " + "w" * 100_000)]
    some = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text")
    return some.union(odd_docs(spark).select("doc_id", "text")).union(docs(spark, more).select("doc_id", "text")).cache()


def test_query_equals_brute_force(spark, table):
    got = R.digests(R.with_cycles(clashing(table)))
    want = [expected(r.doc_id, cycled(r.doc_id, r.text)) for r in table.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert R.digests(table.limit(0)).count() == 0 and sum(r[1] > 0 for r in want) > 20


def test_operator_gives_runs_and_texts(spark, table):
    for r in R.runs(table.withColumn("raw", table.text)).collect():
        t = r.raw
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(w)
        out = {i for s, e, p in found for i in range(s + p, e)}
        assert [tuple(x) for x in r.runs] == [(s, e - s, p) for s, e, p in found] and r.n_words == len(w)
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in out)
