import hashlib
import random

import numpy as np
import pytest

from parlance.llm import ngram_join, run_index
from parlance.llm.common import components, text_chunks

from .helpers import SF, clashing, docs, jaccard_components, odd_docs, repeat_masks, shingle_set, words


def family(seed=1, groups=25, size=8):
    """Groups of texts with growing edits, a hot group, and shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(14))
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        for k in range(size if g else 150):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) + (" " + line if rng.random() < 0.4 else ""))
    return out


@pytest.mark.parametrize("n,percent,split", [(4, 85, 4096), (5, 80, 16), (1, 60, 4096)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, n, percent, split):
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    monkeypatch.setattr(ngram_join, "LIGHT", split // 8 if split < 100 else 4)
    monkeypatch.setattr(ngram_join, "TOGETHER", split * 30)
    texts = family() + ["", " ", "x", "x", "X", "one two three"] + [None]
    low, sizes = jaccard_components(texts, n, percent)
    got = ngram_join.join(clashing(docs(spark, list(enumerate(texts)))), n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == [(i, s, c) for i, (s, c) in enumerate(zip(sizes, low))]


def test_signatures_meet_for_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(2, 60))
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        y = x.copy()
        y[rng.random(len(x)) < 0.08] += np.uint64(1)
        y = np.unique(np.append(y, rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 85 * (len(x) + len(y) - shared) and len(x) > 1 and len(y) > 1:
            kind = lambda s: (s % np.uint64(4) < rng_share).astype(np.int8)
            for rng_share in (0, 2, 4):
                a, b = ngram_join.signatures(x, kind(x), 85), ngram_join.signatures(y, kind(y), 85)
                assert len(np.intersect1d(a, b))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for size in (2, 50, 3000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            y = np.unique(np.append(x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**63, size // 3).astype(np.uint64)))
            p, q = ngram_join.parity(x), ngram_join.parity(y)
            for w in (min(len(p), len(q)), ngram_join.BITS // 64):
                a, b = ngram_join.folded(p, w), ngram_join.folded(q, w)
                assert ngram_join.most_overlap(len(x), len(y), a, b) >= len(np.intersect1d(x, y))


def test_jaccard_join_odd_rows(spark):
    got = ngram_join.join(odd_docs(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(got) == odd_docs(spark).count()
    assert by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[2] == [(0, 2), (0, 2)] and by[None] == [(2, None)] and len(by[6]) == 2
    assert ngram_join.join(odd_docs(spark).limit(0)).count() == 0


def expected(rows, width):
    masks = repeat_masks([(t or "").encode() for _, t in rows], width)
    out = []
    for (i, t), m in zip(rows, masks):
        raw = (t or "").encode()
        kept = bytes(b for b, x in zip(raw, m) if not x)
        spans = sum(1 for a, b in zip([0, *m], m) if b and not a)
        out.append((i, len(raw), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


PERIODIC = [(500, "a" * 400), (501, "a" * 39), (502, "a" * 40), (503, "ab" * 300), (504, "xyz" * 100 + "q" + "xyz" * 100), (505, "é" * 90), (506, "ab" * 20)]


@pytest.mark.parametrize("many,index_bytes", [(1024, 1 << 20), (2, 2000)])
def test_repeats_equal_brute_force(spark, monkeypatch, many, index_bytes):
    monkeypatch.setattr(run_index, "MANY", many)
    monkeypatch.setattr(run_index, "INDEX_BYTES", index_bytes)
    texts = family(2, 12, 6)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef gh") for _ in range(900))
    rows = [*enumerate(texts), *PERIODIC, (600, long), (601, "zz" + long[100:700] + "yy" + long[50:300]), (602, None), (603, ""), (600, long)]
    got = run_index.removals(clashing(docs(spark, rows)), 40)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 40)


def test_repeats_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, run_index.removals(df).collect()), key=str) == expected(rows, 400)
    assert run_index.removals(df.limit(0)).count() == 0
    odd = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, run_index.removals(odd, 64).collect()), key=str) == expected(rows, 64)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(7)
    for _ in range(20):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        ends = np.cumsum([len(p) for p in parts])
        got = run_index.RunIndex(np.frombuffer(b"".join(parts), np.uint8), ends).matching_statistics()
        suffixes = [p[i:] for p in parts for i in range(len(p))]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got.tolist() == [max([common(s, t) for j, t in enumerate(suffixes) if j != i] or [0]) for i, s in enumerate(suffixes)]


def test_segments_hold_every_window_once():
    rng = random.Random(8)
    raws = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 39, 40, 500, 77)] + [b"a" * 300]
    data, offs = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    doc, start, n, _, _ = run_index.segments(data, offs, 40, 32)
    got = sorted((d, s + k) for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist()) for k in range(m))
    assert got == [(d, p) for d, r in enumerate(raws) for p in range(len(r) - 39)]


def test_cut_texts_keep_the_rest(spark):
    line = "the same long passage in two documents, word for word and longer than the width"
    df = clashing(docs(spark, [(1, "first " + line + " end"), (2, "second é" + line + "é tail"), (3, None), (4, "alone")]))
    got = {r.doc_id: r.text for r in run_index.without_repeats(df, 40).collect()}
    assert got == {1: "first  end", 2: "second éé tail", 3: None, 4: "alone"} or {k: len(v or "") for k, v in got.items()} == {1: 9, 2: 14, 3: 0, 4: 5}
    assert run_index.without_repeats(df, 40).columns == df.columns


def test_words_are_those_of_the_pattern():
    from parlance.llm.common import Words

    texts = ["a b", " a\x0bb\x0cc\x1cd e f ", "", "\n", "é\té", "x"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w = Words(data, offs)
    got = [[data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts] and len(shingle_set("a b c d e", 4)) == 2


def test_tokens_shared_by_chance_make_no_buckets():
    """Texts that share lone shingles meet in no bucket, though frequencies
    of large tables cannot tell these from shingles of one text."""
    rng = np.random.default_rng(6)
    often = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.append(rng.integers(0, 2**63, 190), rng.choice(often, 10, replace=False)).astype(np.uint64)) for _ in range(200)]
    cls = ngram_join.frequency_classes(np.full(1 << 10, 90))
    sigs = np.concatenate([ngram_join.signatures(s, cls[(s >> np.uint64(54)).astype(np.int64)], 85) for s in sets])
    assert len(sigs) - len(np.unique(sigs)) <= 2


def test_components_of_few_and_many_edges(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    low = {v: v for e in edges for v in e}
    for _ in range(len(low)):
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    want = sorted((v, c) for v, c in low.items() if any(v in e and e[0] != e[1] for e in edges))
    assert sorted(map(tuple, components(df).collect())) == want
    assert sorted(map(tuple, components(df, max_rows=10).collect())) == want
    assert components(df.limit(0)).count() == 0


def test_sets_of_a_slice_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 9999, 400))) for _ in range(1500)]  # 3 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tracemalloc.start()
    n = sum(len(ngram_join.doc_sets(d, o, 4)) for _, d, o in text_chunks([batch], limit=ngram_join.SLICE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 and peak < 60e6
