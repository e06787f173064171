"""Small tables and brute-force versions for the tests of parlance.llm."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [None, "", " ", "\n\t", "a", "one two", "one two three four five", "A" * 5000, "the cat sat on the mat " * 400, "é ü 日本語 😀 " * 20, "<|endoftext|> x <|endoftext|>"]


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def odd_docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(ODD_TEXTS)]
    return docs(spark, [*rows, (None, "a row without an id"), (3, "the id of another row"), (2, " "), (6, ODD_TEXTS[6])])


def clashing(df):
    """Extra columns named like results and inner columns."""
    from pyspark.sql import functions as F

    out = df
    for c in ("id", "row", "n", "th", "c", "block", "codes", "score", "ids", "Size", "taken", "n_tokens", "component_id", "_row", "component"):
        out = out.withColumn(c, F.lit("x"))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingle_set(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(texts, n, percent):
    """Smallest row number reachable from each row."""
    sets = [shingle_set(t, n) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inv = defaultdict(list)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in inv[x]).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inv[x].append(i)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def repeat_masks(raws, width):
    """For each byte string, which bytes a repeated window covers."""
    seen = Counter(b[p : p + width] for b in raws for p in range(len(b) - width + 1))
    out = []
    for b in raws:
        mask = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                mask[p : p + width] = b"\1" * width
        out.append(mask)
    return out
