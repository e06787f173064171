import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import fill_middle as M

from .helpers import SF, clashing, docs, odd_docs


def plain(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in M.MARKS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows(spark):
    more = [(100 + i, t) for i, t in enumerate(["a\nb", "\n", "\n\n\n", "x<P>y\nz", "<S", "<\nP>\n", "r\r\nq z\x85w\n", "$1\\n\n$\\", "😀\n日本\n" * 50, "<M>"])]
    return odd_docs(spark).union(docs(spark, more)).union(docs(spark, [(200, "one line\n" * 100_000), (201, "x" * 1_000_000), (202, "\n" * 300_000), (203, "é" * 50 + "\n")])).cache()


@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_equals_plain_python(spark, rows, percent, spm):
    df = clashing(rows).withColumn("form", F.lit("x")).withColumn("__text", F.lit("y"))
    got = M.transform(df, percent=percent, spm_percent=spm)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()], key=str) == sorted([(r.doc_id, *plain(r.doc_id, r.text, percent, spm)) for r in rows.collect()], key=str)
    back = M.restore(got).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=str) == sorted([(r.doc_id, r.text or "") for r in rows.collect()], key=str)


def test_query(spark, rows):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(rows.select("doc_id", "text"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in df.collect():
        *cells, out = plain(r.doc_id, r.text)
        want.append((r.doc_id, *cells, sha(out), sha(r.text or "")))
    assert sorted(map(tuple, M.digests(df).collect()), key=str) == sorted(want, key=str)
    assert M.digests(df.limit(0)).count() == 0


def test_other_units_and_marks(spark):
    df = docs(spark, [(i, "ab cd  ef $x\\y gh" + "!" * i) for i in range(40)])
    got = M.transform(df, unit=r"\S+\s*", marks=("[$PRE]", "[\\SUF]", "[MID]"), percent=100)
    back = M.restore(got, marks=("[$PRE]", "[\\SUF]", "[MID]"))
    assert {r.form for r in got.collect()} == {"psm", "spm"} and all(r.n == 5 for r in got.collect())
    assert sorted(r.restored for r in back.collect()) == sorted(r.text for r in df.collect())


def test_marks_that_could_be_mixed_up_are_refused(spark):
    for marks in [("", "b", "c"), ("a", "ab", "c"), ("<a", "a>", "x"), ("aba", "x", "y"), ("a", "a", "b")]:
        with pytest.raises(ValueError):
            M.transform(docs(spark, [(1, "x")]), marks=marks)


def test_no_python_in_the_plan(spark):
    df = M.digests(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract_all(") == 1
