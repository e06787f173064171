import duckdb
from pyspark.sql import functions as F

from parlance.llm import mixing
from parlance.llm.oracle import ORACLE
from parlance.llm.queries import QUERIES

from .helpers import SF, clashing, docs, odd_docs


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    expect = sorted(con.sql(ORACLE["op8_mixing"]).project(", ".join(cols)).fetchall())
    assert sorted(map(tuple, QUERIES["op8_mixing"](spark, SF).select(*cols).collect())) == expect


def test_targets_are_met_and_no_document_is_taken_too_often(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    out = mixing.mix(docs(spark, rows)).cache()
    per = out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.first("source_size").alias("size")).collect()
    total = sum(r.size for r in per)
    assert abs(sum(r.target for r in per) - 1.5 * total) < 1e-6 * total
    for r in per:
        assert r.target <= 2 * r.size + 1e-9 and abs(r.taken - r.target) <= 0.02 * r.target + 200
    assert out.where("taken > 2 * size").count() == 0
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 5, 2, 1, 5: a stops at 20, null at 1000, b and c share the rest 2 : 1
    rest = 1.5 * 2510 - 20 - 1000
    assert got["a"] == 20 and got[None] == 1000 and abs(got["b"] - rest * 2 / 3) < 1e-6 and abs(got["c"] - rest / 3) < 1e-6


def test_odd_rows(spark):
    df = odd_docs(spark)
    out = mixing.mix(clashing(df))
    assert out.count() == df.count() and {"_row", "block", "size", "taken"} <= set(out.columns)
    assert out.where("text IS NULL AND (size <> 0 OR taken <> 0)").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    empty = mixing.mix(docs(spark, [(1, ""), (2, None)]))
    assert [tuple(r) for r in empty.select("size", "target", "taken").collect()] == [(0, 0.0, 0), (0, 0.0, 0)]
