"""Keys of turns: long conversations do not run into their neighbours."""

import pytest
from pyspark.sql import functions as F

from parlance.sources.catalog import TURNS, Catalog


def catalog(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return Catalog(spark, str(path))


def test_long_conversations_keep_their_own_keys(spark, tmp_path):
    rows = [(1, t, "user", f"first {t}") for t in range(1500)] + [(2, t, "user", f"second {t}") for t in range(1500)]
    cat = catalog(spark, tmp_path, rows)
    q = cat.read("questions")
    assert q.count() == 3000 and q.select("qid").distinct().count() == 3000
    faq = cat.read("faq").orderBy("ord").select("Text").collect()
    assert [r.Text for r in faq] == [t for *_, t in rows]  # still in the order of turns


def test_a_turn_beyond_the_bound_is_an_error(spark, tmp_path):
    cat = catalog(spark, tmp_path, [(1, TURNS, "user", "x")])
    with pytest.raises(Exception, match="a turn must lie"):
        cat.read("questions").collect()
    none = catalog(spark, tmp_path / "b", [(1, None, "user", "x")]).read("questions")
    assert none.where(F.col("qid").isNull()).count() == 1
