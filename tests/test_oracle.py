"""Registered queries against their DuckDB SQL on the small tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "checks"))

import __spark_entry__ as E  # noqa: E402
from compare import digest  # noqa: E402
from parlance.sources.catalog import BASE_TABLES  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

FAST = [
    "corpus_faq", "corpus_intent", "corpus_emo", "top_words", "cloud_words", "synonym_replace",
    "stopword_exclude", "length_band", "dedup_first", "balance_topup", "label_encode", "encode_pad",
    "threshold_resolve", "train_intent", "predict_proba", "rank_faq", "answer_v1", "feature_refresh",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[name])
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(list(res.columns), orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 48 and "Bot" in df.columns and df.where("Answer IS NULL").count() < 48
