from conftest import SF_SMALL

import __spark_entry__ as E


def test_stream_equals_batch(spark):
    q = E.queries()
    s = sorted(tuple(r) for r in q["answer_stream"](spark, SF_SMALL).collect())
    b = q["answer_v1"](spark, SF_SMALL)
    b = sorted(tuple(r) for r in b.select(*q["answer_stream"](spark, SF_SMALL).columns).collect())
    assert s == b and len(s) > 0
