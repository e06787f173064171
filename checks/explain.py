"""Print the formatted physical plans of the key stages (plan review).

    python checks/explain.py [sf_dir] > plans.txt

Look for: PushedFilters / ReadSchema on scans, partial aggregates and
partial WindowGroupLimit before exchanges, BroadcastHashJoin only on
checked or AQE-measured small sides, no CartesianProduct /
BroadcastNestedLoopJoin.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from parlance.operators import bayes, filters as flt, sampling as smp, words as wd  # noqa: E402
from parlance.plans import answer as ans, corpus as cp  # noqa: E402
from parlance.session import local_session  # noqa: E402
from parlance.sources.catalog import Catalog, scan_role  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    cat = Catalog(spark, sf)
    intent = cat.read("intent")
    heads = ans.build_heads(cat)
    q = ans.prepare_questions(cat)
    stages = {
        "scan_role": scan_role(cat, "intent", ["ord", "IntentionName"], F.col("IntentionName") == "en"),
        "length_band + dedup": flt.dedup_first(flt.length_band(intent, "Text", 2, 0.8), "Text"),
        "balance (cap + top-up)": smp.balance(cp.emo_cleaned(cat), "EmotionName"),
        "top_words": wd.top_words(cp.corpus_emo(cat), "Question", cat.read("stop"), [2, 3, 4]),
        "nb score_topk (faq)": bayes.score_topk(heads.faq, q, "text", 4),
        "nb score_vector (intent)": bayes.score_vector(heads.intent, q, "text"),
    }
    for name, df in stages.items():
        print("=" * 20, name)
        df.explain("formatted")


if __name__ == "__main__":
    main()
