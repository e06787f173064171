"""Corpus builds (#51-#54): scan -> clean -> filter -> dedup -> balance.

Band arguments are the ones the reference's endpoints pass: (2, .8) for the
FAQ and intent corpora, (4, .8) for the emotion corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import filters as flt
from parlance.operators import sampling as smp
from parlance.operators.util import materialize
from parlance.sources.catalog import Catalog

FAQ_BAND = (2, 0.8)
DEFAULT_KINDS = {"faq_kind": "nb", "intent_kind": "nb", "emo_kind": "logreg"}
INTENT_BAND = (2, 0.8)
EMO_BAND = (4, 0.8)


def _banded(df: DataFrame, col: str, band) -> DataFrame:
    """Length band, no empty texts, keep-first dedup. The cleaned rows are
    written once: the quantile and the filter read their texts, instead of
    cleaning again for every place that names the text."""
    df = flt.length_band(materialize(df), col, *band)
    return materialize(flt.dedup_first(flt.drop_empty(df, col), col))


def corpus_faq(cat: Catalog, band=FAQ_BAND, segmenter=None) -> DataFrame:
    """scan, synonyms, stop words, length band, keep-first dedup (#52).

    ``segmenter`` (see ``operators.lattice``) cuts unspaced scripts into words
    before stop words are dropped.
    """
    df = cat.read("faq").select("ord", "Text", "FaqSettingId", "Demand", "Supply")
    df = tx.replace_synonyms(df, "Text", cat.read("syn"))
    df = tx.exclude_stopwords(df, "Text", cat.read("stop"), segmenter)
    return _banded(df, "Text", band)


def corpus_intent(cat: Catalog, band=INTENT_BAND, segmenter=None) -> DataFrame:
    """scan, drop Rank 2, stop words, length band, keep-first dedup; no synonyms (#53)."""
    df = cat.read("intent").select("ord", "Text", "Rank", "IntentionName", "FaqSettingId")
    df = flt.rank_filter(df)
    df = tx.exclude_stopwords(df, "Text", cat.read("stop"), segmenter)
    return _banded(df, "Text", band)


def emo_cleaned(cat: Catalog, band=EMO_BAND) -> DataFrame:
    """scan, drop null label, convert script, length band, drop empty, dedup."""
    df = cat.read("emo").select("ord", "Question", "EmotionName")
    df = flt.drop_null_label(df, "EmotionName")
    df = tx.script_convert(df, ["Question", "EmotionName"], cat.read("script_map"))
    return _banded(df, "Question", band)


def corpus_emo(cat: Catalog, band=EMO_BAND) -> DataFrame:
    """Emotion corpus: cleaned rows, then cap and top-up to min(s, 2n) per class (#51)."""
    return materialize(smp.balance(emo_cleaned(cat, band), "EmotionName"))


def option_values(cat: Catalog) -> DataFrame:
    """One row, one double column per option key; a missing key is an error (#30).

    The first ``Value`` of a key by ``ord`` wins; one that is no number is an
    error. Keys are the six the reference reads.
    """
    keys = ["SimilarityFAQBot", "SimilarityIntentionBot", "ChatBotKind", "4000Faq", "4000Intention", "4000Emo"]
    opt = cat.read("options")
    cols = []
    for k in keys:
        first = F.min(F.when(F.col("Key") == k, F.struct("ord", "Value")))["Value"]
        cols.append(first.alias(f"_{k}"))
        cols.append(F.count(F.when(F.col("Key") == k, 1)).alias(f"_n{k}"))
    row = opt.agg(*cols)
    return row.select(*[
        F.when(F.col(f"_n{k}") == 0, F.raise_error(F.lit(f"option {k} is missing")).cast("double"))
        .when(F.col(f"_{k}").try_cast("double").isNull(), F.raise_error(F.lit(f"option {k} is not a number")).cast("double"))
        .otherwise(F.col(f"_{k}").try_cast("double"))
        .alias(k)
        for k in keys
    ])


def model_choice(cat: Catalog) -> DataFrame:
    """Model kind per head from option ids; if any id has no name, all three
    fall back to the defaults (#31). Columns: faq_kind, intent_kind, emo_kind.
    """
    opts = option_values(cat)
    names = cat.read("bot_model")
    heads = [("faq_kind", "4000Faq"), ("intent_kind", "4000Intention"), ("emo_kind", "4000Emo")]
    # Fallback kinds. The reference falls back to its two pretrained kinds,
    # which are not built here; ours are the engine's own kinds.
    defaults = DEFAULT_KINDS
    # the first name of an id by ``ord``; one small join per head
    per_id = names.groupBy(F.col("Id").cast("double").alias("_id")).agg(F.min_by("Name", "ord").alias("_name"))
    o = opts
    for h, opt in heads:
        o = o.join(per_id.select(F.col("_id").alias(opt), F.col("_name").alias(h)), opt, "left")
    all_found = F.lit(True)
    for h, _ in heads:
        all_found = all_found & F.col(h).isNotNull()
    return o.select(*[F.when(all_found, F.col(h)).otherwise(F.lit(defaults[h])).alias(h) for h, _ in heads])
