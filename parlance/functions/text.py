"""Column-level text functions (#8-#15).

All of these are JVM expressions (regex, higher-order functions); no
per-row Python. Short dictionaries (synonym pairs, stop words, script
maps) are part of the projection, after a size check. Larger ones take a
path of their own (a trie, a join) that gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. ``SEGMENT`` keeps separators so that dropping segments and
# concatenating the rest loses nothing else; ``WORD`` yields word segments
# only; ``CHAR`` yields code points; ``TOKEN`` yields Han characters one by
# one and other letter or digit runs whole (the classifier's features).
SEGMENT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"
CHAR = r"(?s)."
TOKEN = r"\p{IsHan}|[^\p{IsHan}\P{L}]+|\p{N}+"
# ASCII punctuation, the set Python's ``string.punctuation`` holds.
PUNCT = r"[!-/:-@\[-`{-~]"

# Ordered pairs that become part of the projection itself; more go through a trie.
MAX_INLINE_PAIRS = 32
MAX_INLINE_CHARS = 4000
MAX_INLINE_STOPWORDS = 10000


def segment(text: Column | str) -> Column:
    """Lossless segmentation: letter/digit runs and separator runs."""
    return F.regexp_extract_all(_c(text), F.lit(SEGMENT), 0)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(WORD), 0)


def chars(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(CHAR), 0)


def tokens(text: Column | str) -> Column:
    """Classifier tokens, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), 0)


def strip_punct(text: Column | str) -> Column:
    """Remove ASCII punctuation (#13)."""
    return F.regexp_replace(_c(text), PUNCT, "")


# ---------------------------------------------------------------------------
# Synonyms (#8, #9, #10)
# ---------------------------------------------------------------------------
def synonym_canon(syn: DataFrame) -> DataFrame:
    """Attach ``first_word`` = first non-null Text (by ``ord``) of each SynonymId (#8, #23).

    The canonical table is one row per group, pre-aggregated before the join.
    """
    canon = (
        syn.filter(F.col("Text").isNotNull())
        .groupBy("SynonymId")
        .agg(F.min_by("Text", "ord").alias("first_word"))
    )
    return syn.join(canon, "SynonymId", "left")


def synonym_pairs(syn: DataFrame) -> DataFrame:
    """(ord, term, canon) in table order; null terms are not search terms."""
    return (
        synonym_canon(syn)
        .filter(F.col("Text").isNotNull() & F.col("first_word").isNotNull())
        .select("ord", F.col("Text").alias("term"), F.col("first_word").alias("canon"))
    )


def fold_replace(text: Column, pairs: Column) -> Column:
    """Apply ``replace(term, canon)`` for each pair in array order.

    Later pairs see the output of earlier ones, as a sequential loop does.
    """
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["term"], p["canon"]))


def few_pairs(pairs: DataFrame, order: list[Column]) -> list | None:
    """The pairs in order if they are few and short, else None. At most
    ``MAX_INLINE_PAIRS`` + 1 rows reach the driver."""
    keyed = pairs.where(F.col("term").isNotNull() & F.col("canon").isNotNull() & (F.col("term") != ""))
    rows = keyed.orderBy(*order).select("term", "canon").limit(MAX_INLINE_PAIRS + 1).collect()
    if len(rows) > MAX_INLINE_PAIRS or sum(len(r.term) + len(r.canon) for r in rows) > MAX_INLINE_CHARS:
        return None
    return [(r.term, r.canon) for r in rows]


def replace_ordered(df: DataFrame, cols: list[str], pairs: DataFrame, order: list[Column]) -> DataFrame:
    """``cols`` after an ordered replacement. A short dictionary is folded
    inside the row's projection; any other one goes through a trie that picks
    the pairs which can fire, with the same result."""
    from parlance.operators import replace as rp

    few = few_pairs(pairs, order)
    if few is None:
        return rp.replace_ordered(df, cols, pairs, order)
    for c in cols:
        out = F.col(c)
        for term, canon in few:
            out = F.replace(out, F.lit(term), F.lit(canon))
        df = df.withColumn(c, out)
    return df


def replace_synonyms(df: DataFrame, col: str, syn: DataFrame) -> DataFrame:
    """Ordered synonym replacement of ``col`` (#9)."""
    return replace_ordered(df, [col], synonym_pairs(syn), [F.col("ord")])


def replace_all_to_one(df: DataFrame, col: str, syn: DataFrame, target: str = "") -> DataFrame:
    """Every term, in table order, replaced by ``target`` (#10)."""
    pairs = syn.select("ord", F.col("Text").alias("term"), F.lit(target).alias("canon"))
    return replace_ordered(df, [col], pairs, [F.col("ord")])


# ---------------------------------------------------------------------------
# Stop words (#11)
# ---------------------------------------------------------------------------
def exclude_stopwords(df: DataFrame, col: str, stop: DataFrame, segmenter=None) -> DataFrame:
    """Drop segments equal to a stop word; concatenate the rest with no separator.

    ``segmenter`` (Column -> array<string> Column, e.g. a user's pandas UDF
    for unspaced scripts) replaces the default lossless segmentation.

    Each segment is looked up in a hash set of the stop words, inside the
    row's own projection, whatever the length of the list. A list too long
    to travel with the plan takes an anti join on (row, position, segment)
    with the same result; rows are told apart by a written number, never by
    a column of theirs.
    """
    seg = segmenter or segment
    words = sorted(r[0] for r in stop.filter(F.col("Text").isNotNull()).distinct().limit(MAX_INLINE_STOPWORDS + 1).collect())
    if not words:
        return df
    if len(words) <= MAX_INLINE_STOPWORDS:
        kept = F.filter(seg(F.col(col)), lambda s: ~s.isin(words))
        return df.withColumn(col, F.when(F.col(col).isNotNull(), F.array_join(kept, "")))
    from parlance.operators.util import materialize

    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    segs = rows.select("_row", F.posexplode(seg(F.col(col))).alias("_pos", "_seg"))
    kept = segs.join(stop.select(F.col("Text").alias("_seg")), "_seg", "left_anti")
    joined = kept.groupBy("_row").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_seg"))), lambda s: s["_seg"]), ""
        ).alias("_txt")
    )
    return (
        rows.join(joined, "_row", "left")
        .withColumn(col, F.when(F.col(col).isNotNull(), F.coalesce("_txt", F.lit(""))))
        .drop("_txt", "_row")
    )


# ---------------------------------------------------------------------------
# Script / dialect conversion (#14)
# ---------------------------------------------------------------------------
def script_convert(df: DataFrame, cols: list[str], mapping: DataFrame) -> DataFrame:
    """Table-driven conversion: longest source first, then table order.

    Phrase entries are applied before the single characters they contain,
    as a phrase-level converter does.
    """
    pairs = mapping.select("ord", F.col("src").alias("term"), F.col("dst").alias("canon"))
    return replace_ordered(df, cols, pairs, [-F.length("term"), F.col("ord")])


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def synonym_usage(df: DataFrame, col: str, syn: DataFrame) -> DataFrame:
    """(SynonymId, term, first_word, n_rows): rows of ``df`` containing each term (#8 report).

    One trie over all terms finds those of a row; counts are combined per
    batch and joined to the dictionary, which stays a table. The empty term
    occurs in every row that has a text.
    """
    from parlance.operators.replace import term_rows

    pairs = synonym_canon(syn).filter(F.col("Text").isNotNull() & F.col("first_word").isNotNull())
    terms = pairs.select("SynonymId", F.col("Text").alias("term"), "first_word")
    n = term_rows(df, col, terms)
    empty = df.where(F.col(col).isNotNull()).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 0").select(F.lit("").alias("term"), "n_rows")
    return terms.join(n.unionByName(empty), "term").select("SynonymId", "term", "first_word", "n_rows")
