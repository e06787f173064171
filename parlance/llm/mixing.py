"""Mixing sources to target weights by systematic sampling (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import global_index, quoted, without, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target of every source (``source``, ``source_size``): a share of the
    total by weight, cut at ``max_repeat`` times the source's size, the
    excess shared again by weight until no source is above its cut.

    Sources take the weights in turn, by code point, null last.
    The level (target per weight) is found by a few rounds of sums over the
    source table; only those sums reach the driver.
    """
    ordered = global_index(sizes, [F.col("source").asc_nulls_last()], "_i")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    t = written(ordered.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_repeat).cast("double")), "sources")
    total, w_all = t.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level = goal / w_all if w_all else 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        capped, rest = t.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (goal - (capped or 0.0)) / rest if rest else level
        if now == level or not rest:
            break
        level = now
    return t.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with ``size`` (words of its text), ``source_size``,
    ``target`` (of its source), ``copies`` and ``taken`` (copies x size).

    Within a source, the documents stand in an order of size strata. Each
    expects target / source_size copies; their prefix sum plus one offset per
    source is emitted once per integer it crosses, so a document gets the
    floor or the ceiling of its expectation and the source's taken words stay
    near the target. All choices come from hashes: reruns agree.

    The prefix sum is taken in two levels: counts per (source, stratum, id
    hash) are summed over the strata, and rows are ranked inside one cell
    only, so a source that holds most rows is never ranked in one task.

    Edge cases: null text has size 0; a source without words has target 0 and
    takes nothing; null source is a source of its own, last in order; null ids
    count as the empty id; repeated rows count as documents each; an empty
    table gives an empty result. Columns that clash with result names give
    way to the results.
    """
    result = ["size", "source_size", "target", "copies", "taken"]
    keep = without(docs, result)
    n = size if size is not None else word_count(quoted(text_col))
    key = F.coalesce(F.concat(F.lit("="), quoted(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[quoted(c) for c in keep]).alias("_row"), n.alias("_size"), key.alias("_source"), F.md5(F.coalesce(quoted(id_col).cast("string"), F.lit(""))).alias("_hash"))
    bits = F.bin("_size")
    stratum = F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 3), 3, "0"))
    rows = rows.withColumn("_cell", F.concat(stratum, F.substring("_hash", 1, 2)))

    cells = written(rows.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")), "cells")
    by_source = cells.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    name = F.when(F.col("_source") == "", F.lit(None).cast("string")).otherwise(F.substring("_source", 2, 1 << 30))
    targets = source_targets(by_source.select(name.alias("source"), "source_size"), weights, share, max_repeat)
    back = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_source"))), 1, 13), 16, 10).cast("double") / float(16**13)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_source", back).select("_source", "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_cell")) - F.col("_n")
    cells = written(cells.select("_source", "_cell", before.alias("_before")).join(targets, "_source"), "cells")

    rank = F.row_number().over(Window.partitionBy("_source", "_cell").orderBy("_size", "_hash", F.xxhash64("_row")))
    k = (F.col("_before") + F.col("_rank")).cast("double")
    edge = lambda x: F.floor(F.col("_rate") * x + F.col("_offset"))
    out = rows.withColumn("_rank", rank).join(cells, ["_source", "_cell"]).withColumn("_copies", (edge(k) - edge(k - 1)).cast("long"))
    return out.select("_row.*", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))
