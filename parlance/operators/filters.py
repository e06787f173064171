"""Filters, quantile band and keep-first de-duplication (#16-#20, #36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_quantile(df: DataFrame, col: str, q: float) -> Column:
    """Exact linear-interpolated quantile of text lengths, as a scalar subquery (#36).

    ``percentile`` aggregates partially (a value->count map per task), and
    lengths have few distinct values, so the buffer stays small.
    """
    return df.select(F.percentile(F.length(col), F.lit(q)).alias("q")).scalar()


def length_band(df: DataFrame, col: str, lo: int, q: float) -> DataFrame:
    """Keep ``lo <= length(col) <= quantile(length, q)``, both ends inclusive (#16).

    A null text has a null length and drops out.
    """
    hi = length_quantile(df, col, q)
    return df.filter(F.length(col).between(F.lit(lo), hi))


def rank_filter(df: DataFrame, rank_col: str = "Rank", drop_value: int = 2) -> DataFrame:
    """Drop ``Rank == 2`` and keep null ranks (#17)."""
    return df.filter(~F.col(rank_col).eqNullSafe(drop_value))


def drop_null_label(df: DataFrame, col: str) -> DataFrame:
    """(#18)"""
    return df.na.drop(subset=[col])


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text equals '' (#19); nulls compare unknown and drop as well."""
    return df.filter(F.col(col) != "")


def dedup_first(df: DataFrame, col: str, order: str = "ord") -> DataFrame:
    """Keep the first row (smallest ``order``) of each distinct ``col`` (#20).

    ``min_by`` per text aggregates map-side, so a text that holds a large
    share of the rows is reduced in each task before the shuffle.
    """
    others = [c for c in df.columns if c != col]
    first = df.groupBy(col).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) if c != col else F.col(col) for c in df.columns])
