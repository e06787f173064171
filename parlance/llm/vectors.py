"""Classes of equal vectors, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import quoted


def usable(vec: Column) -> Column:
    """Not null, not zero, every component present and finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(~bad & (norm > 0), F.lit(False))


def keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, key): equal usable vectors have equal keys; others and rows
    without an id have none."""
    vec = quoted(vec_col)
    text = F.md5(F.concat_ws(",", F.transform(vec, lambda x: x.cast("string"))))
    return df.select(quoted(id_col).cast("long").alias("id"), vec.alias("vec"), F.when(quoted(id_col).isNotNull() & usable(vec), text).alias("key"))


def classes(rows: DataFrame, members: int) -> DataFrame:
    """One row per key: ``rep`` (smallest id), ``n`` (rows), ``vec`` and
    ``ids``, its ``members`` smallest ids. Rows of a hot key are combined
    before the shuffle; the list of ids is cut there, too."""
    own = rows.where("key IS NOT NULL")
    sizes = own.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"))
    if not members:
        return sizes
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = own.select("key", "id").withColumn("r", rank).where(F.col("r") <= members)
    return sizes.join(few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")), "key")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])
