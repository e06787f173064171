"""Class sizes and hash-ordered sampling (#32, #33, #42-#44).

Row choice is defined by an md5 of the row's unique key and a seed text, so
that it is stable under any partitioning and reproducible by SQL.
``first_k_per_group`` cuts each group at its k-th row without sorting a
whole group in one task: a histogram of hash prefixes finds the bucket
where the cut falls, and only that bucket is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed seeds (text appended to the key before hashing).
CAP_SEED = "|42"
TOPUP_SEED = "|43"
SPLIT_SEED = "|42"
# A split key whose 4-hex-digit md5 prefix sorts below this is in train:
# 0xcccd / 0x10000 = 0.8.
TRAIN_BELOW = "cccd"
# Hex digits of the hash prefix used as histogram bucket (16**3 buckets).
BUCKET_DIGITS = 3


def hash_key(key: str | Column, seed: str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(seed)))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class (#32)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def second_size(sizes: DataFrame) -> Column:
    """Second entry of the class sizes sorted descending; ties count separately (#33).

    Each task keeps its own two largest sizes before the single-partition
    step (partial window group limit), so the step sees a bounded input.
    Null when there are fewer than two classes.
    """
    w = Window.orderBy(F.col("n").desc())
    return (
        sizes.select("n", F.row_number().over(w).alias("_r"))
        .filter(F.col("_r") <= 2)
        .select(F.max(F.when(F.col("_r") == 2, F.col("n"))))
        .scalar()
    )


def first_k_per_group(df: DataFrame, group: str, order_hex: str, k: str) -> DataFrame:
    """Rows whose rank inside ``group`` by ``order_hex`` (fixed-width hex) is <= ``k``.

    ``k`` is a column of ``df`` (constant within a group). Exact, and the
    largest sort any task does is one histogram bucket of one group.
    """
    b = F.substring(F.col(order_hex), 1, BUCKET_DIGITS)
    keyed = df.withColumn("_b", b)
    hist = keyed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"), F.first(k).alias("_k"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_incl", F.sum("_n").over(w)).withColumn("_before", F.col("_incl") - F.col("_n"))
    hist = hist.filter(F.col("_before") < F.col("_k")).select(
        group, "_b", "_before", (F.col("_incl") <= F.col("_k")).alias("_whole")
    )
    # hist is one row per (group, bucket); AQE broadcasts it from its measured size.
    tagged = keyed.join(hist, [group, "_b"])
    whole = tagged.filter("_whole")
    cut = tagged.filter(~F.col("_whole"))
    wr = Window.partitionBy(group, "_b").orderBy(order_hex)
    cut = cut.withColumn("_r", F.row_number().over(wr)).filter(F.col("_before") + F.col("_r") <= F.col(k)).drop("_r")
    return whole.unionByName(cut).drop("_b", "_before", "_whole")


def balance_cap(df: DataFrame, label: str, key: str = "ord", s: Column | None = None) -> DataFrame:
    """Keep ``min(s, n)`` rows per class, s = second-largest class size (#42)."""
    if s is None:
        s = second_size(class_sizes(df, label))
    keyed = df.withColumn("_h", hash_key(key, CAP_SEED)).withColumn("_k", s)
    return first_k_per_group(keyed, label, "_h", "_k").drop("_h", "_k")


def balance_topup(capped: DataFrame, label: str, key: str = "ord", s: Column | None = None) -> DataFrame:
    """Append ``min(s - n, n)`` more rows to each class smaller than s (#43).

    Final class size is ``min(s, 2n)``. The appended rows are copies.
    """
    sizes = class_sizes(capped, label)
    if s is None:
        s = second_size(sizes)
    lack = sizes.select(label, (s - F.col("n")).alias("_k")).filter(F.col("_k") > 0)
    extra = capped.join(lack, label).withColumn("_h", hash_key(key, TOPUP_SEED))
    extra = first_k_per_group(extra, label, "_h", "_k").drop("_h", "_k")
    return capped.unionByName(extra)


def balance(df: DataFrame, label: str, key: str = "ord") -> DataFrame:
    """Cap then top-up with the same s, computed once on the uncapped sizes."""
    from parlance.operators.util import materialize

    s = F.coalesce(second_size(class_sizes(df, label)), F.raise_error(F.lit("balancing needs at least two classes")))
    capped = materialize(balance_cap(df, label, key, s))
    return balance_topup(capped, label, key, s)


def holdout_split(df: DataFrame, key: str = "ord", seed: str = SPLIT_SEED) -> DataFrame:
    """Add ``split`` = 'train' (about 80%) or 'test' from the key's hash (#44)."""
    return df.withColumn(
        "split",
        F.when(F.substring(hash_key(key, seed), 1, 4) < TRAIN_BELOW, F.lit("train")).otherwise(F.lit("test")),
    )
