"""The feature cache kept up to date by a stream of row changes (#2, #3, #39).

The cache is dealt into a fixed number of buckets by hash of ``ord``. Each
micro-batch is one change set: it reads and rewrites only the buckets that it
touches, computes features only for rows whose text or emotion is new, and
then publishes a manifest (bucket -> folder). The manifest's own ``_SUCCESS``
marker is the pointer: readers see the cache before a batch or after it,
never between.

    base/data/batch=<K>/bucket=<b>/...    buckets rewritten by batch K
    base/manifest/v<K+1>                  (bucket, batch, n, width) after batch K

A repeated batch starts from the manifest before it, so it gives the same
cache. One base belongs to one model (``features.cache_base``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import features as ft
from parlance.operators.util import materialize

BUCKETS = 64  # of a cache; fixed when its first batch is written
MANIFEST = "bucket int, batch long, n long, width int"


def bucket_of(ord_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ord_), F.lit(buckets)).cast("int")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of every row: highest ``seq``; of equal ones a delete,
    then the greatest text. Combined map-side, so a hot row is no hot task."""
    best = F.max(F.struct("seq", (F.col("op") == "delete").alias("gone"), "Question", "EmotionName")).alias("c")
    return changes.where("ord IS NOT NULL").groupBy("ord").agg(best).select("ord", "c.Question", "c.EmotionName", F.coalesce("c.gone", F.lit(False)).alias("gone"))


def manifest(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The newest manifest, or the newest that is older than batch ``before``."""
    found = [v for v in ft.versions(spark, f"{base}/manifest") if before is None or v <= before]
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/v{found[-1]:06d}") if found else None


def _folders(base: str, entries: list) -> list[str]:
    return [f"{base}/data/batch={e.batch}/bucket={e.bucket}" for e in entries if e.n]


def read(spark: SparkSession, base: str) -> DataFrame | None:
    """The current feature table, or None before the first batch and when every row is gone."""
    m = manifest(spark, base)
    paths = _folders(base, m.orderBy("bucket").collect()) if m is not None else []  # a row per bucket
    return spark.read.parquet(*paths) if paths else None


def apply_batch(changes: DataFrame, base: str, batch_id: int, compute: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge one change set (ord, seq, op, Question, EmotionName) into the cache.

    ``op`` is ``delete``, or anything else for insert-or-replace. ``compute``
    maps rows (ord, Question, EmotionName) to feature rows (ord, Question,
    EmotionName, label_emo, f); a row that it leaves out (an emotion that the
    head does not know) is not in the cache. Rows that come again unchanged
    keep their features. Changes without ``ord`` are ignored; a delete of an
    unknown row does nothing; an empty batch publishes the cache as it was.
    """
    spark = changes.sparkSession
    old = manifest(spark, base, before=batch_id)
    entries = old.collect() if old is not None else []  # a row per bucket
    if entries:
        buckets = len(entries)
    change = materialize(latest(changes).withColumn("bucket", bucket_of(F.col("ord"), buckets)))
    touched = {r.bucket for r in change.select("bucket").distinct().collect()}  # at most ``buckets``
    current = {e.bucket: e for e in entries}
    paths = _folders(base, [current[b] for b in sorted(touched) if b in current])
    put = change.where(~F.col("gone"))
    if paths:
        cached = spark.read.parquet(*paths)
        # unchanged rows and rows without a change stay as they are
        at = cached.join(change.select("ord", F.col("Question").alias("_q"), F.col("EmotionName").alias("_e"), "gone"), "ord", "left")
        same = F.col("Question").eqNullSafe(F.col("_q")) & F.col("EmotionName").eqNullSafe(F.col("_e"))
        kept = at.where(F.col("gone").isNull() | (~F.col("gone") & same)).select(*cached.columns)
        put = put.join(kept.select("ord"), "ord", "left_anti")
    new = compute(put.select("ord", "Question", "EmotionName"))
    rows = new.select("ord", "Question", "EmotionName", "label_emo", "f")
    if paths:
        rows = rows.unionByName(kept)
    folder = f"{base}/data/batch={int(batch_id)}"
    rows = rows.withColumn("bucket", bucket_of(F.col("ord"), buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    done = spark.read.schema(f"{rows.drop('bucket')._jdf.schema().toDDL()}, bucket int").parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("f")).alias("width"))
    made = {r.bucket: r for r in done.collect()}  # a row per touched bucket
    out = []
    for b in range(buckets):
        if b in touched:
            out.append((b, int(batch_id), made[b].n if b in made else 0, made[b].width if b in made else 0))
        else:
            out.append(tuple(current[b]) if b in current else (b, int(batch_id), 0, 0))
    spark.createDataFrame(out, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/v{int(batch_id) + 1:06d}")


def refresh_stream(changes: DataFrame, base: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = BUCKETS):
    """Apply every change set that arrives until the source is drained. Returns the finished query."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, base, batch_id, compute, buckets)

    q = changes.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def prune(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete manifests older than the ``keep`` newest, and the bucket folders
    that no remaining manifest names. Two stay at least: the newest batch may
    be repeated, and starts from the one before."""
    found = ft.versions(spark, f"{base}/manifest")
    stay = found[-max(keep, 2):]
    if len(stay) == len(found):
        return []
    named = {p for v in stay for p in _folders(base, spark.read.schema(MANIFEST).parquet(f"{base}/manifest/v{v:06d}").collect())}
    fs, root, jvm = ft._fs(spark, f"{base}/data")
    gone = []
    for v in found[: -len(stay)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/manifest/v{v:06d}"), True)
    for batch in fs.listStatus(root):
        k = batch.getPath().getName()
        # a batch beyond the newest manifest is being written
        if not k.startswith("batch=") or int(k[6:]) >= stay[-1]:
            continue
        for st in fs.listStatus(batch.getPath()):
            name = st.getPath().getName()
            path = f"{base}/data/{k}/{name}"
            if name.startswith("bucket=") and path not in named:
                fs.delete(st.getPath(), True)
                gone.append(path)
    return gone
