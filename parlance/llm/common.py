"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Text handled by one round of array work in a task.
CHUNK_BYTES = 2 << 20

U64 = np.uint64


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder of this
    machine only where the setting is unset and Spark runs in one process."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="parlance-shared-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back:
    cuts lineage, survives lost executors, and is evaluated once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let go of finished steps: once the driver has collected their plans,
    Spark removes their shuffle files from the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that tasks
    can import it wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_parlance_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(d, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-py-"), "parlance_pkg.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    sc.addPyFile(path)
    sc._parlance_shipped = True


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash (in any case) with ``names``."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def keys_within(df: DataFrame, keys: DataFrame, col: str, how: str = "left_semi", max_rows: int = 500_000) -> DataFrame:
    """Semi or anti join on one long column. ``keys`` is broadcast only after
    its rows were counted to be at most ``max_rows`` (8 bytes each); larger
    key sets take a shuffle join."""
    k = keys.select(col).distinct()
    if k.limit(max_rows + 1).count() <= max_rows:
        k = F.broadcast(k)
    return df.join(k, col, how)


def small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``df`` (a written table of a few numbers a row), hinted for broadcast
    only if its rows were counted to be at most ``max_rows``."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def crc_mod5(id_col: str) -> Column:
    return F.crc32(quoted(id_col).cast("string")) % 5


# ---------------------------------------------------------------- arrays of text


def text_chunks(batches: Iterator[pa.RecordBatch], col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of bounded slices of the batches: at most
    ``limit`` bytes of text, or one longer document. Null text is empty."""
    for b in batches:
        if not b.num_rows:
            continue
        arr = b.column(b.schema.get_field_index(col))
        if arr.null_count:
            arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
        large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        offs = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < len(arr):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            yield b.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_BYTE = _stream(17, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD1342543DE82EF95
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""
    if len(_powers["p"]) < n:
        size = max(n, 2 * len(_powers["p"]), 1 << 16)
        for k, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            full = np.full(size, U64(base))
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers["p"], _powers["q"]


class RangeHash:
    """64-bit hash of any byte range in constant time, from one running sum."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        p, self._inv = powers(n + 1)
        self._sum = np.empty(n + 1, np.uint64)
        self._sum[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:n], out=self._sum[1:])

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sum[end] - self._sum[start]) * self._inv[start] + (end - start).astype(np.uint64))


class Words(RangeHash):
    """Words (runs of bytes other than the six ASCII white-space bytes) of
    many documents. ``start`` and ``end`` are the words' byte ranges;
    ``first`` (length: documents + 1) says which words belong to a document.
    A-Z hash as a-z unless ``lower`` is off.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True):
        super().__init__(data, lower)
        n = len(data)
        word = ~_SPACE[data]
        flag = np.zeros(n + 1, bool)
        flag[offs] = True  # documents begin here
        begin, stop = word.copy(), word.copy()
        if n:
            begin[1:] &= ~word[:-1] | flag[1:n]
            stop[:-1] &= ~word[1:] | flag[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offs)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its n-word shingles; with
    fewer words, of the whole sequence as one; without words, nothing."""
    if len(h) >= n:
        roll = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            roll = roll + h[j : len(h) - n + 1 + j] * U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        roll = mix64(roll + U64(n))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(roll[a : b - n + 1]))
        elif b > a:
            v = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                v = mix64(v * U64(3) + h[j : j + 1])
            out.append(v)
        else:
            out.append(np.empty(0, np.uint64))
    return out


# ---------------------------------------------------------------- ranks and components


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, ... in ``order`` without one task for all rows:
    range partitions are written once, ranked inside, and shifted by the
    number of rows before them."""
    p = written(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "index")
    sizes = p.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition, so their number bounds this table
    before = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    rn = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return p.withColumn("_rn", rn).join(F.broadcast(before), "_pid").withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_pid", "_rn", "_before")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) as links of every vertex to the smallest one that it
    reaches through these edges."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    label = np.arange(len(v))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(v))
    return v[own], v[label[own]]


def components(edges: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """(v, component) for the vertices of ``edges`` (a, b: longs): the
    smallest vertex reachable. Batches of edges are contracted first. If what
    is left was counted to be at most ``max_rows`` (16 bytes each), one more
    contraction ends the work, without rounds of many small shuffles; else
    alternate large and small stars, every round written to the shared folder.
    Only counts reach the driver.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, low = _roots(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(low)], names=["a", "b"])

    def contract_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from contract([pa.Table.from_batches(held)])

    ship(edges.sparkSession)
    distinct = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(distinct.mapInArrow(contract, "a long, b long"), "edges")
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(e)
    done = seen[0] <= max_rows
    if done and seen[0]:
        e = written(e.coalesce(1).mapInArrow(contract_rest, "a long, b long"), "edges")
    while not done:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        e = written(small_, "edges")
        now = state(e)
        done = now == seen
        seen = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("component")).union(e.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
