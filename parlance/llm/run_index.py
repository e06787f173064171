"""Long repeated byte strings by a run-length Burrows-Wheeler index.

Every window of ``width`` bytes belongs to the gram in it that is smallest by
hash (the last such). Runs of windows with one gram form a segment, so every
window of the corpus lies in exactly one segment, and equal windows lie in
segments of equal grams. Segments that are equal as a whole are counted;
segments that share a gram and differ go, one copy each, to a run-length
index, whose matching statistics say which of their windows occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.llm.common import U64, RangeHash, keys_within, quoted, ship, text_chunks, without, written

WIDTH = 400
GRAM = 32
SLAB = 4 << 20  # window starts handled at a time
INDEX_BYTES = 1 << 20  # text of one index
MANY = 1024  # different segments of one gram that go to one index


# ---------------------------------------------------------------- the index


class RunIndex:
    """Run-length BWT of a few byte strings, with suffix positions sampled at
    both ends of every run."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """``data``: the strings one after the other, which end at ``ends``."""
        n = len(data)
        begins = np.concatenate([[0], ends[:-1]])
        self.stop = np.repeat(ends, ends - begins)  # where the string of each position ends
        self.n, longest = n, int((ends - begins).max(initial=0))
        # seven symbols of nine bits; 0 past the end of a string
        sym = data.astype(np.int64) + 1
        at = np.arange(n)
        key = np.zeros(n, np.int64)
        for k in range(7):
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = sym[k:]
            nxt[at + k >= self.stop] = 0
            key = (key << 9) | nxt
        self.key = key
        rank, h = _ranks(key >> 27), 4
        while h < longest and rank.max(initial=0) < n - 1:
            far = np.zeros(n, np.int64)
            inside = at + h < self.stop
            far[inside] = rank[at[inside] + h] + 1
            new = _ranks(rank * (n + 1) + far)
            if new.max() == rank.max():
                break
            rank, h = new, 2 * h
        sa = _order(rank)
        before = data[sa - 1].astype(np.int64)
        place = np.empty(n, np.int64)
        place[sa] = at
        before[place[begins[begins < ends]]] = -1
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:] - 1, n - 1) if n else heads
        # runs of the BWT, and the sampled neighbours at their ends
        self.run_symbol, self.run_length = before[heads], np.diff(np.append(heads, n))
        self.head, self.above = sa[heads], np.where(heads > 0, sa[np.maximum(heads, 1) - 1], -1)
        self.tail, self.below = sa[tails], np.where(tails < n - 1, sa[np.minimum(tails + 1, max(n - 1, 0))], -1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        out = np.zeros(len(a), np.int64)
        room = np.where((a < 0) | (b < 0), 0, np.minimum(self.stop[a] - a, self.stop[b] - b))
        live = np.flatnonzero(room > 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            diff = self.key[x] ^ self.key[y]
            same = np.full(len(live), 7)
            for k in range(6, -1, -1):
                same[(diff >> (9 * (6 - k))) & 511 != 0] = k
            out[live] = np.minimum(out[live] + same, room[live])
            live = live[(same == 7) & (out[live] < room[live])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match of its suffix with any other
        position. Streams over the text: against the suffix above and the one
        below in suffix order, the match shrinks by one a position until the
        next sampled run end, so only sampled positions are compared."""
        best = np.zeros(self.n, np.int64)
        for at, other in ((self.head, self.above), (self.tail, self.below)):
            reach = np.full(self.n, -1, np.int64)
            reach[at] = at + self._common(at, other)
            seen = np.maximum.accumulate(np.where(reach >= 0, np.arange(self.n), 0))
            best = np.maximum(best, reach[seen] - np.arange(self.n))
        return best


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative keys; packed with their positions into
    one number where that fits, which sorts several times faster."""
    bits = max(int(len(key) - 1).bit_length(), 1)
    if int(key.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _ranks(key: np.ndarray) -> np.ndarray:
    order = _order(key)
    sorted_ = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]])) if len(key) else 0
    return out


def _spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the runs of True."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# ---------------------------------------------------------------- segments


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    size, done = 1, x
    while 2 * size <= w:
        done = np.minimum(done[: len(done) - size], done[size:])
        size *= 2
    if size < w:
        done = np.minimum(done[: len(done) - (w - size)], done[w - size :])
    return done


def segments(data: np.ndarray, offs: np.ndarray, width: int, gram: int):
    """(document, start, windows, gram hash, content hash) of all segments."""
    out = []
    hashes = RangeHash(data)
    w = width - gram + 1
    doc_end = np.repeat(offs[1:], np.diff(offs))
    low24 = U64((1 << 24) - 1)
    for lo in range(0, max(len(data) - width + 1, 0), SLAB):
        hi = min(lo + SLAB, len(data) - width + 1)  # window starts [lo, hi)
        g = np.arange(lo, hi + w - 1)
        value = hashes.range_hash(g, g + gram)
        key = (value & ~low24) | (~(g - lo).astype(np.uint64) & low24)
        best = _slide_min(key, w)
        anchor = (~best & low24).astype(np.int64)
        start = np.arange(lo, hi)
        ok = start + width <= doc_end[lo:hi]
        if not ok.any():
            continue
        start, anchor = start[ok], anchor[ok]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(start)))
        begin = start[first]
        out.append((np.searchsorted(offs, begin, "right") - 1, begin, n, value[anchor[first]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc, begin, n, h = (np.concatenate(c) for c in zip(*out))
    raw = memoryview(data)
    content = np.fromiter((int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(begin.tolist(), (begin + n + width - 1).tolist())), np.int64, len(begin))
    return doc, begin - offs[doc], n, h.view(np.int64), content


def _segment_table(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """Per document, arrays of its segments; ``row`` numbers the written rows."""
    schema = rows.select("id").schema
    for f in StructType.fromDDL("th long, h array<long>, g array<long>, start array<int>, n array<int>"):
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches):
            doc, start, n, h, g = segments(data, offs, width, gram)
            cut = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
            cells = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (h, g, start.astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cells], names=["id", "th", "h", "g", "start", "n"])

    out = rows.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)
    return written(out.withColumn("row", F.monotonically_increasing_id()), "segments")


# ---------------------------------------------------------------- marking


def _contents(rows: DataFrame, table: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Bytes of wanted segments (row, start, n, h, g), read from the texts."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "n", "h", "g")).alias("s"))
    at = written(table.select("row", "id", "th").join(lists, "row").select(F.col("id").alias("own"), F.col("th").alias("own_th"), "s"), "wanted")
    texts = keys_within(rows.withColumn("th", F.xxhash64("text")), at.select(F.col("own_th").alias("th")), "th")
    both = texts.join(at, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own"))).select("text", "s")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches):
            h, g, n, body = [], [], [], []
            for lo, s in zip(offs[:-1].tolist(), part.column(1).to_pylist()):
                for x in s:
                    h.append(x["h"])
                    g.append(x["g"])
                    n.append(x["n"])
                    body.append(data[lo + x["start"] : lo + x["start"] + x["n"] + width - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], names=["h", "g", "n", "body"])

    return both.mapInArrow(cut, "h long, g long, n int, body binary")


def _indexed(contents: DataFrame, width: int) -> DataFrame:
    """(h, g, lo, hi): windows of each segment that occur elsewhere among the
    segments of its gram. Grams are dealt to partitions; a partition fills
    one index after the other, each with whole grams and bounded in bytes."""

    def marks(held: list) -> pa.RecordBatch:
        ends = np.cumsum([len(x[2]) for x in held])
        best = RunIndex(np.frombuffer(b"".join(x[2] for x in held), np.uint8), ends).matching_statistics() >= width
        h, g, lo, hi = [], [], [], []
        for (a, b, body), end in zip(held, ends.tolist()):
            first, last = _spans(best[end - len(body) : end])
            if len(first):
                h.append(a)
                g.append(b)
                lo.append(first)
                hi.append(last)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32()))], names=["h", "g", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for h, g, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (h, g) == last:  # equal documents give a segment more than once
                    continue
                if size > INDEX_BYTES and h != last[0]:
                    yield marks(held)
                    held, size = [], 0
                held.append((h, g, body))
                size += len(body)
                last = h, g
        if held:
            yield marks(held)

    ordered = contents.select("h", "g", "body").repartition("h").sortWithinPartitions("h", "g")
    return ordered.mapInArrow(run, "h long, g long, lo array<int>, hi array<int>")


def _counted(contents: DataFrame, width: int) -> DataFrame:
    """The same for grams with more different segments than one index should
    hold: their windows are counted by hash, combined before the shuffle, so
    no task holds a gram."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, g, n, body in zip(*[b.column(i).to_pylist() for i in range(4)]):
                at = np.arange(n)
                key = RangeHash(np.frombuffer(body, np.uint8)).range_hash(at, at + width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, g)), pa.array(at.astype(np.int32)), pa.array(key)], names=["h", "g", "at", "w"])

    each = written(contents.dropDuplicates(["h", "g"]).select("h", "g", "n", "body").mapInArrow(windows, "h long, g long, at int, w long"), "windows")
    often = each.groupBy("h", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "w")
    hit = each.join(often, ["h", "w"]).groupBy("h", "g").agg(F.sort_array(F.collect_list("at")).alias("lo"))
    return hit.select("h", "g", "lo", F.col("lo").alias("hi"))


def repeated(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(id, th, lo, hi): window starts lo..hi, in arrays, that occur elsewhere,
    for documents (id, xxhash64 of the text) that have any."""
    ship(rows.sparkSession)
    table = _segment_table(rows, width, gram)
    each = table.select("row", F.explode(F.arrays_zip("h", "g", "start", "n")).alias("s")).select("row", F.col("s.h").alias("h"), F.col("s.g").alias("g"), F.col("s.start").alias("start"), F.col("s.n").alias("n"))
    kinds = each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start", "n")).alias("at"))
    kinds = written(kinds, "kinds")
    by_gram = kinds.groupBy("h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    live = written(kinds.join(by_gram.select("h", "kinds"), "h"), "live")
    mixed = live.where("kinds > 1").select("h", "g", "c", "kinds", "at.*")
    body = written(_contents(rows, table, mixed, width).join(by_gram.select("h", "kinds"), "h"), "contents")
    found = _indexed(body.where(F.col("kinds") <= MANY), width).union(_counted(body.where(F.col("kinds") > MANY), width))
    single = live.where("c = 1").select("h", "g", "at.row", "at.start")
    part = single.join(found, ["h", "g"]).select("row", F.transform("lo", lambda x: x + F.col("start")).alias("lo"), F.transform("hi", lambda x: x + F.col("start")).alias("hi"))
    whole = each.join(live.where("c > 1").select("h", "g"), ["h", "g"]).select("row", F.array("start").alias("lo"), F.array(F.col("start") + F.col("n") - 1).alias("hi"))
    marks = part.union(whole).groupBy("row").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    # equal documents have equal marks
    return written(marks.join(table.select("row", "id", "th"), "row").groupBy("id", "th").agg(F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi")), "marks")


def covered(size: int, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Bytes covered by the windows that start in lo..hi."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + width, -1)
    return np.cumsum(step[:-1]) > 0


def _with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (id, text, ...) with their marks, if any. Only texts that have
    marks are shuffled, as long as their keys are few enough to broadcast."""
    texts = rows.withColumn("th", F.xxhash64("text"))
    m = marks.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "lo", "hi")
    have = keys_within(texts, marks, "th").join(m, (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id", "_th")
    empty = F.lit(None).cast("array<int>")
    return have.unionByName(keys_within(texts, marks, "th", "left_anti").withColumn("lo", empty).withColumn("hi", empty)).drop("th")


def _mask(size: int, lo, hi, width: int) -> np.ndarray:
    if lo is None:
        return np.zeros(size, bool)
    return covered(size, np.asarray(lo, np.int64), np.asarray(hi, np.int64), width)


def removals(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept_sha256`` (of the remaining bytes), where every byte that
    a ``width``-byte string covers is removed if the string also starts
    anywhere else, in this or another document.

    Null and empty texts, and texts shorter than ``width``, keep all bytes;
    repeated rows are documents each, so from ``width`` bytes on they remove
    each other; a null id is an id; other columns are left out; an empty table
    gives an empty result.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    marked = _with_marks(rows, repeated(rows, width))
    schema = rows.select(quoted("id").alias(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit("").alias("kept_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches):
            gone, spans, sha = [], [], []
            for a, b, lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                mask = _mask(b - a, lo, hi, width)
                gone.append(int(mask.sum()))
                spans.append(len(_spans(mask)[0]) if lo is not None else 0)
                sha.append(hashlib.sha256(data[a:b][~mask].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=schema.names)

    return marked.select("id", "text", "lo", "hi").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, with the repeated passages cut out of the texts
    (characters cut in part go as a whole). Null texts stay null."""
    keep = without(docs, [text_col])
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), F.struct(quoted(text_col).isNull().alias("_null"), *[quoted(c) for c in keep]).alias("_row"))
    marked = _with_marks(rows, repeated(rows.select("id", "text"), width)).select("_row", "text", "lo", "hi")
    schema = marked.select("_row", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches):
            texts = [data[a:b][~_mask(b - a, lo, hi, width)].tobytes().decode("utf-8", "ignore") for a, b, lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["_row", "text"])

    out = marked.mapInArrow(run, schema)
    cols = [F.when(~F.col("_row._null"), F.col("text")).alias(c) if c not in keep else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols)
