"""Periodic runs of words by online dyadic square catching.

Words are appended in batches. Whenever the last word of a block of 2^k words
(starting at a multiple of 2^k) is there, the block becomes a catcher for the
periods whose squares must hold a whole such block: it waits for its own words
to come again at one of those distances. A catch is compared backwards and
forwards from the block; stretches that reach the newest word go on with the
next batch. Stretches of two periods or more are the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import U64, Words, mix64, quoted, ship, text_chunks, without

LEAST = 12
SLICE = 1 << 18  # words appended at once
_NONE = np.zeros((4, 0), np.int64)


class Catchers:
    """Runs in a stream of documents, of which the last may go on.

    ``append`` takes word hashes with the documents' bounds and gives the runs
    of the documents that it ended, as rows (document, start, end, period);
    ``finish`` those of the last. Documents are numbered as they come.
    Positions count from the document's first word.
    """

    def __init__(self, least: int = LEAST):
        self.least = max(2, least)
        self.docs = 0
        self._clear()

    def _clear(self) -> None:
        self.level = [np.zeros(0, np.uint64)]  # level k: hash of the 2^k words from each position
        self.seen: list[int] = []  # by level, positions of the last document that were compared
        self.caught = _NONE  # (document, start, end, period) in the last document

    def _periods(self, k: int) -> list[tuple[int, int]]:
        """Ranges of the periods caught at level k. A run of period p has
        words that come again p later over max(least, 2p) - p positions in a
        row, and 2^(k+1) - 1 such positions hold a whole block of 2^k."""
        low, high, half = (2 << k) - 1, (4 << k) - 2, -(-self.least // 2)
        both = [(max(1, self.least - high), min(self.least - low, half - 1)), (max(low, half), high)]
        return [(a, b) for a, b in both if a <= b]

    def _grow(self, words: np.ndarray, levels: int) -> None:
        n = len(self.level[0]) + len(words)
        self.level = self.level[:levels]
        self.level[0] = np.concatenate([self.level[0], words])
        for k in range(1, levels):
            size, low = 1 << k, self.level[k - 1]
            if k == len(self.level):
                self.level.append(np.zeros(0, np.uint64))
            done = len(self.level[k])  # all blocks before are there
            stop = max(done, n - size + 1)
            half = size >> 1
            new = mix64(low[done:stop] * U64(0x9E3779B97F4A7C15) + low[done + half : stop + half])
            self.level[k] = np.concatenate([self.level[k], new])

    def _same(self, x: np.ndarray, y: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from x and y on (step 1), or before them
        (step -1), within ``room`` words."""
        got = np.zeros(len(x), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            size, h = 1 << k, self.level[k]
            live = np.arange(len(x))
            while len(live):
                live = live[got[live] + size <= room[live]]
                back = size if step < 0 else 0
                a, b = x[live] + step * got[live] - back, y[live] + step * got[live] - back
                live = live[h[a] == h[b]]
                got[live] += size
                if k < len(self.level) - 1:
                    break  # of all but the longest, one block at most fits
        return got

    def append(self, words: np.ndarray, first: np.ndarray, goes_on: bool = False) -> np.ndarray:
        """``first`` has the offsets of the documents in ``words`` and ends
        with their number; with ``goes_on`` the first one belongs to the last
        document of the batch before."""
        ended = _NONE if goes_on else self.finish()
        first = np.asarray(first, np.int64)
        if len(first) < 2:
            return ended
        old = len(self.level[0])
        base = self.docs - (1 if goes_on and self.docs else 0)
        self.docs = base + len(first) - 1
        bounds = first + old
        bounds[0] = 0
        size = np.diff(bounds)
        begin, stop = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
        levels = 1
        while (2 << levels) - 1 <= max(int(size.max(initial=0)) // 2, self.least):
            levels += 1
        self._grow(words, levels)
        n = len(begin)
        # stretches that reached the newest word go on
        doc, s, e, p = self.caught
        on = np.flatnonzero(e == old)
        e = e.copy()
        e[on] += self._same(e[on] - p[on], e[on], bounds[1] - e[on], 1)
        found = [np.stack([doc, s, e, p])]
        seen = [0] * levels
        for k in range(levels):
            ranges = self._periods(k)
            if not ranges:
                continue
            h, block = self.level[k], 1 << k
            # a document is compared from the time when it can hold a run
            room = max(self.least, 2 * ranges[0][0])
            i = np.arange(self.seen[k] if goes_on and k < len(self.seen) else 0, n - block + 1)
            i = i[(i + block <= stop[i]) & (stop[i] - begin[i] >= room)]
            seen[k] = size[-1] - block + 1 if size[-1] >= room else 0
            hits = []
            for a, b in ranges:
                j = i[i - begin[i] >= a]
                own = h[j]
                l = j - begin[j] - a >> k << k  # the nearest block that is far enough back
                for _ in range((b - a + block) // block + 1):
                    ok = (l >= 0) & (j - begin[j] - l <= b)
                    j, l, own = j[ok], l[ok], own[ok]
                    hit = h[begin[j] + l] == own
                    hits.append((begin[j[hit]] + l[hit], j[hit] - begin[j[hit]] - l[hit]))
                    l = l - block
            at, p = (np.concatenate(x) for x in zip(*hits))
            if not len(at):
                continue
            order = np.lexsort((at, p))
            at, p = at[order], p[order]
            # neighbouring blocks with one period are one stretch
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + block) | (begin[at[1:]] != begin[at[:-1]])])
            lead = np.flatnonzero(new)
            tail = np.append(lead[1:], len(at)) - 1
            at, p, end = at[lead], p[lead], at[tail] + block
            s = at - self._same(at, at + p, at - begin[at], -1)
            e = end + p
            e = e + self._same(end, e, stop[at] - e, 1)
            d, b = np.searchsorted(bounds, at, "right") - 1, begin[at]
            keep = (e - s >= np.maximum(self.least, 2 * p)) | (e == n)
            found.append(np.stack([base + d, s - b, e - b, p])[:, keep])
        # one stretch can be caught again in a later batch; multiples of its
        # period go on and end where it does
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
        least = rows[3][new][np.cumsum(new) - 1]
        rows = rows[:, new | (rows[3] % np.maximum(least, 1) != 0)]
        last = rows[0] == self.docs - 1
        ended = np.concatenate([ended, self._runs(rows[:, ~last])], axis=1)
        self.caught, self.seen = rows[:, last], seen
        if bounds[-2]:
            self.level = [x[bounds[-2] :] for x in self.level]
        return ended

    def finish(self) -> np.ndarray:
        """Runs of the last document, which ends."""
        out = self._runs(self.caught)
        self._clear()
        return out

    def _runs(self, rows: np.ndarray) -> np.ndarray:
        """Stretches of two periods or more, with their smallest period: a
        multiple of it gives the same stretch again."""
        doc, s, e, p = rows
        ok = e - s >= np.maximum(self.least, 2 * p)
        doc, s, e, p = rows[:, ok]
        order = np.lexsort((p, e, s, doc))
        doc, s, e, p = doc[order], s[order], e[order], p[order]
        new = np.ones(len(s), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        doc, s, e, p = doc[new], s[new], e[new], p[new]
        order = np.lexsort((p, s, doc))
        return np.stack([doc, s, e, p])[:, order]


def find(words: np.ndarray, first: np.ndarray, least: int = LEAST, step: int = SLICE) -> np.ndarray:
    """(document, start, end, period) of all runs of the documents, appended
    ``step`` words at a time."""
    c, out, lo = Catchers(least), [], 0
    first = np.asarray(first, np.int64)
    if len(first) < 2:
        return _NONE
    doc = 0
    while doc < len(first) - 1 or lo < first[-1]:
        hi = min(lo + step, int(first[-1]))
        # documents that begin here, and the one that goes on
        end = int(np.searchsorted(first[:-1], hi, "left" if hi < first[-1] else "right"))
        goes_on = doc > 0 and lo > first[doc - 1] and lo < first[doc]
        marks = np.concatenate([[lo] if goes_on else [], first[doc:end], [hi]]).astype(np.int64) - lo
        out.append(c.append(words[lo:hi], marks, goes_on))
        lo, doc = hi, end
    out.append(c.finish())
    return np.concatenate(out, axis=1)


def runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """Every row of ``docs``, without its text, with ``n_words``, ``runs``
    (array of start, length, period, in words, by start and period) and
    ``collapsed``: its words joined by single spaces, of every run only the
    first period.

    A run is a stretch with smallest period q and at least
    max(``least``, 2q) words that no neighbouring word extends. Words are
    what stands between ASCII white space; case counts. They are compared by
    64-bit hashes.

    Null, empty and blank texts have no words and an empty ``collapsed``;
    texts of any length are read whole, a slice of words at a time; repeated
    rows give a row each; columns named as a result give way to it; an empty
    table gives an empty result.
    """
    keep = without(docs, ["n_words", "runs", "collapsed", text_col])
    rows = docs.select(*[quoted(c) for c in keep], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    fields = ("start", "length", "period")
    more = [F.lit(0).cast("long").alias("n_words"), F.array(F.struct(*[F.lit(0).cast("long").alias(f) for f in fields])).alias("runs"), F.lit("").alias("collapsed")]
    schema = docs.select(*[quoted(c) for c in keep], *more).schema
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(batches, "__text"):
            w = Words(data, offs, lower=False)
            doc, s, e, p = find(w.hashes(), w.first, least)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))])
            cells = pa.StructArray.from_arrays([pa.array(x) for x in (s, e - s, p)], names=list(fields))
            # runs' words after their first period are left out
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, w.first[doc] + s + p, 1)
            np.add.at(step, w.first[doc] + e, -1)
            stays = np.flatnonzero(np.cumsum(step[:-1]) == 0)
            text, ends = joined(data, w, stays)
            out = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), cells), out], names=schema.names)

    return rows.mapInArrow(run, schema)


def joined(data: np.ndarray, w: Words, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given words, with one space between words of a document,
    and the bounds of the documents."""
    step = np.zeros(len(data) + 1, np.int64)
    step[w.start[stays]] += 1
    step[w.end[stays]] -= 1
    stay = np.cumsum(step[:-1]) > 0
    # a word that has one before it in its document has white space before it
    lead = np.searchsorted(w.first, stays, "right")
    gap = w.start[stays[1:][lead[1:] == lead[:-1]]] - 1
    data = data.copy()
    data[gap] = 32
    stay[gap] = True
    before = np.concatenate([[0], np.cumsum(stay)])
    docs = np.searchsorted(stays, w.first)
    ends = before[np.append(w.end[stays], 0)][docs - 1] if len(stays) else np.zeros(len(docs), np.int64)
    return data[stay], np.where(docs > 0, ends, 0)


def with_cycles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id and text) with about every tenth text made periodic from
    some word on: with h the CRC-32 of the id, g = floor(h / 10) and n words,
    if h is a multiple of 10 and n > 0, each word from a = g % n on becomes
    word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id
    leaves the text as it is."""
    h = F.crc32(quoted(id_col).cast("string"))
    rows = docs.select(quoted(id_col), quoted(text_col).alias("__t"), F.floor(h / 10).alias("__g"), F.when(h % 10 == 0, F.regexp_extract_all(quoted(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("__w"))
    rows = rows.withColumn("__n", F.size("__w"))
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    rows = rows.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    w, n, a, p = (F.col(c) for c in ("__w", "__n", "__a", "__p"))
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    cycle = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n), " ")
    return rows.select(quoted(id_col), F.when(F.col("__n") > 0, cycle).otherwise(F.col("__t")).alias(text_col))


def digests(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_runs``, the longest run (ties: smallest start, then
    period; nulls without one), and digests of all runs and of the collapsed
    text. Edge cases as in :func:`runs`."""
    got = runs(docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("text")), least)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    got = got.select("__id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("b.length"), -F.col("b.col2"), -F.col("b.col3")
    return got.select(F.col("__id").alias(id_col), "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
