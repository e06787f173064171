"""Ordered replacement with dictionaries of any size (#8-#10, #14).

The meaning is that of a loop: for each (term, target) in order, every
occurrence of the term is replaced, and later pairs see what earlier ones
wrote. A trie over all terms finds the few pairs that can fire in a row;
only these are applied, in order. After a replacement only the text around it
is searched again, because a new occurrence must touch what was written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.trie import Trie, code_points
from parlance.operators.util import ship

# A part of the dictionary that travels to the workers at once; the next part
# is applied to what this one has written.
PART_CHARS = 4_000_000
PART_PAIRS = 500_000


class Replacer:
    """Consecutive pairs of an ordered dictionary."""

    def __init__(self, pairs: list[tuple[str, str]]):
        pairs = [(t, c) for t, c in pairs if t and t != c]
        self.pairs = pairs
        number: dict[str, int] = {}
        who = np.array([number.setdefault(t, len(number)) for t, _ in pairs], np.int64)
        self.trie = Trie(list(number))
        # the orders of each term, ascending
        self.orders = np.argsort(who, kind="stable")
        self.first = np.searchsorted(who[self.orders], np.arange(len(number) + 1))

    def _orders(self, words: np.ndarray) -> np.ndarray:
        n = self.first[words + 1] - self.first[words]
        return self.orders[np.arange(n.sum()) + np.repeat(self.first[words] - (np.cumsum(n) - n), n)]

    def _scan(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(text, term) of every term that occurs, each once."""
        points, bounds = code_points(texts)
        found = self.trie.matches(points, bounds)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, word = np.concatenate([p for _, p, _ in found]), np.concatenate([w for *_, w in found])
        key = np.unique((np.searchsorted(bounds, pos, "right") - 1) * len(self.first) + word)
        return key // len(self.first), key % len(self.first)

    def apply(self, texts: list[str]) -> list[str]:
        row, word = self._scan(texts)
        out = list(texts)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        for r in np.unique(row).tolist():
            out[r] = self._chain(out[r], self._orders(word[bounds[r] : bounds[r + 1]]).tolist())
        return out

    def _chain(self, text: str, due: list[int]) -> str:
        """Apply the pairs ``due`` in order, and those that come up on the
        way. A pair whose term has gone in the meantime does nothing."""
        heapq.heapify(due)
        known, reach = set(due), self.trie.longest - 1
        while due:
            i = heapq.heappop(due)
            term, target = self.pairs[i]
            parts = text.split(term)
            if len(parts) == 1:
                continue
            text = target.join(parts)
            if reach < 1 and not target:
                continue
            near, at, last = [], 0, -1
            for p in parts[:-1]:
                at += len(p)
                lo, hi = max(0, at - reach), at + len(target) + reach
                if near and lo <= last:
                    near[-1][1] = hi
                else:
                    near.append([lo, hi])
                last = hi
                at += len(target)
            _, words = self._scan([text[a:b] for a, b in near])
            for j in self._orders(np.unique(words)).tolist() if len(words) else ():
                if j > i and j not in known:
                    known.add(j)
                    heapq.heappush(due, j)
        return text


def _parts(pairs: DataFrame, order: list[Column]) -> Iterator[list[tuple[str, str]]]:
    """Consecutive parts of the dictionary in order, one in memory at a time."""
    part, size = [], 0
    for r in pairs.where("term IS NOT NULL AND canon IS NOT NULL").orderBy(*order).select("term", "canon").toLocalIterator():
        part.append((r.term, r.canon))
        size += len(r.term) + len(r.canon)
        if size >= PART_CHARS or len(part) >= PART_PAIRS:
            yield part
            part, size = [], 0
    if part:
        yield part


def replace_ordered(df: DataFrame, cols: list[str], pairs: DataFrame, order: list[Column]) -> DataFrame:
    """``cols`` of ``df`` after replacing the terms of ``pairs`` (term, canon)
    in ``order``. Null texts stay null; empty terms and pairs with a null side
    do nothing; of equal order keys any may come first."""
    spark = df.sparkSession
    ship(spark)
    at = [df.columns.index(c) for c in cols]
    for part in _parts(pairs, order):
        sent = spark.sparkContext.broadcast(Replacer(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                cells = list(b.columns)
                for i in at:
                    texts = cells[i].to_pylist()
                    new = iter(own.apply([t for t in texts if t is not None]))
                    cells[i] = pa.array([None if t is None else next(new) for t in texts], cells[i].type)
                yield pa.RecordBatch.from_arrays(cells, names=b.schema.names)

        df = df.mapInArrow(run, df.schema)
    return df


def term_rows(df: DataFrame, col: str, terms: DataFrame) -> DataFrame:
    """(term, n_rows): in how many rows of ``df`` each distinct term of
    ``terms`` occurs; terms that occur nowhere are left out."""
    spark = df.sparkSession
    ship(spark)
    out = None
    distinct = terms.where("term <> ''").select("term", F.lit("").alias("canon")).distinct()
    for part in _parts(distinct, [F.col("term")]):
        sent = spark.sparkContext.broadcast(Replacer(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                texts = [t for t in b.column(0).to_pylist() if t is not None]
                if texts:
                    _, words = own._scan(texts)
                    word, n = np.unique(words, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([own.pairs[own.orders[own.first[w]]][0] for w in word.tolist()], pa.string()), pa.array(n, pa.int64())], names=["term", "n"])

        got = df.select(col).mapInArrow(run, "term string, n long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "term string, n long")
    return out.groupBy("term").agg(F.sum("n").alias("n_rows"))
