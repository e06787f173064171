"""Word segmentation of scripts without spaces (#11, #34, #35).

A dictionary of words with counts gives each word a cost; a run of letters is
cut where the sum of costs is least (a unigram word lattice, solved by
Viterbi). The dictionary is counted from the corpus itself: character
sequences that stand together far more often than their parts would by
chance. A user's own table (word, n) does as well.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.trie import Trie, code_points
from parlance.operators.util import ship

# Blocks of scripts that are written without spaces (Han and its
# extensions, kana, Thai, Lao, Myanmar, Khmer).
UNSPACED = (
    (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
    (0x20000, 0x323AF), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF),
)
SEPARATOR, SPACED, RUN = range(3)
# Costs are integers, so sums are exact and ties are defined.
SCALE = 1 << 16
# Bounds of a dictionary: it is a model of fixed size that travels to the workers.
MAX_WORDS = 300_000
MAX_CHARS = 4_000_000
BATCH_GRAMS = 500_000
SLICE_CHARS = 200_000  # characters that are cut at once, where texts are shorter


@lru_cache(maxsize=2)
def kinds(letters: bool) -> np.ndarray:
    """Kind of every code point. With ``letters`` all letters and digits form
    runs to be cut, not only those of unspaced scripts."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LN":
            out[c] = RUN if letters else SPACED
    for a, b in UNSPACED:
        out[a : b + 1] = RUN
    return out


def _runs(points: np.ndarray, bounds: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the kind of character changes or a text begins, and the kinds."""
    kind = kinds(letters)[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(edge)
    return cut, kind[cut[:-1]] if len(points) else np.zeros(0, np.uint8)


def count_words(df: DataFrame, col: str, max_len: int = 4, min_count: int = 3, cohesion: float = 20.0, max_words: int = MAX_WORDS, letters: bool = False) -> DataFrame:
    """(word, n): dictionary counted from all rows of ``df``.

    Single characters count as they are. A longer sequence is a word if it
    occurs ``min_count`` times and, for every way to cut it in two, at least
    ``cohesion`` times as often as chance would put the parts together. The
    ``max_words`` most frequent stay (ties by word): a documented size of the
    model. Runs are read whole; counts combine per batch and map-side.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["word", "n"])
            grams.clear()
            return b

        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            points, bounds = code_points(texts)
            cut, kind = _runs(points, bounds, letters)
            flat = "".join(texts)
            for i in np.flatnonzero(kind == RUN).tolist():
                lo, hi = int(cut[i]), int(cut[i + 1])
                for size in range(1, min(max_len, hi - lo) + 1):
                    grams.update([flat[j : j + size] for j in range(lo, hi - size + 1)])
                if len(grams) > BATCH_GRAMS:
                    yield out()
        yield out()

    grams = df.select(col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    from parlance.operators.util import materialize

    grams = materialize(grams.where((F.col("n") >= min_count) | (F.length("word") == 1)))
    total = grams.where(F.length("word") == 1).select(F.sum("n")).scalar()
    long = grams.where(F.length("word") > 1).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    halves = long.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("x"), F.substring("word", F.col("at") + 1, F.length("word")).alias("y"))
    a, b = (grams.select(F.col("word").alias(k), F.col("n").alias("n" + k)) for k in "xy")
    # a part occurs at least as often as the whole, so it is there
    ratio = halves.join(a, "x").join(b, "y").withColumn("t", total)
    ratio = ratio.groupBy("word").agg(F.max("n").alias("n"), F.min(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))).alias("c"))
    words = ratio.where(F.col("c") >= cohesion).select("word", "n").union(grams.where(F.length("word") == 1))
    return words.orderBy(F.col("n").desc(), "word").limit(max_words)


def word_counts_as_dictionary(df: DataFrame, col: str, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, n) of spaced text: its words, lower-cased, most frequent first."""
    from parlance.functions.text import words

    n = df.select(F.explode(words(F.lower(F.col(col)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "word").limit(max_words)


class Lattice:
    """Cuts runs where the sum of word costs is least.

    A word of n in N occurrences costs round(SCALE * ln(N / n)); a character
    that is no word costs as one that occurs half a time. Of equal sums the
    one whose last word is longer wins, and so on backwards.
    """

    def __init__(self, words: list[tuple[str, int]]):
        words = [(w, n) for w, n in words if w and n > 0]
        total = sum(n for _, n in words) or 1
        self.trie = Trie([w for w, _ in words])
        self.cost = np.array([self.price(n, total) for _, n in words], np.int64)
        self.unknown = self.price(0.5, total)

    @staticmethod
    def price(n: float, total: int) -> int:
        return int(np.floor(SCALE * (np.log(float(total)) - np.log(float(n))) + 0.5))

    def cuts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Positions where a word begins in runs with these bounds, flat."""
        size = np.diff(bounds)
        n, width = len(points), int(size.max(initial=0))
        begin = np.repeat(bounds[:-1], size)
        edges = [(np.ones(n, np.int64), np.arange(n), np.full(n, self.unknown))]
        edges += [(np.full(len(p), k), p, self.cost[w]) for k, p, w in self.trie.matches(points, bounds)]
        step, at, cost = (np.concatenate(x) for x in zip(*edges))
        # by the place of their end in the run, shorter words first; the edge
        # of an unknown character before that of a word of one character
        end = at + step - begin[at]
        order = np.lexsort((np.arange(len(at)), step, end))
        step, at, cost, end = step[order], at[order], cost[order], end[order]
        group = np.flatnonzero(np.concatenate([[True], (end[1:] != end[:-1]) | (step[1:] != step[:-1]) | (at[1:] <= at[:-1]), [True]]))
        best, last = np.full(n + len(size), np.iinfo(np.int64).max), np.zeros(n + len(size), np.int64)
        run = np.repeat(np.arange(len(size)), size)  # a place before each run's first character
        best[bounds[:-1] + np.arange(len(size))] = 0
        for lo, hi in zip(group[:-1].tolist(), group[1:].tolist()):
            p, k = at[lo:hi], int(step[lo])
            x = p + run[p]
            total, y = best[x] + cost[lo:hi], x + k
            better = total <= best[y]
            best[y[better]], last[y[better]] = total[better], k
        mark = np.zeros(n + 1, bool)
        where, who = (bounds[1:] + np.arange(len(size))).copy(), np.arange(len(size))
        where, who = where[size > 0], who[size > 0]
        for _ in range(width):
            if not len(where):
                break
            where = where - last[where]
            mark[where - who] = True
            on = where > bounds[who] + who
            where, who = where[on], who[on]
        return np.flatnonzero(mark)

    def segments(self, texts: list[str], letters: bool = False, words_only: bool = False) -> list[list[str]]:
        """Segments of each text, which joined give the text again; with
        ``words_only`` those of letters and digits. The edges of a slice of the
        texts are held at once, however many texts there are."""
        out: list[list[str]] = []
        lo = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > SLICE_CHARS:
                out += self._segments(texts[lo:i], letters, words_only)
                lo, size = i, 0
            size += len(t)
        return out + self._segments(texts[lo:], letters, words_only)

    def _segments(self, texts: list[str], letters: bool, words_only: bool) -> list[list[str]]:
        points, bounds = code_points(texts)
        if not len(points):
            return [[] for _ in texts]
        cut, kind = _runs(points, bounds, letters)
        inner = np.flatnonzero(kind == RUN)
        size = cut[inner + 1] - cut[inner]
        if len(inner):
            own = np.concatenate([[0], np.cumsum(size)])
            flat = np.arange(own[-1]) + np.repeat(cut[inner] - own[:-1], size)
            c = self.cuts(points[flat], own)
            cut = np.union1d(cut, flat[c[c < own[-1]]])
        starts = cut[:-1]
        keep = np.ones(len(starts), bool)
        if words_only:
            keep = kinds(letters)[points[starts]] != SEPARATOR
        ends = cut[1:]
        text = np.searchsorted(bounds, starts, "right") - 1
        out: list[list[str]] = [[] for _ in texts]
        base = bounds[text]
        for i, a, b in zip(text[keep].tolist(), (starts - base)[keep].tolist(), (ends - base)[keep].tolist()):
            out[i].append(texts[i][a:b])
        return out


def lattice(dictionary: DataFrame) -> Lattice:
    """The lattice of a table (word, n), after a check of its size."""
    rows = dictionary.select("word", "n").orderBy(F.col("n").desc(), "word").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS or sum(len(r.word or "") for r in rows) > MAX_CHARS:
        raise ValueError(f"a dictionary holds at most {MAX_WORDS} words and {MAX_CHARS} characters; keep its most frequent words")
    return Lattice([(r.word, r.n) for r in rows])


def segmenter(dictionary: DataFrame, words_only: bool = False, letters: bool = False) -> Callable[[Column], Column]:
    """A segmenter (Column -> array of strings) for ``exclude_stopwords``
    (lossless) or, with ``words_only``, for ``top_words``. Null texts stay
    null."""
    spark = dictionary.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(lattice(dictionary))

    def cut(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        found = iter(sent.value.segments(texts[known].tolist(), letters, words_only))
        return pd.Series([next(found) if k else None for k in known], dtype=object)

    return F.pandas_udf(cut, "array<string>")
