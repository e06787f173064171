"""BPE encoding and decoding by batched merge rounds on flat arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import RangeHash, quoted, ship, text_chunks, without
from parlance.llm.vocab import NONE, Vocabulary, load

# Distinct pieces remembered by a worker; the table starts anew beyond it.
MAX_PIECES = 400_000


def merge_rounds(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after BPE, flat, and the number for each word.

    The symbols of all words lie in one array. In a round, the ranks of the
    pairs are known from a binary search over the sorted pair keys; every
    word merges its lowest-ranked pair wherever it occurs, from left to
    right, and only pairs beside a merge are looked up again. A word without
    a pair leaves the array. Words have at least one byte.
    """
    n = np.array([len(w) for w in words], np.int64)
    sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), n)
    rank = np.full(len(sym), NONE)
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner] = v.pair_rank(sym[inner], sym[inner + 1])
    done_sym, done_word = [], []
    while len(sym):
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(begin, len(sym)))
        low = np.repeat(np.minimum.reduceat(rank, begin), size)
        open_ = low != NONE
        if not open_.all():
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            sym, word, rank, low = sym[open_], word[open_], rank[open_], low[open_]
            if not len(sym):
                break
        at = np.flatnonzero(rank == low)
        if len(at) > 1:  # of overlapping pairs (x x x) every second one, from the left
            new_run = np.concatenate([[True], np.diff(at) != 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        sym[at] = 256 + rank[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new_at = np.cumsum(keep)[at] - 1
        sym, word, rank = sym[keep], word[keep], rank[keep]
        touched = np.unique(np.concatenate([new_at, new_at - 1]))
        touched = touched[touched >= 0]
        last = touched == len(sym) - 1
        nxt = np.where(last, touched, touched + 1)
        same = ~last & (word[touched] == word[nxt])
        rank[touched] = NONE
        t = touched[same]
        rank[t] = v.pair_rank(sym[t], sym[t + 1])
    if not done_sym:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(words))


class PieceIndex:
    """Numbers the distinct pieces that a worker has met, by 64-bit hash."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.reset()

    def reset(self) -> None:
        self.index: dict[int, int] = {}

    def learn(self, words: list[bytes]) -> None:
        """Store what is to be known of new pieces, in this order."""
        raise NotImplementedError

    def look_up(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts, and which belong to each text."""
        if len(self.index) > MAX_PIECES:
            self.reset()
        start, end, first = self.v.split(data, offs)
        keys, where, back = np.unique(RangeHash(data).range_hash(start, end), return_index=True, return_inverse=True)
        index = self.index
        number = np.fromiter((index.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = data.tobytes()
            at = where[new]
            self.learn([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            number[new] = np.arange(len(index), len(index) + len(new))
            index.update(zip(keys[new].tolist(), number[new].tolist()))
        return number[back], first


class Pieces(PieceIndex):
    """Ids of every distinct piece, as one flat array."""

    def reset(self) -> None:
        super().reset()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.off, self.len = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def learn(self, words: list[bytes]) -> None:
        sym, n = merge_rounds(self.v, words)
        ids = self.v.ids[sym].astype(np.uint32)
        off = self.used + np.cumsum(n) - n
        for i, w in enumerate(words):
            if w in self.v.special_bytes:  # one id; the others of its merges stay unused
                ids[off[i] - self.used] = self.v.special_bytes[w]
                n[i] = 1
        k, total = len(self.index), len(self.index) + len(words)
        while total > len(self.off):
            self.off, self.len = np.resize(self.off, 2 * len(self.off)), np.resize(self.len, 2 * len(self.len))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[k:total], self.len[k:total] = off, n
        self.used += len(ids)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and where each text's ids end."""
        at, first = self.look_up(data, offs)
        n = self.len[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.off[at] - (ends - n), n)]
        return ids, np.concatenate([[0], ends])[first[1:]]


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The worker's table for a vocabulary file."""
    if path not in _pieces:
        _pieces[path] = Pieces(load(path))
    return _pieces[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", check: bool = False) -> DataFrame:
    """Every row of ``docs``, without its text, with ``ids`` (array of ints) of
    the whole text; with ``check`` also ``round_trip``, whether the ids decode
    to that text again.

    Special strings in a text get their own id, none is added, nothing is cut
    or padded. Null and empty texts have no ids; very long words take as many
    rounds as they need; repeated rows are encoded each; an empty table gives
    an empty result; columns named as a result give way to it.
    """
    more = ["ids", *["round_trip"] * check]
    keep = without(docs, [*more, text_col])
    rows = docs.select(*[quoted(c) for c in keep], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    schema = rows.select(*[quoted(c) for c in keep], F.array(F.lit(0)).alias("ids"), *[F.lit(True).alias("round_trip")] * check).schema
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = load(path), pieces_of(path)
        for part, data, offs in text_chunks(batches, "__text"):
            ids, ends = table.encode(data, offs)
            cells = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))]
            if check:
                same = [t == u for t, u in zip(decode_texts(v, ids, ends), part.column(part.num_columns - 1).to_pylist())]
                cells.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cells], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Every row with ``decoded``: the text of its ids, invalid UTF-8 replaced.
    Null ids decode to the empty text; unknown ids to nothing."""
    keep = without(rows, ["decoded"])
    src = rows.select(*[quoted(c) for c in keep], F.coalesce(quoted(ids_col), F.array().cast("array<int>")).alias("__ids"))
    schema = rows.select(*[quoted(c) for c in keep], F.lit("").alias("decoded")).schema
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cells = part.column(part.num_columns - 1)
                lens = np.asarray(cells.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                texts = decode_texts(v, cells.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "decoded"])

    return src.mapInArrow(run, schema)


def decode_texts(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of runs of ids that end at ``ends``."""
    ids = ids.astype(np.int64)
    ids = np.where((ids >= 0) & (ids < len(v.id_len)), ids, 0)
    data, at = v.decode_bytes(ids)
    at = np.concatenate([[0], at])[np.concatenate([[0], ends])].tolist()
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and return digests only:
    ``n_tokens``, ``ids_sha256`` (little-endian unsigned 32-bit ids) and
    ``decoded_sha256`` (the decoded text in UTF-8). Edge cases as in
    :func:`encode`; the decoded text is made from the ids, not from the input.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    schema = rows.select(quoted("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = load(path), pieces_of(path)
        for part, data, offs in text_chunks(batches):
            ids, ends = table.encode(data, offs)
            begin = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            hashed = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(begin.tolist(), ends.tolist())]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in decode_texts(v, ids, ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - begin, pa.int64()), pa.array(hashed), pa.array(texts)], names=schema.names)

    return rows.mapInArrow(run, schema)
