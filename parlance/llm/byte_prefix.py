"""Byte-level BPE from a rank file by dynamic programming over byte prefixes.

Every byte prefix of a piece has one valid last token. It is stored, so a
piece is encoded by walking back from its end, an append goes on from the
stored prefixes, and an edit does again only what lies near it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.bpe import PieceIndex
from parlance.llm.common import quoted, ship, text_chunks, without
from parlance.llm.vocab import split_points

NEVER = np.int64(1) << 40
WIDE = 64  # pieces up to this many bytes are handled side by side
BLOCK = 8192
MAX_BYTES = 16 << 20  # of distinct pieces that a worker remembers (about 20 bytes each of store)
SLOTS = 1 << 20  # of the table of token pairs (8 MB)
LOOK = 2  # characters after a piece that can decide where it ends


class Ranks:
    """Tokens of a rank file (base64 and rank a line), numbered by rank, and
    the automaton that gives the longest token ending at each byte.

    ``left`` and ``right`` are the two tokens that the merges join to a token:
    its one split into lower ranks that no earlier merge would have crossed.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        self.ids = np.array([r for r, _ in pairs], np.int64)
        self.bytes = [t for _, t in pairs]
        self.symbol = {t: i for i, t in enumerate(self.bytes)}
        if len(self.symbol) < len(pairs) or not all(bytes([b]) in self.symbol for b in range(256)):
            raise ValueError("a rank file needs every byte, and no token twice")
        self.n = len(self.bytes)
        self.size = np.array([len(t) for t in self.bytes], np.int64)
        self.longest = int(self.size.max())
        self._splits()
        self._automaton()
        self.off = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.met = np.full(SLOTS, -2, np.int64)
        self.memo: dict[int, bool] = {}

    def _splits(self) -> None:
        """Both halves of every token, shorter tokens first."""
        n, symbol = self.n, self.symbol
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        # a single byte is there before all merges, whatever its rank
        self.time = np.where(self.size == 1, -1, np.arange(n))
        self.keys, self.ranks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for s, t in enumerate(self.bytes):
            for j in range(1, len(t)):
                a, b = symbol.get(t[:j], n), symbol.get(t[j:], n)
                if a < n and b < n and self.time[a] < s and self.time[b] < s:
                    by_size.setdefault(len(t), []).append((s, a, b))
        for k in sorted(by_size):
            s, a, b = np.array(by_size[k], np.int64).T
            ok = self.side_by_side(a, b)  # the pair's own merge is not known yet
            s, a, b = s[ok], a[ok], b[ok]
            self.left[s], self.right[s] = a, b
            keys, ranks = np.append(self.keys, a * n + b), np.append(self.ranks, s)
            order = np.argsort(keys)
            self.keys, self.ranks = keys[order], ranks[order]
        missing = np.flatnonzero((self.left < 0) & (self.size > 1))
        if len(missing):
            raise ValueError(f"{len(missing)} tokens are not joined from lower ranks, the first has rank {self.ids[missing[0]]}")

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        k = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], NEVER)

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave tokens b right after tokens a. The border
        is followed back in time: x and y are the tokens at its sides, and
        until_x and until_y the ranks that took them into larger ones. A merge
        of x and y with a rank before both would have crossed the border; of
        equal ranks the merge further left comes first."""
        ok = np.ones(len(a), bool)
        who, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(who):
            m = self.merge_rank(x, y)
            crossed = (m < until_x) & (m <= until_y)
            crossed &= m < NEVER
            ok[who[crossed]] = False
            tx, ty = self.time[x], self.time[y]
            on = ~crossed & (np.maximum(tx, ty) >= 0)
            who, x, y, tx, ty, until_x, until_y = (v[on] for v in (who, x, y, tx, ty, until_x, until_y))
            undo = ty >= tx  # the later one of the two goes back to its part at the border
            until_x, until_y = np.where(undo, until_x, tx), np.where(undo, ty, until_y)
            x, y = np.where(undo, x, self.right[x]), np.where(undo, self.left[y], y)
        return ok

    def _automaton(self) -> None:
        node = {b"": 0}
        for t in self.bytes:
            for j in range(1, len(t) + 1):
                node.setdefault(t[:j], len(node))
        depth = np.array([len(p) for p in node], np.int64)
        parent = np.array([node[p[:-1]] for p in node], np.int64)
        byte = np.array([p[-1] if p else 0 for p in node], np.int64)
        token = np.array([self.symbol.get(p, -1) for p in node], np.int64)
        self.next = np.zeros((len(node), 256), np.int32)
        self.end = np.full(len(node), -1, np.int32)  # longest token that ends here
        fail = np.zeros(len(node), np.int64)
        for d in range(depth.max() + 1):
            u = np.flatnonzero(depth == d)
            if d:
                # row of the parent's fail node is complete: it is less deep
                fail[u] = self.next[fail[parent[u]], byte[u]] if d > 1 else 0
                self.next[u] = self.next[fail[u]]
                self.end[u] = np.where(token[u] >= 0, token[u], self.end[fail[u]])
            child = np.flatnonzero(depth == d + 1)
            self.next[parent[child], byte[child]] = child
        # the next shorter token that a token ends with
        self.shorter = np.full(self.n, -1, np.int32)
        for s, t in enumerate(self.bytes):
            self.shorter[s] = next((self.symbol[t[j:]] for j in range(1, len(t)) if t[j:] in self.symbol), -1)

    # ------------------------------------------------------------ prefixes

    def _block(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Last tokens and tokens of short words, longest word first: each
        flat, with the number for every word."""
        n = np.array([len(w) for w in words])
        width, size = int(n[0]), len(words)
        text = np.zeros((width, size), np.uint8)
        text[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(size), n)] = np.frombuffer(b"".join(words), np.uint8)
        last = np.full((width + 1, size), -1, np.int32)
        state = np.zeros(size, np.int32)
        for e in range(1, width + 1):
            todo = np.arange(np.searchsorted(-n, -e, "right"))
            state = self.next[state[: len(todo)], text[e - 1, : len(todo)]]
            t = self.end[state]
            while len(todo):
                s = e - self.size[t]
                ok = s == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self._known(last[s[inner], todo[inner]], t[inner])
                last[e, todo[ok]] = t[ok]
                todo, t = todo[~ok], self.shorter[t[~ok]]
        at, who = n.copy(), np.arange(size)
        back_who, back_t = [], []
        while len(who):
            t = last[at[who], who]
            back_who.append(who)
            back_t.append(t)
            at[who] -= self.size[t]
            who = who[at[who] > 0]
        who, t = np.concatenate(back_who)[::-1], np.concatenate(back_t)[::-1]
        order = np.argsort(who, kind="stable")
        return [(last[1:].T[np.arange(width) < n[:, None]], n), (t[order], np.bincount(who, minlength=size))]

    def _known(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side, through a table of pairs met before: a slot holds the
        last pair that fell into it."""
        keys = a.astype(np.int64) * self.n + b
        slot = (keys * 0x9E3779B1 >> 20) & (SLOTS - 1)
        got = self.met[slot]
        out = (got & 1).astype(bool)
        new = np.flatnonzero(got >> 1 != keys)
        if len(new):
            k, back = np.unique(keys[new], return_inverse=True)
            ok = self.side_by_side(k // self.n, k % self.n)
            out[new] = ok[back]
            self.met[slot[new]] = keys[new] << 1 | out[new]
        return out

    def _may(self, a: int, b: int) -> bool:
        k = a * self.n + b
        got = self.memo.get(k)
        if got is None:
            if len(self.memo) >= 500_000:
                self.memo.clear()
            got = self.memo[k] = bool(self.side_by_side(np.array([a]), np.array([b]))[0])
        return got

    def extend(self, word: bytes, last: list[int], old: list[int] | None = None, shift: int = 0, same_from: int = 0) -> int:
        """Append the last tokens of the prefixes of ``word`` that ``last``
        does not hold yet; returns how many were worked out.

        ``old`` holds those of an earlier word whose byte j - shift is byte j
        of this one from ``same_from`` on. Once as many prefixes agree as the
        longest token has bytes, all later ones do and are copied.
        """
        state, done, agree = 0, len(last), 0
        for c in word[max(0, done - self.longest) : done]:
            state = self.next[state, c]
        for e in range(done + 1, len(word) + 1):
            state = self.next[state, word[e - 1]]
            t = int(self.end[state])
            while True:
                s = e - int(self.size[t])
                if s == 0 or self._may(last[s - 1], t):
                    break
                t = int(self.shorter[t])
            last.append(t)
            if old is not None and e > same_from + self.longest and e - shift > self.longest:
                agree = agree + 1 if t == old[e - 1 - shift] else 0
                if agree >= self.longest:
                    last.extend(old[e - shift :])
                    return e - done
        return len(word) - done

    def walk(self, last: list[int]) -> list[int]:
        """Tokens of a piece from the last tokens of its prefixes."""
        out, e = [], len(last)
        while e:
            out.append(last[e - 1])
            e -= int(self.size[last[e - 1]])
        return out[::-1]

    def prefixes(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The last token of every byte prefix of each piece, and the tokens
        of each piece: each flat, with every piece's offset and number."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= WIDE]
        at = [order[lo : lo + BLOCK] for lo in range(0, len(order), BLOCK)]
        parts = [self._block([words[i] for i in who.tolist()]) for who in at]
        for i in np.flatnonzero(size > WIDE).tolist():
            last: list[int] = []
            self.extend(words[i], last)
            at.append(np.array([i]))
            parts.append([(np.array(x, np.int32), np.array([len(x)])) for x in (last, self.walk(last))])
        out = []
        for cells in zip(*parts):
            flat, n = (np.concatenate(x) for x in zip(*cells))
            off, num = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            off[np.concatenate(at)], num[np.concatenate(at)] = np.cumsum(n) - n, n
            out.append((flat, off, num))
        return out

    # ------------------------------------------------------------ texts

    def split(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges of the pieces of many texts, and which belong to each."""
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # characters -> bytes
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        start = at[split_points(points, np.searchsorted(at, offs))]
        return start, np.append(start[1:], len(data)) if len(start) else start, np.searchsorted(start, offs)

    def to_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids, and where each id's bytes end. Ids that the
        file does not have stand for nothing."""
        s = np.minimum(np.searchsorted(self.ids, ids), self.n - 1)
        n = np.where(self.ids[s] == ids, self.size[s], 0)
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.off[s] - (ends - n), n)], ends


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


class Store(PieceIndex):
    """Last tokens and tokens of the distinct pieces that a worker has met."""

    def reset(self) -> None:
        super().reset()
        self.used = 0
        self.cells = [np.empty(1 << 16, np.int32) for _ in range(2)]  # last tokens, tokens
        self.fill = [0, 0]
        self.off, self.len = ([np.empty(1 << 14, np.int64) for _ in range(2)] for _ in range(2))

    def learn(self, words: list[bytes]) -> None:
        k, total = len(self.index), len(self.index) + len(words)
        for i, (flat, off, n) in enumerate(self.v.prefixes(words)):
            while total > len(self.off[i]):
                self.off[i], self.len[i] = np.resize(self.off[i], 2 * len(self.off[i])), np.resize(self.len[i], 2 * len(self.len[i]))
            end = self.fill[i] + len(flat)
            while end > len(self.cells[i]):
                self.cells[i] = np.resize(self.cells[i], 2 * len(self.cells[i]))
            self.cells[i][self.fill[i] : end] = flat
            self.off[i][k:total], self.len[i][k:total] = self.fill[i] + off, n
            self.fill[i] = end

    def look_up(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.fill[0] > MAX_BYTES:
            self.reset()
        return super().look_up(data, offs)

    def gather(self, i: int, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last tokens (0) or tokens (1) of pieces as ids, flat, and where
        each text's begin and end."""
        n = self.len[i][at]
        ends = np.cumsum(n)
        cells = self.cells[i][np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.off[i][at] - (ends - n), n)]
        return self.v.ids[cells], np.concatenate([[0], ends])[first]


_stores: dict[str, Store] = {}


def store_of(path: str) -> Store:
    if path not in _stores:
        _stores.clear()  # one vocabulary at a time
        _stores[path] = Store(load(path))
    return _stores[path]


def _ints(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (array of ints) of its whole text;
    with ``prefixes`` also ``starts``, the byte where each piece begins, and
    ``last``, for every byte the id of the last token of its piece up to and
    including that byte. :func:`edit` goes on from these.

    Null and empty texts have no ids; pieces of any length are encoded whole;
    repeated rows are encoded each; columns named as a result give way to it;
    an empty table gives an empty result.
    """
    more = ["ids", *["starts", "last"] * prefixes]
    keep = without(docs, more)
    rows = docs.select(*[quoted(c) for c in keep], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    schema = docs.select(*[quoted(c) for c in keep], *[F.array(F.lit(0)).alias(c) for c in more]).schema
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(path)
        for part, data, offs in text_chunks(batches, "__text"):
            at, first = store.look_up(data, offs)
            cells = [_ints(*store.gather(1, at, first))]
            if prefixes:
                start, _, _ = store.v.split(data, offs)
                cells.append(_ints(start - np.repeat(offs[:-1], np.diff(first)), first))
                cells.append(_ints(*store.gather(0, at, first)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cells], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Every row with ``decoded``: the bytes of its ids. Null ids give no
    bytes; ids that the file does not have stand for nothing."""
    keep = without(rows, ["decoded"])
    src = rows.select(*[quoted(c) for c in keep], F.coalesce(quoted(ids_col), F.array().cast("array<int>")).alias("__ids"))
    schema = rows.select(*[quoted(c) for c in keep], F.lit(b"").alias("decoded")).schema
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cells = part.column(part.num_columns - 1)
                n = np.asarray(cells.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                data, ends = v.to_bytes(cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].tolist()
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def edited(v: Ranks, text: str, starts: np.ndarray, last: np.ndarray, at: int, until: int, insert: str) -> tuple[str, list[int], list[int], list[int], int]:
    """One text with its characters ``at`` to ``until`` replaced: the new
    text, ids, starts and last tokens (as ids), and how many prefixes were
    worked out for it.

    Pieces that end LOOK characters before the edit stay. From there the new
    text is split again until a piece begins where one of the old text did;
    all later pieces stay. Of the pieces between, the first goes on from its
    stored prefixes, and the last ends once it agrees with the stored ones.
    """
    at = min(max(at, 0), len(text))
    until = min(max(until, at), len(text))
    new = text[:at] + insert + text[until:]
    raw, old_raw = new.encode(), text.encode()
    old_starts = [*starts.tolist(), len(old_raw)]
    far = lambda t, i: len(t[:i].encode())  # characters -> bytes
    edit_at, edit_end, shift = far(text, at), far(new, at + len(insert)), len(raw) - len(old_raw)
    k = max(int(np.searchsorted(starts, far(text, max(0, at - LOOK)), "right")) - 1, 0)
    begin = old_starts[k] if len(starts) else 0
    known = set(old_starts)
    rest = raw[begin:].decode()
    window = len(raw[begin:edit_end].decode()) + 64
    while True:
        data = rest[:window].encode()
        cut, _, _ = v.split(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        sure = begin + (len(data) if window >= len(rest) else len(rest[: window - LOOK].encode()))
        cut = (cut + begin).tolist()
        sync = next((c for c in cut if edit_end <= c <= sure and c - shift in known), None)
        if sync is None and window >= len(rest):
            sync = len(raw)
        if sync is not None:
            break
        window *= 2
    bounds = [c for c in cut if c < sync] + [sync]
    symbols = np.searchsorted(v.ids, last).tolist()
    out, work = symbols[:begin], 0
    tail = [s for s in old_starts[:-1] if s >= sync - shift]
    for a, b in zip(bounds[:-1], bounds[1:]):
        piece: list[int] = []
        if a == begin and a < edit_at:  # its bytes before the edit are those of an old piece
            old_end = old_starts[k + 1] if k + 1 < len(old_starts) else a
            piece = symbols[a : min(edit_at, b, old_end)]
        old, moved = None, 0
        if b > edit_end:
            j = int(np.searchsorted(starts, max(edit_end, a) - shift, "right")) - 1
            if old_starts[j + 1] + shift == b:
                old, moved = symbols[old_starts[j] : old_starts[j + 1]], old_starts[j] + shift - a
        work += v.extend(raw[a:b], piece, old, moved, max(0, edit_end - a, moved))
        out += piece
    out += symbols[sync - shift :]
    new_starts = old_starts[:k] + bounds[:-1] + [s + shift for s in tail]
    ids: list[int] = []
    for a, b in zip(new_starts, [*new_starts[1:], len(raw)]):
        ids += v.walk(out[a:b])
    return new, v.ids[ids].tolist(), new_starts, v.ids[out].tolist(), work


def edit(rows: DataFrame, path: str, at: str, until: str, insert: str, text_col: str = "text") -> DataFrame:
    """Rows of :func:`encode` with ``prefixes``, after replacing the characters
    from column ``at`` (from 0) up to column ``until`` by column ``insert``:
    the text, ``ids``, ``starts`` and ``last`` as a new encoding of the whole
    would give them, and ``redone``, the prefixes that were worked out.

    Positions beyond the text count as its end, so a large ``at`` appends;
    null positions, too, count as the end, and a null insertion as empty; a
    null text is empty. Columns named as a result give way to it.
    """
    end = F.lit((1 << 31) - 1)
    keep = without(rows, [text_col, "ids", "starts", "last", "redone"])
    none = F.array().cast("array<int>")
    src = rows.select(
        *[quoted(c) for c in keep],
        F.coalesce(quoted(text_col), F.lit("")).alias("__t"),
        *[F.coalesce(quoted(c), none).alias(f"__{c}") for c in ("starts", "last")],
        *[F.coalesce(quoted(c).cast("int"), end).alias(f"__{i}") for i, c in enumerate((at, until))],
        F.coalesce(quoted(insert), F.lit("")).alias("__new"),
    )
    result = [F.lit("").alias(text_col), *[F.array(F.lit(0)).alias(c) for c in ("ids", "starts", "last")], F.lit(0).cast("long").alias("redone")]
    schema = rows.select(*[quoted(c) for c in keep], *result).schema
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                cols = [part.column(i) for i in range(len(keep), part.num_columns)]
                args = zip(cols[0].to_pylist(), *[[np.array(x, np.int64) for x in c.to_pylist()] for c in cols[1:3]], *[c.to_pylist() for c in cols[3:]])
                new = list(zip(*[edited(v, *a) for a in args]))
                ints = pa.list_(pa.int32())
                types = [pa.string(), ints, ints, ints, pa.int64()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array(x, t) for x, t in zip(new, types)]], names=schema.names)

    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return per document
    ``n_tokens``, ``ids_sha256`` (little-endian unsigned 32-bit ids) and
    ``decoded_sha256`` (the decoded bytes). Edge cases as in :func:`encode`.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    schema = rows.select(quoted("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(path)
        for part, data, offs in text_chunks(batches):
            ids, bounds = store.gather(1, *store.look_up(data, offs))
            back, ends = store.v.to_bytes(ids)
            at = np.concatenate([[0], ends])[bounds].tolist()
            raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
            lines = bounds.tolist()
            hashed = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(lines[:-1], lines[1:])]
            texts = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(hashed), pa.array(texts)], names=schema.names)

    return rows.mapInArrow(run, schema)
