"""Byte-level BPE vocabularies read from a tokenizer file, and the split of
texts into the pieces that merges never cross."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

NONE = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable bytes for
    themselves, the others by the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return out


# Code points that newer Unicode tables call letters or
# numbers and the file format's split does not.
NOT_YET = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
OTHER, LETTER, NUMBER, SPACE = range(4)
# Fixed values of the split: endings that go with an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for a, b in NOT_YET:
        out[a : b + 1] = OTHER
    return out


def split_points(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of many texts, which begin at
    ``first``. Pieces are runs of one class; a space right before a run of
    another class joins it; the last of several white-space characters before
    such a run stands alone or joins; an apostrophe that begins a piece takes
    a few fixed endings from the letters after it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 3, bool)
    edge[first] = True
    edge[n:] = True
    begin = edge[:n].copy()
    begin[0] = True
    begin[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begin[1:] & ~edge[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    q = np.flatnonzero((points == 39) & begin)
    q = q[~edge[q + 1]]
    if len(q):
        q = q[begin[q + 1] & (kind[q + 1] == LETTER)]
        one, two = points[q + 1], points[np.minimum(q + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(q), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b)) & ~edge[q + 2]
        took = np.where(short, 1, np.where(long, 2, 0))
        q, took = q[took > 0], took[took > 0]
        begin[q + 1] = False
        rest = q + 1 + took
        begin[rest[rest < n]] = True
    return np.flatnonzero(begin)


class Vocabulary:
    """Symbols are numbered by time: 0-255 the bytes, 256 + r the result of
    merge r. ``ids`` maps symbols to the ids of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m = d["model"]
        if m["type"] != "BPE" or (d.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or d.get("normalizer") or d["pre_tokenizer"].get("add_prefix_space") or m.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [x.split(" ") if isinstance(x, str) else x for x in m["merges"]]
        vocab = m["vocab"]
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        symbol = {b: i for i, b in enumerate(self.bytes)}
        ids = [0] * (256 + len(merges))
        for c, b in letters.items():
            ids[b] = vocab[c]
        left, right = np.full(256 + len(merges), -1, np.int64), np.full(256 + len(merges), -1, np.int64)
        for r, (a, b) in enumerate(merges):
            x, y = raw(a), raw(b)
            if x + y in symbol:
                raise ValueError("two merges give one token")
            left[256 + r], right[256 + r] = symbol[x], symbol[y]
            symbol[x + y] = 256 + r
            self.bytes.append(x + y)
            ids[256 + r] = vocab[a + b]
        self.symbol, self.left, self.right = symbol, left, right
        self.n = len(self.bytes)
        self.ids = np.array(ids, np.int64)
        # pair -> rank, as sorted keys for binary search
        keys = left[256:] * self.n + right[256:]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d.get("added_tokens") or []):
            raise ValueError("added tokens that strip are not supported")
        self._added = regex.compile(b"|".join(regex.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.special_bytes = {x.encode(): i for x, i in self.special.items()}
        # bytes of every id, as one flat array
        by_id: dict[int, bytes] = {int(i): b for i, b in zip(ids, self.bytes)}
        by_id.update({i: c.encode() for c, i in self.special.items()})
        top = max(by_id) + 1
        parts = [by_id.get(i, b"") for i in range(top)]
        self.id_len = np.array([len(p) for p in parts], np.int64)
        self.id_off = np.concatenate([[0], np.cumsum(self.id_len)[:-1]])
        self.id_bytes = np.frombuffer(b"".join(parts), np.uint8)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, NONE without one."""
        k = a * self.n + b
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.ranks[at], NONE)

    def split(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges (start, end) of the pieces of many texts, and which
        pieces belong to each text. Strings of added tokens are pieces of
        their own, found from the left inside one text."""
        lead = (data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(lead), len(data))  # characters -> bytes
        marks, added = offs, np.zeros(0, np.int64)
        raw = data.tobytes()
        if self._added is not None and self._added.search(raw):
            spans = [(m.start() + a, m.end() + a) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for m in self._added.finditer(raw[a:b])]
            added = np.array(spans, np.int64).reshape(-1, 2)
            marks = np.unique(np.concatenate([offs, added.ravel()]))
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        start = at[split_points(points, np.searchsorted(at, marks))]
        if len(added):
            inside = np.searchsorted(added[:, 0], start, "left") - 1
            start = start[(inside < 0) | (start >= added[np.maximum(inside, 0), 1])]
        return start, np.append(start[1:], len(data)) if len(start) else start, np.searchsorted(start, offs)

    def pieces(self, text: str) -> list[bytes]:
        """Pieces of one text."""
        raw = text.encode()
        start, end, _ = self.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids, and where each id's bytes end."""
        n = self.id_len[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.id_off[ids] - (ends - n), n)
        return self.id_bytes[at], ends


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary of a file, kept by the worker process between tasks."""
    return Vocabulary(path)
