"""Token counts by dynamic programming over prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.bpe import MAX_PIECES, PieceIndex
from parlance.llm.common import quoted, ship, text_chunks
from parlance.llm.vocab import NONE, Vocabulary, load

# Pieces up to this many bytes are handled side by side; longer ones alone.
WIDE = 32
BLOCK = 8192


class PrefixCounter:
    """Exact token count of every prefix of a piece.

    The BPE encoding of a prefix ends in exactly one token t that may follow
    the last token of what is left before t; a pair of tokens may stand side
    by side iff no merge would have crossed their border. So the last token
    and the count of prefix i follow from those of shorter prefixes, and no
    prefix is ever encoded by itself. Candidates for t come from walking a
    trie of all tokens.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        # formation time of symbols: bytes before all merges
        self.time = np.concatenate([np.full(256, -1), np.arange(v.n - 256)]).astype(np.int64)
        nodes: dict[tuple[int, int], int] = {}
        token = [-1, -1]  # node 0: no way on; node 1: root
        rows = []
        for s, b in enumerate(v.bytes):
            at = 1
            for c in b:
                nxt = nodes.get((at, c))
                if nxt is None:
                    nxt = nodes[at, c] = len(token)
                    token.append(-1)
                    rows.append((at, c, nxt))
                at = nxt
            token[at] = s
        r = np.array(rows, np.int64)
        self.next = np.zeros((len(token), 256), np.int32)
        self.next[r[:, 0], r[:, 1]] = r[:, 2]
        self.token = np.array(token, np.int32)
        self.longest = max(map(len, v.bytes))
        self.memo: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens b may follow tokens a. Goes back in time along the
        right edge of a and the left edge of b: a border pair of rank m would
        merge if neither side has gone into its parent by then (at equal rank
        the merge further left comes first)."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        ta, tb = np.full(len(a), NONE), np.full(len(a), NONE)
        while len(live):
            m = self.v.pair_rank(a, b)
            bad = (m < ta) & (m <= tb) & (m != NONE)
            ok[live[bad]] = False
            fa, fb = self.time[a], self.time[b]
            go = ~bad & ((fa >= 0) | (fb >= 0))
            live, a, b, ta, tb, fa, fb = live[go], a[go], b[go], ta[go], tb[go], fa[go], fb[go]
            undo_b = fb >= fa
            ta, tb = np.where(undo_b, ta, fa), np.where(undo_b, fb, tb)
            a, b = np.where(undo_b, a, self.v.right[a]), np.where(undo_b, self.v.left[b], b)
        return ok

    def _block(self, words: list[bytes]) -> list[np.ndarray]:
        """Counts of all prefixes of words of similar, small length."""
        n = np.array([len(w) for w in words])
        width, size = int(n.max()), len(words)
        text = np.zeros((width, size), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        col = np.repeat(np.arange(size), n)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), col] = flat
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # (end, length) -> words, tokens
        for s in range(width):
            who = np.flatnonzero(n > s)
            node = np.ones(len(who), np.int32)
            for l in range(1, min(width - s, self.longest) + 1):
                inside = n[who] >= s + l
                who, node = who[inside], node[inside]
                node = self.next[node, text[s + l - 1, who]]
                alive = node > 0
                who, node = who[alive], node[alive]
                if not len(who):
                    break
                t = self.token[node]
                hit = t >= 0
                found[s + l, l] = who[hit], t[hit]
        last = np.full((width + 1, size), -1, np.int32)
        count = np.zeros((width + 1, size), np.int32)
        for e in range(1, width + 1):
            for l in range(min(e, self.longest), 0, -1):
                who, t = found.get((e, l), (None, None))
                if who is None or not len(who):
                    continue
                free = last[e, who] < 0
                who, t = who[free], t[free]
                if l < e and len(who):
                    ok = self.may_follow(last[e - l, who], t)
                    who, t = who[ok], t[ok]
                last[e, who] = t
                count[e, who] = count[e - l, who] + 1
        return [count[1 : k + 1, i] for i, k in enumerate(n.tolist())]

    def _alone(self, word: bytes) -> np.ndarray:
        """Counts of all prefixes of one long piece."""
        last, count = [-1] * (len(word) + 1), np.zeros(len(word) + 1, np.int32)
        nxt, token, memo = self.next, self.token, self.memo
        ends: list[list[int]] = [[] for _ in range(len(word) + 1)]
        for s in range(len(word)):
            node = 1
            for e in range(s, min(len(word), s + self.longest)):
                node = nxt[node, word[e]]
                if not node:
                    break
                if token[node] >= 0:
                    ends[e + 1].append(int(token[node]))
        for e in range(1, len(word) + 1):
            for t in ends[e]:
                s = e - len(self.v.bytes[t])
                if s:
                    k = (last[s], t)
                    if k not in memo:
                        if len(memo) > 1_000_000:
                            memo.clear()
                        memo[k] = bool(self.may_follow(np.array([k[0]]), np.array([t]))[0])
                    if not memo[k]:
                        continue
                last[e], count[e] = t, count[s] + 1
                break
            ends[e] = []
        return count[1:]

    def prefixes(self, words: list[bytes]) -> list[np.ndarray]:
        """For each piece, the token counts of its prefixes of 1, 2, ... bytes."""
        out: list[np.ndarray | None] = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        block: list[int] = []
        for i in order:
            if len(words[i]) > WIDE:
                out[i] = self._alone(words[i])
                continue
            if block and (len(block) >= BLOCK or len(words[i]) > 1.4 * len(words[block[0]]) + 2):
                for k, c in zip(block, self._block([words[j] for j in block])):
                    out[k] = c
                block = []
            block.append(i)
        if block:
            for k, c in zip(block, self._block([words[j] for j in block])):
                out[k] = c
        return out


class PrefixTable(PieceIndex):
    """Counts of the prefixes of every distinct piece a worker has met: of
    whole pieces for counting, of all prefixes where a text's are asked for."""

    def __init__(self, path: str):
        self.counter = PrefixCounter(load(path))
        super().__init__(self.counter.v)

    def reset(self) -> None:
        super().reset()
        self.total = np.empty(1 << 14, np.int64)
        self.rows: dict[bytes, np.ndarray] = {}

    def learn(self, words: list[bytes]) -> None:
        k, total = len(self.index), len(self.index) + len(words)
        while total > len(self.total):
            self.total = np.resize(self.total, 2 * len(self.total))
        special = self.v.special_bytes
        self.total[k:total] = [1 if w in special else c[-1] for w, c in zip(words, self.counter.prefixes(words))]

    def row(self, word: bytes) -> np.ndarray:
        """Counts of all prefixes of one piece."""
        if word not in self.rows:
            if len(self.rows) > MAX_PIECES:
                self.rows.clear()
            c = self.counter.prefixes([word])[0]
            if word in self.v.special_bytes:
                c = c.copy()
                c[-1] = 1
            self.rows[word] = c
        return self.rows[word]

    def totals(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Token counts of whole texts."""
        at, first = self.look_up(data, offs)
        return np.diff(np.concatenate([[0], np.cumsum(self.total[at])])[first])


class TextPrefixes:
    """Token counts of every prefix of one text, from stored counts."""

    def __init__(self, table: PrefixTable, text: str):
        self.table, self.pieces = table, [p.decode() for p in table.v.pieces(text)]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])]).astype(int)
        self.before = np.concatenate([[0], np.cumsum([table.row(p.encode())[-1] for p in self.pieces])]).astype(int)

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters. Only the piece that is
        cut, and white space right before it, can split otherwise than in the
        whole text; they are looked up again in the stored counts."""
        n_chars = min(max(n_chars, 0), int(self.start[-1]))
        k = int(np.searchsorted(self.start, n_chars, "right")) - 1
        if self.start[k] == n_chars:
            return int(self.before[k])
        tail, base = self.pieces[k][: n_chars - self.start[k]], k
        if k and self.pieces[k - 1].isspace():
            tail, base = self.pieces[k - 1] + tail, k - 1
        parts = self.table.v.pieces(tail)
        if len(parts) == 1 and base == k:  # a prefix of a stored piece
            return int(self.before[k] + self.table.row(self.pieces[k].encode())[len(parts[0]) - 1])
        return int(self.before[base] + sum(int(self.table.row(p)[-1]) for p in parts))

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix that ends with a piece and has at
        most ``budget`` tokens."""
        return int(self.start[np.searchsorted(self.before, budget, "right") - 1])


_tables: dict[str, PrefixTable] = {}


def table_of(path: str) -> PrefixTable:
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_bytes`` (UTF-8), ``n_tokens`` of its whole text and
    ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 of both; special strings count as the library
    counts them by default; repeated rows are counted each; an empty table
    gives an empty result; other columns are left out.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    schema = rows.select(quoted("id").alias(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for part, data, offs in text_chunks(batches):
            n = table.totals(data, offs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
