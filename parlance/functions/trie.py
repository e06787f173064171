"""Many patterns at once: a trie in flat arrays, walked for all positions of
many texts together."""

from __future__ import annotations

import numpy as np


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, flat, and the bounds of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(size)])


class Trie:
    """Distinct, non-empty words. A node's children are found by binary search
    over the sorted keys (node, letter); ``word`` is the word that ends at a
    node, else -1."""

    def __init__(self, words: list[str]):
        letters = sorted({c for w in words for c in w})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        number = {c: i for i, c in enumerate(letters)}
        self.width = len(letters) + 1
        child: dict[int, int] = {}
        word = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in w:
                k = at * self.width + number[c]
                nxt = child.get(k)
                if nxt is None:
                    nxt = child[k] = len(word)
                    word.append(-1)
                at = nxt
            word[at] = i
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.child = np.fromiter(child.values(), np.int64, len(child))[order]
        self.word = np.array(word, np.int64)
        self.longest = max(map(len, words), default=0)

    def matches(self, points: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, words) of all occurrences, overlapping ones, too,
        shorter words first. An occurrence lies within one text."""
        if not len(self.keys) or not len(points):
            return []
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        letter = np.where(self.letters[at] == points, at, self.width - 1)  # the last one: in no word
        stop = np.repeat(bounds[1:], np.diff(bounds))
        pos, node, out = np.arange(len(points)), np.zeros(len(points), np.int64), []
        for size in range(1, self.longest + 1):
            inside = pos + size <= stop[pos]
            pos, node = pos[inside], node[inside]
            key = node * self.width + letter[pos + size - 1]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            pos, node = pos[on], self.child[i[on]]
            if not len(pos):
                break
            end = self.word[node] >= 0
            if end.any():
                out.append((size, pos[end], self.word[node[end]]))
        return out
