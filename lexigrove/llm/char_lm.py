"""Interpolated Kneser-Ney character models of order 4 for several classes at once.

Symbols are 16-bit codes; 0 separates words, and contexts do not reach over it. The grams
of all classes share sorted arrays of hashes; a row of values holds the log-probability of
the gram under each class, with all lower orders already mixed in, so that a known gram
costs one look-up for all classes. Grams that no class has seen fall back order by order
over the classes' back-off weights, which lie in arrays of the same kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexigrove.llm.bytes_kernel import mix64

ORDER, BITS = 4, 16


def letters_table() -> np.ndarray:
    """Symbol of each code point: the lower-case letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, dtype=np.uint16)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = _short(ord(low) if len(low) == 1 else code)
    return table


def visible_table() -> np.ndarray:
    """Symbol of each code point: itself, 0 for white space and control characters."""
    table = np.array([_short(c) for c in range(0x110000)], dtype=np.uint16)
    table[:33] = 0
    table[[0x7F, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 0
    return table


def _short(code: int) -> int:
    return code if code < 1 << BITS else 1 + code % ((1 << BITS) - 1)


def symbols(chunk: bytes, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with runs of separators made one, index at which each piece starts)."""
    raw = np.frombuffer(chunk, dtype=np.uint8)
    head = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    codes = np.frombuffer(chunk.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    s = table[codes]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    index = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], index[head[starts]]


def gram_keys(s: np.ndarray) -> np.ndarray:
    """The gram of order 4 that ends at each symbol, packed; what lies before a separator is 0."""
    out = s.astype(np.uint64)
    alive = np.ones(len(s), dtype=bool)
    for back in range(1, ORDER):
        earlier = np.zeros(len(s), dtype=np.uint64)
        earlier[back:] = s[:-back]
        alive &= earlier != 0
        out |= np.where(alive, earlier, np.uint64(0)) << np.uint64(BITS * back)
    return out


class HashArray:
    """Rows of values under sorted hashes, with a directory by the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix64(keys)
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.vstack([values[order], np.zeros((1, values.shape[1]))]).astype(np.float32)
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, whether it is there) of each key."""
        h = mix64(keys)
        at = self.first[(h >> self.shift).astype(np.int64)]
        late = np.flatnonzero(self.hashes[at] < h)
        while len(late):
            at[late] += 1
            late = late[self.hashes[at[late]] < h[late]]
        return at, self.hashes[at] == h


@dataclass
class KneserNey:
    """The classes' names, gram tables by order (1 to 4), back-off tables by order (2 to 4), and the base log-probability."""

    names: list
    grams: list[HashArray]
    backoffs: list[HashArray]
    base: float

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        """(n, classes) log-probabilities of the grams."""
        at, there = self.grams[ORDER - 1].find(keys)
        out = self.grams[ORDER - 1].values[at]
        miss = np.flatnonzero(~there)
        if len(miss):
            # rare grams repeat within a chunk: each different one is resolved once
            different, which = np.unique(keys[miss], return_inverse=True)
            out[miss] = self._lower(different, ORDER - 1)[which]
        return out

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Of grams unseen at ``order`` + 1: the back-off to ``order`` and below."""
        weight_at, weighted = self.backoffs[order].find(keys >> np.uint64(BITS))
        out = np.where(weighted[:, None], self.backoffs[order].values[weight_at], np.float32(0))
        if order == 0:
            return out + np.float32(self.base)
        short = keys & np.uint64((1 << (BITS * order)) - 1)
        at, there = self.grams[order - 1].find(short)
        part = self.grams[order - 1].values[at]
        miss = np.flatnonzero(~there)
        if len(miss):
            part[miss] = self._lower(short[miss], order - 1)
        return out + part


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, which = np.unique(keys, return_inverse=True)
    out = np.zeros((len(different), counts.shape[1]))
    np.add.at(out, which, counts)
    return different, out


def build(names: list, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
    """From different packed grams of order 4 and their counts (grams x classes)."""
    levels = [(keys.astype(np.uint64), counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):  # a lower gram counts the different grams that it ends
        above, n = levels[0]
        levels.insert(0, _summed(above & np.uint64((1 << (BITS * order)) - 1), (n > 0).astype(np.float64)))
    symbols_seen = max(1, len(levels[0][0]))
    base = -np.log(symbols_seen + 1.0)
    grams, backoffs, lower_keys, lower_p = [], [], None, None
    for order, (k, n) in enumerate(levels, start=1):
        ones, twos = ((n > 0) & (n <= 1)).sum(axis=0), ((n > 1) & (n <= 2)).sum(axis=0)
        discount = np.clip((ones + 0.5) / (ones + 2.0 * twos + 1.0), 0.05, 0.95)
        contexts, which = np.unique(k >> np.uint64(BITS), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n.shape[1])), np.zeros((len(contexts), n.shape[1]))
        np.add.at(total, which, n)
        np.add.at(kinds, which, (n > 0).astype(np.float64))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if order == 1:
            below = np.full((len(k), n.shape[1]), np.exp(base))
        else:
            below = lower_p[np.searchsorted(lower_keys, k & np.uint64((1 << (BITS * (order - 1))) - 1))]
        p = np.where(total[which] > 0, np.maximum(n - discount, 0) / np.maximum(total[which], 1), 0.0) + weight[which] * below
        grams.append(HashArray(k, np.log(p)))
        backoffs.append(HashArray(contexts, np.log(np.maximum(weight, 1e-12))))
        lower_keys, lower_p = k, p
    return KneserNey(names, grams, backoffs, base)
