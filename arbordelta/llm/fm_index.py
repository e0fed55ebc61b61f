"""An FM-index of a shard of texts: suffix order, wavelet ranks, sampled positions.

A shard is an array of symbols 1..63, each text followed by a separator 0.
Separators are told apart by their position, so that equal texts have a defined
order.  Everything is done on whole arrays.
"""

from __future__ import annotations

import numpy as np

#: A rank and a position are packed with this many bits each into one word to sort.
BITS = 21
MAX_SYMBOLS = (1 << BITS) - 1
LEVELS = 6
_MASK = np.uint64(MAX_SYMBOLS)


def suffix_order(codes: np.ndarray, symbols: int = 37) -> np.ndarray:
    """Positions of all suffixes in their order; codes end with a separator."""
    n = len(codes)
    if n > MAX_SYMBOLS:
        raise ValueError(f"a shard holds at most {MAX_SYMBOLS} symbols")
    if symbols ** 8 >> (64 - BITS):
        raise ValueError("too many symbols for the first key")
    at = np.arange(n, dtype=np.uint64)
    key, open_ = codes.astype(np.uint64), codes != 0
    for step in (1, 2, 4):  # the first eight symbols, nothing after a separator
        after = np.zeros_like(key)
        after[:-step] = key[step:]
        after[~open_] = 0
        key *= np.uint64(symbols ** step)
        key += after
        more = np.zeros_like(open_)
        more[:-step] = open_[step:]
        open_ &= more
    key <<= np.uint64(BITS)
    key |= at
    key.sort()
    order = (key & _MASK).astype(np.int64)
    key >>= np.uint64(BITS)
    head = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    head |= ~open_[order]
    del key
    index = np.arange(n)
    first = np.maximum.accumulate(np.where(head, index, 0))
    rank = np.empty(n, np.uint64)
    rank[order] = first
    tied = ~(head & np.append(head[1:], True))
    active, group = index[tied], first[tied]
    h = 8
    while len(active):
        pos = order[active]
        word = group.astype(np.uint64) << np.uint64(2 * BITS)
        word |= rank[pos + h] << np.uint64(BITS)
        word |= pos.astype(np.uint64)
        word.sort()
        pos = (word & _MASK).astype(np.int64)
        order[active] = pos
        word >>= np.uint64(BITS)
        head = np.ones(len(active), bool)
        np.not_equal(word[1:], word[:-1], out=head[1:])
        group = np.maximum.accumulate(np.where(head, active, 0))
        rank[pos] = group
        tied = ~(head & np.append(head[1:], True))
        active, group = active[tied], group[tied]
        h *= 2
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(packed) // 8 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    def __init__(self, codes: np.ndarray, sample: int = 32, symbols: int = 37):
        order = suffix_order(codes, symbols)
        before = codes[order - 1]
        counts = np.bincount(codes, minlength=1 << LEVELS)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        kept = (order % sample == 0) | (before == 0)  # a walk never crosses the start of a text
        self.sampled, self.positions = Bits(kept), order[kept]
        self.levels: list[tuple[Bits, int]] = []
        row = before
        for level in range(LEVELS - 1, -1, -1):
            one = (row >> level & 1).astype(bool)
            self.levels.append((Bits(one), int(len(row) - one.sum())))
            row = np.concatenate([row[~one], row[one]])
        every = np.arange(1 << LEVELS)
        self.base = self.first[:-1] - self._down(every, np.zeros(1 << LEVELS, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (LEVELS - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The row range's new bound once `symbol` is put before the pattern."""
        return self.base[symbol] + self._down(symbol, i)

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(i).astype(np.int64)
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            symbol = symbol << 1 | one
        return self.base[symbol] + i

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases, rows of equal length, that occur."""
        which = np.arange(len(phrases))
        last = phrases[:, -1].astype(np.int64)
        low, high = self.first[last], self.first[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
            symbol = phrases[which, j].astype(np.int64)
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[: len(which)], both[len(which):]
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        out = np.empty(len(rows), np.int64)
        which, walked = np.arange(len(rows)), 0
        while len(which):
            there = self.sampled.get(rows).astype(bool)
            out[which[there]] = self.positions[self.sampled.rank(rows[there])] + walked
            which, rows = which[~there], rows[~there]
            if len(which):
                rows = self.back(rows)
            walked += 1
        return out
