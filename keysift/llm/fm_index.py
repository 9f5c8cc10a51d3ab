"""An FM-index over the words of one shard: suffix array, wavelet matrix of its BWT, sampled places."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes of ``text`` (symbols below ``size``), by prefix doubling from three symbols on."""
    n, bits = len(text), max(1, int(size - 1).bit_length())
    depth = min(3, 63 // bits)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        part = np.zeros(n, np.int64)
        part[:n - i] = text[i:] + 1 if bits * depth < 62 else text[i:]
        key = (key << bits + (bits * depth < 62)) | part if i else part
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = heads
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        slots = np.flatnonzero(~single)  # places in the order whose group has several members
        if not len(slots):
            return order
        at = order[slots]
        after = at + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (heads[slots] << 31) | follow
        by = np.argsort(key)
        order[slots] = at[by]
        key = key[by]
        split = np.ones(len(slots), bool)
        split[1:] = key[1:] != key[:-1]
        new[slots] = split | new[slots]
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[slots]] = heads[slots]
        depth *= 2


class Bits:
    """A bit vector with ranks: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        small = np.packbits(bits, bitorder="little")
        packed[:len(small)] = small
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of the symbols, the highest first."""

    def __init__(self, text: np.ndarray, size: int):
        self.levels = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            one = (text >> bit) & 1 == 1
            self.levels.append((bit, Bits(one), len(text) - int(np.count_nonzero(one))))
            text = np.concatenate([text[~one], text[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``i``."""
        begin = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = bits.rank(begin), bits.rank(i)
            begin, i = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, i - b)
        return i - begin

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at ``i``, its occurrences before ``i``)."""
        symbol, begin = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one = bits.get(i)
            symbol |= one.astype(np.int64) << bit
            a, b = bits.rank(begin), bits.rank(i)
            begin, i = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, i - b)
        return symbol, i - begin


class FmIndex:
    """Counts and finds phrases in a sequence of symbols 0 .. size - 1."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffix_array(text, size)
        self.length = len(text)
        last = text.astype(np.int32)[order - 1]  # order 0 takes the last symbol: the sequence is read as a ring
        self.wavelet = Wavelet(last, size)
        self.begin = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=size), out=self.begin[1:])
        sampled = order % SAMPLE == 0
        self.sampled, self.places = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of ``phrases``, right-aligned rows of symbols, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            due = alive[lengths[alive] > step]
            if not len(due):
                break
            symbol = phrases[due, phrases.shape[1] - 1 - step]
            low[due] = self.begin[symbol] + self.wavelet.rank(symbol, low[due])
            high[due] = self.begin[symbol] + self.wavelet.rank(symbol, high[due])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of ``rows``, by walking back to a sampled place."""
        place, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            known = self.sampled.get(rows[open_])
            done = open_[known]
            place[done] = self.places[self.sampled.rank(rows[done])] + steps
            open_ = open_[~known]
            symbol, before = self.wavelet.get(rows[open_])
            rows[open_] = self.begin[symbol] + before
            steps += 1
        return place
