"""Elias-Fano sequences and a two-level n-gram trie in one buffer, which may be memory-mapped; all reads are vectorised."""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Integers of ``width`` bits one after the other in 64-bit words, with a spare word at the end."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=U64)
    if width == 0 or not len(values):
        return out
    at = np.arange(len(values), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(out, word, values << shift)
    over = (at & 63) + width > 64
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out


def unpacked(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), dtype=U64)
    bit = at.astype(np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return (low | high) & U64((1 << width) - 1)


def select(words: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The position of the one with this rank (from 0); ``before`` counts the ones before each word."""
    word = np.searchsorted(before, rank, side="right") - 1
    left = (rank - before[word]).astype(np.int64)
    value, place = words[word].copy(), np.zeros(len(rank), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(value & U64((1 << width) - 1)).astype(np.int64)
        go = left >= ones
        left -= np.where(go, ones, 0)
        place += np.where(go, width, 0)
        value = np.where(go, value >> U64(width), value)
    return word * 64 + place


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary (a one per value, a zero per step)."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray):
        self.size, self.width, self.low, self.high = size, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones_before = np.cumsum(ones) - ones
        self.zeros_before = np.arange(len(high)) * 64 - self.ones_before

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Of ascending values below ``universe``: size, width of the low bits, low and high words."""
        size = len(values)
        width = max(0, (universe // max(size, 1)).bit_length() - 1)
        values = values.astype(U64)
        low = packed(values & U64((1 << width) - 1), width)
        ones = (values >> U64(width)).astype(np.int64) + np.arange(size)
        length = size + (universe >> width) + 1
        high = np.zeros(length // 64 + 1, dtype=U64)
        np.bitwise_or.at(high, ones >> 6, U64(1) << (ones & 63).astype(U64))
        return size, width, low, high

    def get(self, at: np.ndarray) -> np.ndarray:
        top = select(self.high, self.ones_before, at) - at
        return (top.astype(U64) << U64(self.width)) | unpacked(self.low, self.width, at)

    def values_below(self, top: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``top``."""
        step = np.maximum(top - 1, 0)
        at = select(~self.high, self.zeros_before, step) - step
        return np.where(top > 0, at, 0)

    def successor(self, wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Per query, the place of the smallest value not below ``wanted`` among the places first .. last-1, or last."""
        top = (wanted >> U64(self.width)).astype(np.int64)
        low = wanted & U64((1 << self.width) - 1)
        a, b = np.maximum(self.values_below(top), first), np.minimum(self.values_below(top + 1), last)
        b = np.maximum(a, b)
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            less = open_ & (unpacked(self.low, self.width, np.minimum(middle, self.size - 1)) < low)
            a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
        return np.minimum(np.maximum(a, first), last)


MAGIC = 0x4C4D5452
HASH_BITS = 62
CODES = (1 << 16) - 1


def quantised(values: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Least value, step, and 16-bit codes of the values in equal steps."""
    least = float(values.min()) if len(values) else 0.0
    step = (float(values.max()) - least) / CODES if len(values) else 0.0
    codes = np.rint((values - least) / step) if step > 0 else np.zeros(len(values))
    return least, step, codes.astype(np.uint16)


class Trie:
    """Words, and under each word the words it was seen after, with counts and quantised log10 numerators.

    Both levels are Elias-Fano sequences; monotone pointers lead from a word to its successors in the second level, where
    an entry is kept as word rank and context so that the whole level ascends. A context is looked up by a successor
    search inside the word's range.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, dtype=np.int64, count=16)
        if head[0] != MAGIC:
            raise ValueError("not a trie")
        floats = np.frombuffer(buffer, dtype=np.float64, count=4, offset=128)
        self.train_tokens, self.mu = int(head[1]), float(floats[0])
        self.least, self.step = float(floats[1]), float(floats[2])
        at, parts = 160, []
        for i in range(3):
            size, width, n_low, n_high = (int(x) for x in head[2 + 4 * i : 6 + 4 * i])
            low = np.frombuffer(buffer, dtype=U64, count=n_low, offset=at)
            high = np.frombuffer(buffer, dtype=U64, count=n_high, offset=at + 8 * n_low)
            at += 8 * (n_low + n_high)
            parts.append(EliasFano(size, width, low, high))
        self.words, self.pointers, self.pairs = parts
        self.counts = np.frombuffer(buffer, dtype=np.int64, count=self.words.size, offset=at)
        self.codes = np.frombuffer(buffer, dtype=np.uint16, count=self.pairs.size, offset=at + 8 * self.words.size)

    @staticmethod
    def build(words, counts, pair_word, pair_context, pair_count, train_tokens: int, mu: float) -> bytes:
        """words: ascending hashes with their counts; pairs: place of the word and context, ascending, with counts."""
        numerators = np.log10(pair_count + mu * counts[pair_word] / (train_tokens + 1))
        least, step, codes = quantised(numerators)
        ranges = np.concatenate(([0], np.cumsum(np.bincount(pair_word, minlength=len(words)))))
        entries = (pair_word.astype(U64) << U64(32)) | pair_context.astype(U64)
        levels = [
            EliasFano.parts(words, 1 << HASH_BITS),
            EliasFano.parts(ranges, len(entries) + 1),
            EliasFano.parts(entries, max(1, len(words)) << 32),
        ]
        head = [MAGIC, train_tokens]
        for size, width, low, high in levels:
            head += [size, width, len(low), len(high)]
        head += [0] * (16 - len(head))
        body = [np.array(head, dtype=np.int64), np.array([mu, least, step, 0.0])]
        body += [x for _, _, low, high in levels for x in (low, high)]
        return b"".join(x.tobytes() for x in [*body, counts.astype(np.int64), codes])

    @classmethod
    def mapped(cls, content: bytes) -> Trie:
        """The trie in an anonymous memory map of its own."""
        memory = mmap.mmap(-1, len(content))
        memory.write(content)
        return cls(memory)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie in a file, memory-mapped; pages are read when they are asked for."""
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: np.ndarray) -> np.ndarray:
        """The places of word hashes, -1 where unknown."""
        if not self.words.size:
            return np.full(len(words), -1, dtype=np.int64)
        n = np.full(len(words), self.words.size, dtype=np.int64)
        at = self.words.successor(words, np.zeros(len(words), dtype=np.int64), n)
        inside = np.minimum(at, self.words.size - 1)
        return np.where((at < self.words.size) & (self.words.get(inside) == words), inside, -1)

    def word_counts(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.counts[np.maximum(place, 0)], 0) if self.words.size else np.zeros(len(place), np.int64)

    def numerators(self, place: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10(n(context, word) + mu p(word)), where p is the share of the word among the training tokens."""
        out = np.log10(self.mu * np.maximum(self.word_counts(place), 1) / (self.train_tokens + 1))
        known = np.flatnonzero(place >= 0)
        if not len(known) or not self.pairs.size:
            return out
        rank = place[known]
        first, last = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        wanted = (rank.astype(U64) << U64(32)) | contexts[known].astype(U64)
        at = self.pairs.successor(wanted, first, last)
        inside = np.minimum(at, self.pairs.size - 1)
        hit = (at < last) & (self.pairs.get(inside) == wanted)
        out[known[hit]] = self.least + self.step * self.codes[inside[hit]]
        return out
