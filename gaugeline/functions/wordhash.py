"""Hashes of the words of a whole column of texts at once, for operators that run over batches of texts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

HASHED = 1 << 22  # bytes hashed at once
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)  # A-Z only
WEIGHT = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)[LOWER]


class Words(NamedTuple):
    """The words of some texts, in order: hash, number of the text, first byte and length; and the texts' bytes."""

    hashes: np.ndarray
    owners: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    data: np.ndarray


def hashed_words(texts: pa.Array, in_word: np.ndarray) -> Words:
    """The words of a column of texts (strings or binary, without nulls), A-Z read as a-z.

    ``in_word`` says of each byte whether it belongs to a word. A hash is a polynomial over the weights of the bytes,
    scrambled with the length. Bytes are hashed HASHED at a time, cut between words, so that what a long text needs beside
    itself is in proportion to its words.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    parts, at = [], 0
    while at < len(data):
        end = min(at + HASHED, len(data))
        while end < len(data) and in_word[data[end - 1]]:
            gap = np.flatnonzero(~in_word[data[end : end + HASHED]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + HASHED, len(data))
        hashes, owners, starts, lengths = _words_between(data[at:end], np.clip(bounds, at, end) - at, in_word)
        parts.append((hashes, owners, starts + at, lengths))
        at = end
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, none, data)
    return Words(*(np.concatenate(x) for x in zip(*parts)), data)


def _words_between(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray):
    inside = in_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    at = np.flatnonzero(inside)
    number = np.cumsum(first)[at] - 1
    depth = at - starts[number]
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(int(depth.max()), STEP))))
    cuts = np.flatnonzero(first[at])
    sums = np.add.reduceat(WEIGHT[data[at]] * powers[depth], cuts)
    lengths = np.diff(np.append(cuts, len(at)))
    return mixed(sums + lengths.astype(np.uint64) * GOLDEN), np.searchsorted(bounds, starts, side="right") - 1, starts, lengths
