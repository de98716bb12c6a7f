"""Content-defined cut points: positions at which a hash of the bytes just before takes a chosen value."""

from __future__ import annotations

import numpy as np

WINDOW = 8  # bytes that decide on a cut
MULTIPLIER = 0x9E3779B1


def cut_points(data: np.ndarray, bits: int) -> np.ndarray:
    """Ascending positions p at which the hash of the ``WINDOW`` bytes data[p-WINDOW:p] has ``bits`` zero bits on top.

    A position depends on these bytes alone, so equal passages are cut alike wherever they stand. On average there is one
    cut per 2^bits bytes.
    """
    if len(data) < WINDOW:
        return np.empty(0, dtype=np.int64)
    wide = data.astype(np.uint32)
    pair = wide[:-1] * np.uint32(0x01000193) + wide[1:]
    four = pair[:-2] * np.uint32(0x85EBCA6B) + pair[2:]
    eight = four[:-4] * np.uint32(0xC2B2AE35) + four[4:]
    eight ^= eight >> np.uint32(15)
    eight *= np.uint32(MULTIPLIER)
    return np.flatnonzero(eight < np.uint32(1 << (32 - bits))) + WINDOW
