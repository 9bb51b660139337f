"""Hashes and copies of many byte spans at once."""

from __future__ import annotations

import numpy as np

from .scan import mix

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_M3 = np.uint64(0x9E3779B97F4A7C15)


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start : start + size]``."""
    pad = np.zeros(len(data) + 8, np.uint8)
    pad[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", pad, strides=(1,))
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) + _M3 * size.astype(np.uint64))
    more, off = np.flatnonzero(size > 8), 8
    while len(more):
        left = np.minimum(size[more] - off, 8)
        h[more] = mix((h[more] * _M3) ^ (eight[start[more] + off] & _MASK[left]))
        off += 8
        more = more[size[more] > off]
    return h


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans, one span after another."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size
