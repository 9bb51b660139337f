"""Vectorised tokenising and hashing of UTF-8 text buffers.

A *word* is a maximal run of ASCII letters, digits, ``_`` and non-ASCII bytes; a *mark* is a
maximal run of other visible ASCII characters. ASCII letters are compared without
case. Tokens never cross documents.
"""

from __future__ import annotations

import numpy as np

_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens(data: np.ndarray, offs: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and the row it belongs to, in text order."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = _CLASS[data]
    if not marks:
        kind = (kind == 1).view(np.uint8)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offs[:-1][offs[:-1] < n]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], n)
    real = kind[at] != 0
    start, size = at[real], (end - at)[real]
    row = np.searchsorted(offs, start, "right") - 1
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=low[:n], mode="clip")
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) + _M3 * size.astype(np.uint64))
    more, off = np.flatnonzero(size > 8), 8
    while len(more):
        left = np.minimum(size[more] - off, 8)
        h[more] = mix((h[more] * _M3) ^ (eight[start[more] + off] & _MASK[left]))
        off += 8
        more = more[size[more] > off]
    return h, row


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` tokens of one row; a row of fewer tokens gives one run of them all."""
    if n <= 1 or not len(h):
        return h, row
    g = h.copy()
    m = len(h)
    each = np.bincount(row)
    count = each[row]
    pos = np.arange(m) - (np.cumsum(each) - each)[row]
    short = count < n
    for k in range(1, n):
        use = pos + k < count
        g[use] = mix(g[use] * _M3 + h[np.flatnonzero(use) + k])
    keep = np.where(short, pos == 0, pos + n <= count)
    return g[keep], row[keep]
