"""Reading order of many pages at once, by numpy: the recursive cuts of :mod:`.reading_order`, a level of all pages at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..model import Block, Box, Char, Line, Word
from . import reading_order as O
from .metrics import edit_distance


def last_of(key: np.ndarray) -> np.ndarray:
    """Whether a sorted key's entry is the last of its value."""
    return np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where a sorted key's values start."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def gutters(page: np.ndarray, size: np.ndarray, chars: np.ndarray, width: float) -> np.ndarray:
    """:func:`.reading_order.least_gutter` of every page by its blocks' sizes and numbers of characters; ``page`` is sorted and without gaps."""
    order = np.lexsort((size, page))
    upto, at = np.cumsum(chars[order]), starts_of(page)
    before = np.append(0, upto)[at]
    middle = before + np.add.reduceat(chars, at) // 2
    em = size[order][np.searchsorted(upto, middle, "right")]
    most = width * O.CUT
    return np.minimum(np.maximum(O.GUTTER_EM * em, min(O.GUTTER_PT, most)), most)


def _cuts(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, values: np.ndarray, least: np.ndarray, other=None) -> tuple[np.ndarray, np.ndarray]:
    """The groups that have a cut along an axis, and where it is: the middle of the widest gap, of equal ones the last.

    ``lo``, ``hi`` and the two of the ``other`` axis are ranks of values; with ``other`` the parts must share some height.
    """
    order = np.lexsort((lo, g))
    g, lo, hi, least = g[order], lo[order], hi[order], least[order]
    k = int(values.size)
    base = g * k
    end = np.maximum.accumulate(base + hi) - base
    i = 1 + np.flatnonzero((g[1:] == g[:-1]) & (lo[1:] > end[:-1]))
    at = values[end[i - 1]]
    gap = values[lo[i]] - at
    ok = gap >= least[i]
    if other is not None:
        below, above = (c[order] for c in other)
        m = int(max(below.max(), above.max())) + 1
        up, down = g * m, (g[-1] - g)[::-1] * m
        low = m - 1 - (np.maximum.accumulate(up + (m - 1 - below)) - up)
        high = np.maximum.accumulate(up + above) - up
        low_rest = m - 1 - (np.maximum.accumulate(down + (m - 1 - below)[::-1]) - down)[::-1]
        high_rest = (np.maximum.accumulate(down + above[::-1]) - down)[::-1]
        ok &= (low[i - 1] < high_rest[i]) & (low_rest[i] < high[i - 1])
    i, at, gap = i[ok], at[ok], gap[ok]
    best = np.lexsort((i, gap, g[i]))
    best = best[last_of(g[i][best])]
    return g[i][best], at[best] + gap[best] / 2


def orders(page: np.ndarray, left, bottom, right, top, size: np.ndarray, gutter: np.ndarray, height: float) -> np.ndarray:
    """Numbers of all blocks, page by page in reading order as :func:`.reading_order.xy_cut` gives it.

    ``page`` is sorted and numbers the pages from 0, ``gutter`` has the least gutter of each.
    """
    n = len(page)
    if not n:
        return np.zeros(0, np.int64)
    at = starts_of(page)
    # boxes turned inside out and type set over other type are rare, and left to the rules as they are
    odd = (right < left) | (top < bottom) | ~np.isfinite(left + bottom + right + top + size)
    odd = np.logical_or.reduceat(odd, at) | (np.maximum.reduceat(size, at) >= np.minimum.reduceat(size, at) * O.OVERLAY_RATIO)
    xs, ranks = np.unique(np.concatenate([left, right]), return_inverse=True)
    l_rank, r_rank = ranks[:n], ranks[n:]
    ys, ranks = np.unique(np.concatenate([bottom, top]), return_inverse=True)
    b_rank, t_rank = ranks[:n], ranks[n:]
    x, y = (left + right) / 2, (bottom + top) / 2
    group = page.astype(np.int64)
    active = np.flatnonzero(~odd[page])
    while len(active):
        # groups of one are done
        g = group[active]
        order = np.argsort(g, kind="stable")
        active, g = active[order], g[order]
        many = np.diff(np.append(starts_of(g), len(g)))
        active = active[np.repeat(many > 1, many)]
        if not len(active):
            break
        g = group[active]
        own, inside = np.unique(g, return_inverse=True)
        where = np.full(len(own), np.nan)
        cut, mid = _cuts(inside, l_rank[active], r_rank[active], xs, gutter[page[active]], (b_rank[active], t_rank[active]))
        where[cut] = mid
        across = np.zeros(len(own), bool)
        across[cut] = True
        rest = np.flatnonzero(~across[inside])
        if len(rest):
            sub, back = np.unique(inside[rest], return_inverse=True)
            cut, mid = _cuts(back, b_rank[active[rest]], t_rank[active[rest]], ys, np.full(len(rest), height * O.CUT))
            where[sub[cut]] = mid
        cut = where[inside]
        later = np.where(across[inside], x[active] >= cut, y[active] < cut)
        count = np.bincount(inside)
        behind = np.bincount(inside, weights=later).astype(np.int64)
        goes_on = (~np.isnan(where) & (behind > 0) & (behind < count))[inside]
        # the parts of a group take its place among the others in their order
        group *= 2
        group[active[goes_on & later]] += 1
        active = active[goes_on]
        group = np.unique(group, return_inverse=True)[1]
    out = np.lexsort((left, -top, group))
    for p in np.flatnonzero(odd).tolist():
        a, z = int(at[p]), int(at[p + 1]) if p + 1 < len(at) else n
        made = []
        for i in range(a, z):
            box = Box(float(left[i]), float(bottom[i]), float(right[i]), float(top[i]))
            made.append(Block(box, [Line("x", box, [Word("x", box, [Char("x", box, "", float(size[i]))])])]))
        number = {id(b): i for i, b in enumerate(made, a)}
        out[a:z] = [number[id(b)] for b in O.xy_cut(made, float(gutter[p]), height)]
    return out


@lru_cache(65536)
def order_distance(order: tuple[int, ...]) -> int:
    """Edit distance of different tokens to the same in another order; small pages share few orders."""
    return edit_distance(range(len(order)), order)


def moved(page: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether an order changes a page, for every page; ``page`` is sorted and without gaps."""
    return np.logical_or.reduceat(order != np.arange(len(order)), starts_of(page))


def fewest(page: np.ndarray, left, bottom, right, top, size, chars, width: float, height: float) -> np.ndarray:
    """How many blocks are left of every page when one after another is dropped from the end as long as
    the order still changes; 0 for pages whose order doesn't. The blocks of a page have different texts, of ``chars`` characters."""

    def changed(rows):
        pages, p = np.unique(page[rows], return_inverse=True)
        order = orders(p, left[rows], bottom[rows], right[rows], top[rows], size[rows], gutters(p, size[rows], chars[rows], width), height)
        return pages[moved(p, order)]

    n = int(page[-1]) + 1 if len(page) else 0
    out = np.zeros(n, np.int64)
    if not n:
        return out
    at = starts_of(page)
    count = np.diff(np.append(at, len(page)))
    kept = np.ones(len(page), bool)
    live = np.zeros(n, bool)
    live[changed(np.arange(len(page)))] = True
    out[live] = count[live]
    for step in range(1, int(count.max()) + 1):
        # two blocks that change places are as few as can be
        ask = np.flatnonzero(live & (out > 2) & (count >= step))
        if not len(ask):
            break
        drop = (at + count - step)[ask]
        some = np.zeros(n, bool)
        some[ask] = True
        trial = kept & some[page]
        trial[drop] = False
        done = np.zeros(n, bool)
        done[changed(np.flatnonzero(trial))] = True
        kept[drop[done[ask]]] = False
        out[done] -= 1
    return out
