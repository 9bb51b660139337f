"""Characters of a document as columns, grouped to words, lines and blocks by numpy.

The rules are those of :mod:`.grouping`, which says them character by character; here a document's
characters stay in arrays, and words are made only for the lines that someone asks for them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

from ..model import Block, Box, Char, Line, Word
from . import grouping as G

#: Whether a code point is white space; all beyond the table are none.
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


class Packed:
    """Columns of characters of one code point each, in the order of page and place, without line breaks.

    ``styles`` are the kinds of (size, weight, font), ``style`` a character's number among them. All
    numbers must be finite.
    """

    def __init__(self, text, page, seq, left, bottom, right, top, size, style, styles, angle):
        if len(page) > 1 and not ((page[1:] > page[:-1]) | ((page[1:] == page[:-1]) & (seq[1:] >= seq[:-1]))).all():
            order = np.lexsort((seq, page))
            text = "".join([text[i] for i in order.tolist()])
            page, left, bottom, right, top, size, style, angle = (c[order] for c in (page, left, bottom, right, top, size, style, angle))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if "\n" in text or "\r" in text:
            keep = (code != 10) & (code != 13)
            text = text.replace("\n", "").replace("\r", "")
            code, page, left, bottom, right, top, size, style, angle = (c[keep] for c in (code, page, left, bottom, right, top, size, style, angle))
        self.text, self.code, self.page = text, code, page
        self.left, self.bottom, self.right, self.top = left, bottom, right, top
        self.size, self.style, self.styles, self.angle = size, style, styles, angle

    def _word_starts(self) -> np.ndarray:
        """Whether a character begins a word, or is white space, by its predecessor."""
        left, bottom, right, top, size = self.left, self.bottom, self.right, self.top, self.size
        space = SPACE[np.minimum(self.code, len(SPACE) - 1)]
        first = np.ones(len(space), bool)
        first[1:] = self.page[1:] != self.page[:-1]
        start = first.copy()
        start[1:] |= space[:-1]
        # level and touching, as most are, needs no closer look
        k = 1 + np.flatnonzero(~space[1:] & ~start[1:] & ((bottom[1:] != bottom[:-1]) | (left[1:] > right[:-1])))
        if len(k):
            p = k - 1
            em, base = np.maximum(np.maximum(size[k], size[p]), 1.0), np.maximum(size[p], 1.0)
            rise, gap = np.abs(bottom[k] - bottom[p]), left[k] - right[p]
            script = (size[k] <= base * G.SCRIPT_SIZE) & (bottom[k] < top[p]) & (bottom[p] < top[k]) & (rise > np.maximum(base, size[k]) * G.SCRIPT_OFFSET) & (gap <= base * G.SCRIPT_GAP)
            start[k] |= ((rise > em * G.BASELINE) | (gap > em * G.WORD_GAP)) & ~script
        self.solid = np.flatnonzero(~space)
        return start[self.solid]

    def blocks(self) -> dict[int, list[Block]]:
        """Blocks of every page that has a character."""
        out: dict[int, list[Block]] = {p: [] for p in np.unique(self.page).tolist()}
        if not len(self.page):
            return out
        at = np.flatnonzero(self._word_starts())
        if not len(at):
            return out
        solid = self.solid
        begin, end = solid[at], solid[np.append(at[1:], len(solid)) - 1] + 1
        lo = [np.minimum.reduceat(c[solid], at) for c in (self.left, self.bottom)]
        hi = [np.maximum.reduceat(c[solid], at) for c in (self.right, self.top)]
        page, size, y = self.page[begin], self.size[begin], (lo[1] + hi[1]) / 2
        # words level with and as large as the one before share its line, whatever that line's first word is
        fresh = np.ones(len(at), bool)
        fresh[1:] = (page[1:] != page[:-1]) | (y[1:] != y[:-1]) | (size[1:] != size[:-1])
        heads = np.flatnonzero(fresh)
        opens, anchor = [], (None, 0.0, 0.0)
        for k, p, v, s in zip(heads.tolist(), page[heads].tolist(), y[heads].tolist(), size[heads].tolist()):
            if p == anchor[0]:
                big, small = max(s, anchor[2]), min(s, anchor[2])
                if abs(v - anchor[1]) <= max(big, 1.0) * G.LINE_Y and big / max(small, 1.0) <= G.LINE_RATIO:
                    continue
            opens.append(k)
            anchor = (p, v, s)
        starts = np.array(opens)
        line = np.zeros(len(at), np.int64)
        line[starts[1:]] = 1
        line = np.cumsum(line)
        if ((lo[0][1:] < lo[0][:-1]) & (line[1:] == line[:-1])).any():
            order = np.lexsort((lo[0], line))
            begin, end, *lo = (c[order] for c in (begin, end, *lo))
            hi = [c[order] for c in hi]
        self.begin, self.end, self.lo, self.hi = begin, end, lo, hi
        kind = self.style[solid]
        low, high = np.minimum.reduceat(kind, at), np.maximum.reduceat(kind, at)
        low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        kinds, counts = np.where(low == high, low, -1).tolist(), np.add.reduceat(end - begin, starts).tolist()
        boxes = zip(*(np.minimum.reduceat(c, starts).tolist() for c in lo), *(np.maximum.reduceat(c, starts).tolist() for c in hi))
        text = self.text
        words = [text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        cuts = [*opens, len(words)]
        by: dict[int, list[Line]] = {}
        for p, box, a, b, kind, n in zip(page[starts].tolist(), boxes, cuts, cuts[1:], kinds, counts):
            by.setdefault(p, []).append(PackedLine(" ".join(words[a:b]), Box(*box), self, a, b, Counter({self.styles[kind]: n}) if kind >= 0 else None))
        for p, ls in by.items():
            out[p] = G.blocks(ls)
        return out


class PackedLine(Line):
    """A line of words that lie in arrays."""

    def __init__(self, text: str, box: Box, packed: Packed, first: int, last: int, styles: Counter | None):
        self.text, self.box, self._of, self._span, self._words, self._styles = text, box, packed, (first, last), None, styles

    @property
    def words(self) -> list[Word]:
        if self._words is None:
            p, out = self._of, []
            for w in range(*self._span):
                a, b = int(p.begin[w]), int(p.end[w])
                boxes = map(Box, *(c[a:b].tolist() for c in (p.left, p.bottom, p.right, p.top)))
                chars = [Char(t, box, p.styles[k][2], p.styles[k][0], p.styles[k][1], g) for t, box, k, g in zip(p.text[a:b], boxes, p.style[a:b].tolist(), p.angle[a:b].tolist())]
                out.append(Word(p.text[a:b], Box(*(float(c[w]) for c in (*p.lo, *p.hi))), chars))
            self._words = out
        return self._words

    def extents(self) -> list[tuple[float, float, str]]:
        p, (a, b) = self._of, self._span
        return [(x, z, p.text[i:j]) for x, z, i, j in zip(p.lo[0][a:b].tolist(), p.hi[0][a:b].tolist(), p.begin[a:b].tolist(), p.end[a:b].tolist())]

    def styles(self) -> Counter:
        if self._styles is None:
            p, (a, b) = self._of, self._span
            of = np.concatenate([p.style[i:j] for i, j in zip(p.begin[a:b].tolist(), p.end[a:b].tolist())])
            kinds, counts = np.unique(of, return_counts=True)
            self._styles = Counter({p.styles[k]: n for k, n in zip(kinds.tolist(), counts.tolist())})
        return self._styles
