"""Tree similarities of many pairs of tables at once, as :func:`.metrics.teds_struct`, ``teds`` and ``teds_iou``.

Tables of one shape go through the same steps of the tree distance, so that each step is taken
for all pairs of two shapes by numpy. Distances that only shapes decide are kept.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from . import metrics as M

#: Numbers that a step's arrays may hold together, and the longest texts that are compared by the column.
CELLS, LONGEST = 4_000_000, 24
_PLAIN = re.compile(r"<table>(?:<tr>(?:<td>[^<]*</td>)*</tr>)*</table>")


class Shape:
    """All of a tree but its texts: per node in postorder what must be the same, and its leftmost leaf; and the key roots."""

    def __init__(self, kinds: tuple, left: tuple[int, ...]):
        self.kinds, self.left, self.size = kinds, left, len(left)
        last: dict[int, int] = {}
        for i, k in enumerate(left):
            last[k] = i
        self.keys = sorted(last.values())


@lru_cache(65536)
def _shape(kinds: tuple, left: tuple[int, ...]) -> Shape:
    return Shape(kinds, left)


@lru_cache(65536)
def _plain_shape(columns: tuple[int, ...]) -> Shape:
    """The shape of a table with so many plain cells in each row."""
    kinds, left = [], []
    for n in columns:
        first = len(left)
        left += [*range(first, first + n), first]
        kinds += [("td", 1, 1)] * n + [("tr", 1, 1)]
    return _shape((*kinds, ("table", 1, 1)), (*left, 0))


def parse(html: str) -> tuple[Shape, list[str], M.Node | None]:
    """Shape and texts of a table's nodes, and its tree if some node has a box."""
    if html.isascii() and _PLAIN.fullmatch(html):
        rows = [r.split("</td>")[:-1] for r in html[len("<table>") : -len("</table>")].split("</tr>")[:-1]]
        texts = []
        for r in rows:
            texts += [c.rpartition("<td>")[2].strip() for c in r]
            texts.append("")
        return _plain_shape(tuple(map(len, rows))), [*texts, ""], None
    root = M.parse_table(html)
    nodes, left, _ = M._postorder(root)
    return _shape(tuple((n.tag, n.colspan, n.rowspan) for n in nodes), tuple(left)), [n.text for n in nodes], root if any(n.box for n in nodes) else None


def _distance(a: Shape, b: Shape, sub) -> np.ndarray | float:
    """:func:`.metrics.tree_distance` with costs ``sub[x][y]`` that are numbers, or arrays over pairs."""
    la, lb = a.left, b.left
    tree = [[0.0] * b.size for _ in la]
    least_of = np.minimum
    for i in a.keys:
        for j in b.keys:
            m, n = i - la[i] + 2, j - lb[j] + 2
            f = [[float(x + y) if not x or not y else 0.0 for y in range(n)] for x in range(m)]
            for x in range(1, m):
                p = la[i] + x - 1
                row, above, costs = f[x], f[x - 1], sub[p]
                for y in range(1, n):
                    q = lb[j] + y - 1
                    least = least_of(above[y], row[y - 1]) + 1
                    if la[p] == la[i] and lb[q] == lb[j]:
                        row[y] = tree[p][q] = least_of(least, above[y - 1] + costs[q])
                    else:
                        row[y] = least_of(least, f[la[p] - la[i]][lb[q] - lb[j]] + tree[p][q])
    return tree[-1][-1]


@lru_cache(65536)
def _of_shapes(a: Shape, b: Shape) -> tuple[float, float]:
    """The distances that take all texts for equal, and all nodes for different."""
    return float(_distance(a, b, [[float(x != y) for y in b.kinds] for x in a.kinds])), float(_distance(a, b, [[1.0] * b.size] * a.size))


class Texts:
    """Texts by number, as columns of code points."""

    def __init__(self, texts: list[str]):
        self.texts, self.length = texts, np.array([min(len(t), LONGEST + 1) for t in texts], np.int16)
        width = max(1, int(self.length[self.length <= LONGEST].max(initial=0)))
        self.code = np.array([t if len(t) <= LONGEST else "" for t in texts], f"U{width}").view(np.uint32).reshape(len(texts), width)
        self.long: dict[tuple[int, int], float] = {}

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Normalised edit distances of texts to texts; those of the same lengths take every step together."""
        la, lb = self.length[a], self.length[b]
        out = np.zeros(len(a))
        key = la * np.int16(LONGEST + 2) + lb
        order = np.argsort(key, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = order[s:e]
            n, m = int(la[k[0]]), int(lb[k[0]])
            if max(n, m) > LONGEST:
                for i, x, y in zip(k.tolist(), a[k].tolist(), b[k].tolist()):
                    if (x, y) not in self.long:
                        self.long[x, y] = M.normalized_distance(self.texts[x], self.texts[y])
                    out[i] = self.long[x, y]
                continue
            if not n or not m:
                out[k] = float(n != m)
                continue
            x, y = (np.ascontiguousarray(self.code[c[k], :w].T) for c, w in ((a, n), (b, m)))
            above = [np.full(len(k), j, np.int16) for j in range(m + 1)]
            for i in range(n):
                row = [np.full(len(k), i + 1, np.int16)]
                for j in range(m):
                    row.append(np.minimum(np.minimum(above[j + 1], row[j]) + 1, above[j] + (x[i] != y[j])))
                above = row
            out[k] = above[m] / max(n, m)
        return out


def similarities(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarities of pairs of tables as structure, with texts and with boxes."""
    number: dict[str, int] = {}
    known: dict[str, tuple[Shape, list[int], M.Node | None]] = {}

    def read(html: str):
        if html not in known:
            shape, texts, boxed = parse(html)
            known[html] = shape, [number.setdefault(t, len(number)) for t in texts], boxed
        return known[html]

    pairs = [(read(x), read(y)) for x, y in zip(a, b)]
    texts = Texts(list(number))
    out = np.zeros((3, len(pairs)))
    by: dict[tuple[Shape, Shape], list[int]] = {}
    for k, (x, y) in enumerate(pairs):
        by.setdefault((x[0], y[0]), []).append(k)
    for (x, y), all_ks in by.items():
        most = max(x.size, y.size)
        equal, different = _of_shapes(x, y)
        same = [(p, q) for p in range(x.size) for q in range(y.size) if x.kinds[p] == y.kinds[q]]
        step = max(1, CELLS // (x.size * y.size))
        for at in range(0, len(all_ks), step):
            ks = all_ks[at : at + step]
            ta, tb = (np.array([pairs[k][side][1] for k in ks], np.int64).reshape(len(ks), -1).T for side in (0, 1))
            sub: list[list] = [[1.0] * y.size for _ in range(x.size)]
            if same:
                costs = texts.distances(ta[[p for p, _ in same]].ravel(), tb[[q for _, q in same]].ravel()).reshape(len(same), -1)
                for (p, q), c in zip(same, costs):
                    sub[p][q] = c if c.any() else 0.0
            out[0, ks], out[1, ks], out[2, ks] = (1 - d / most for d in (equal, _distance(x, y, sub), different))
    for k, (x, y) in enumerate(pairs):
        if x[2] is not None and y[2] is not None:
            out[2, k] = M.teds_iou(a[k], b[k])
    return tuple(np.maximum(out, 0.0))
