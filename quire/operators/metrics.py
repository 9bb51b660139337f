"""Quality measures: edit distances, table tree similarity, region matching."""

from __future__ import annotations

from collections import Counter

from ..model import CLASSES, Box, Region
from .markdown import giou, iou


def edit_distance(a, b) -> int:
    """Insertions, deletions and replacements between two sequences."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def normalized_distance(a: str, b: str) -> float:
    return edit_distance(a, b) / max(len(a), len(b)) if a or b else 0.0


def char_recall(truth: str, found: str) -> float:
    want, got = (Counter(c for c in t if not c.isspace()) for t in (truth, found))
    return sum((want & got).values()) / sum(want.values()) if want else 1.0


def line_accuracy(truth: list[str], found: list[str]) -> float:
    got = {x.strip() for x in found}
    return sum(x.strip() in got for x in truth) / len(truth) if truth else 1.0


class Node:
    """A node of a table's tree, with all that matching looks at."""

    def __init__(self, tag: str, colspan: int = 1, rowspan: int = 1, text: str = "", box: Box | None = None):
        self.tag, self.colspan, self.rowspan, self.text, self.box = tag, colspan, rowspan, text, box
        self.children: list[Node] = []


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for part in raw.split():
        if "=" in part:
            k, v = part.split("=", 1)
            out[k.lower()] = v.strip("\"'")
    return out


def _span(v: str | None) -> int:
    return int(v) if v is not None and v.isdigit() else 1


def _box(v: str | None) -> Box | None:
    # attributes are cut at spaces, so that a box of four numbers never arrives whole
    try:
        n = [float(x) for x in (v or "").split()]
    except ValueError:
        return None
    return Box(*n) if len(n) == 4 else None


def parse_table(html: str) -> Node:
    """The tree of a table: table, rows, cells. Sections are passed through; a table that isn't closed is empty."""
    root = Node("table")
    low = html.lower()
    start = low.find("<table")
    if start < 0 or low.find("</table", start) < 0:
        return root
    row = cell = None
    i = low.find(">", start) + 1
    end = low.find("</table", start)
    while i < end:
        at = html.find("<", i)
        at = end if at < 0 or at > end else at
        if cell is not None:
            cell.text += html[i:at]
        if at >= end:
            break
        close = html.find(">", at)
        if close < 0:
            break
        name = html[at + 1 : close].strip().rstrip("/")
        tag = (name.split() or [""])[0].lower()
        if tag == "tr":
            row = Node("tr")
            root.children.append(row)
        elif tag in ("td", "th"):
            a = _attributes(name[len(tag) :])
            cell = Node(tag, _span(a.get("colspan")), _span(a.get("rowspan")), "", _box(a.get("bbox")))
            if row is None:
                row = Node("tr")
                root.children.append(row)
            row.children.append(cell)
        elif tag in ("/td", "/th"):
            if cell is not None:
                cell.text = cell.text.strip()
            cell = None
        elif tag == "/tr":
            row = cell = None
        i = close + 1
    return root


def _postorder(root: Node) -> tuple[list[Node], list[int], list[int]]:
    nodes: list[Node] = []
    left: list[int] = []

    def visit(n: Node) -> int:
        first = None
        for c in n.children:
            k = visit(c)
            first = k if first is None else first
        nodes.append(n)
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    visit(root)
    seen, keys = set(), []
    for i in range(len(nodes) - 1, -1, -1):
        if left[i] not in seen:
            seen.add(left[i])
            keys.append(i)
    return nodes, left, sorted(keys)


def tree_distance(a: Node, b: Node, cost) -> float:
    """Zhang and Shasha's edit distance of ordered trees; insertion and deletion cost 1."""
    na, la, ka = _postorder(a)
    nb, lb, kb = _postorder(b)
    sub = [[cost(x, y) for y in nb] for x in na]
    tree = [[0.0] * len(nb) for _ in na]
    for i in ka:
        for j in kb:
            m, n = i - la[i] + 2, j - lb[j] + 2
            f = [[0.0] * n for _ in range(m)]
            for x in range(1, m):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, n):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, m):
                p = la[i] + x - 1
                for y in range(1, n):
                    q = lb[j] + y - 1
                    least = min(f[x - 1][y] + 1, f[x][y - 1] + 1)
                    if la[p] == la[i] and lb[q] == lb[j]:
                        f[x][y] = tree[p][q] = min(least, f[x - 1][y - 1] + sub[p][q])
                    else:
                        f[x][y] = min(least, f[la[p] - la[i]][lb[q] - lb[j]] + tree[p][q])
    return tree[-1][-1]


def _same(a: Node, b: Node) -> bool:
    return (a.tag, a.colspan, a.rowspan) == (b.tag, b.colspan, b.rowspan)


def _size(n: Node) -> int:
    return 1 + sum(map(_size, n.children))


def _teds(a: str, b: str, cost) -> float:
    x, y = parse_table(a), parse_table(b)
    return max(0.0, 1 - tree_distance(x, y, lambda p, q: cost(p, q) if _same(p, q) else 1.0) / max(_size(x), _size(y)))


def teds_struct(a: str, b: str) -> float:
    """Similarity of two tables' structure, 0 to 1."""
    return _teds(a, b, lambda p, q: 0.0)


def teds(a: str, b: str) -> float:
    """Similarity of structure and cell texts."""
    return _teds(a, b, lambda p, q: normalized_distance(p.text, q.text))


def teds_iou(a: str, b: str) -> float:
    """Similarity of structure and cell boxes; nodes without a box don't match."""
    return _teds(a, b, lambda p, q: 1 - iou(p.box, q.box) if p.box and q.box else 1.0)


def match_regions(found: list[Region], truth: list[Region], threshold: float) -> dict[str, dict]:
    """Greedy one-to-one matches per class, the surest found region first, each to its best free partner."""
    out = {}
    for kind in CLASSES:
        mine = sorted((i for i, r in enumerate(found) if r.kind == kind), key=lambda i: -found[i].confidence)
        free = [i for i, r in enumerate(truth) if r.kind == kind]
        if not mine and not free:
            continue
        pairs = []
        for i in mine:
            best = max(free, key=lambda j: iou(found[i].box, truth[j].box), default=None)
            if best is not None and iou(found[i].box, truth[best].box) >= threshold:
                pairs.append((i, best))
                free.remove(best)
        out[kind] = {"tp": len(pairs), "fp": len(mine) - len(pairs), "fn": len(free), "matches": pairs}
    return out


def f1(tp: int, fp: int, fn: int) -> float:
    return 2 * tp / (2 * tp + fp + fn) if tp or fp or fn else 0.0


def evaluate_pages(pages: list[tuple[list[Region], list[Region]]], threshold: float = 0.5) -> dict:
    """Pooled F1, mean GIoU over matches and support per class, and their means, over (found, truth) pages."""
    pool: dict[str, list] = {}
    for found, truth in pages:
        for kind, m in match_regions(found, truth, threshold).items():
            p = pool.setdefault(kind, [0, 0, 0, []])
            p[0] += m["tp"]
            p[1] += m["fp"]
            p[2] += m["fn"]
            p[3] += [giou(found[i].box, truth[j].box) for i, j in m["matches"]]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    scores = {k: f1(*p[:3]) for k, p in pool.items()}
    gious = {k: mean(p[3]) for k, p in pool.items()}
    return {"f1": scores, "giou": gious, "support": {k: p[0] + p[2] for k, p in pool.items()}, "macro_f1": mean(list(scores.values())), "mean_giou": mean([g for p in pool.values() for g in p[3]])}
