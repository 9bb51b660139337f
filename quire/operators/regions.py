"""Tables, pictures and the class of every block."""

from __future__ import annotations

import math
from collections import defaultdict

from ..model import Block, Box, Graphic, Line, Page, Region, hull, median_size, total
from . import phrases as P
from .style import BOLD_SHARE, bold_share_of

RULE_THICKNESS, RULE_LENGTH, TOUCH, GRID_LINES = 2.0, 10.0, 3.0, 2
FILL_AREA, FULL_PAGE = 900.0, 0.5
HEADER, FOOTER, MARGIN_HEIGHT, MARGIN_GAP = 0.92, 0.08, 0.10, 0.02
REPEAT_Y = 0.02
SHORT = 2
FOOTNOTE_BAND, FOOTNOTE_SIZE = 0.25, 0.95
HEADING_SIZE = 1.15
ROW_HEIGHT, ROW_ALIGN = 0.15, 20.0
CORRIDOR = 1.5
FORMULA_CENTER, FORMULA_WIDTH, FORMULA_ALONE = 0.08, 0.6, 1.2


def find_sets(n: int, linked) -> list[list[int]]:
    """Connected components of ``0..n-1``; each and all in the order of its last root's number."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = root(i), root(j)
                if a != b:
                    up[a] = b
    out = defaultdict(list)
    for i in range(n):
        out[root(i)].append(i)
    return [out[k] for k in sorted(out)]


def is_rule(g: Graphic) -> bool:
    w, h = g.box.width, g.box.height
    return g.kind == "stroke" and g.stroked and ((w <= RULE_THICKNESS and h >= RULE_LENGTH) or (h <= RULE_THICKNESS and w >= RULE_LENGTH))


def touch(a: Box, b: Box, tol: float = TOUCH) -> bool:
    """Whether ``a``, grown by ``tol``, reaches ``b``."""
    return a.right + tol >= b.left and b.right >= a.left - tol and a.top + tol >= b.bottom and b.top >= a.bottom - tol


def grid_lines(rules) -> tuple[list[float], list[float]]:
    """Positions of horizontal and of vertical rules, the first of those within ``TOUCH`` of each other."""
    ys: list[float] = []
    xs: list[float] = []
    for g in rules:
        flat = g.box.width >= g.box.height
        at, seen = (g.box.center[1], ys) if flat else (g.box.center[0], xs)
        if all(abs(s - at) > TOUCH for s in seen):
            seen.append(at)
    return ys, xs


def ruled_tables(page: Page) -> list[Region]:
    rules = [g for g in page.graphics if is_rule(g)]
    out = []
    for part in find_sets(len(rules), lambda i, j: touch(rules[i].box, rules[j].box)):
        own = [rules[i] for i in part]
        ys, xs = grid_lines(own)
        if len(ys) >= GRID_LINES and len(xs) >= GRID_LINES:
            out.append(Region("table", hull(g.box for g in own), 0.75, page.index))
    return out


def pictures(page: Page) -> list[Region]:
    whole = page.width * page.height
    out = []
    for g in page.graphics:
        if g.kind not in ("image", "fill"):
            continue
        covers = any(g.box.holds_center(b.box) for b in page.blocks)
        if g.kind == "image" and not (whole > 0 and g.box.area / whole >= FULL_PAGE and covers):
            out.append(Region("picture", g.box, 0.7, page.index))
        elif g.kind == "fill" and g.box.area >= FILL_AREA and not covers:
            out.append(Region("picture", g.box, 0.5, page.index))
    return out


def grid_cells(table: Box, graphics, blocks: list[Block]) -> list[list[str]] | None:
    """Cell texts of a ruled table, top row first; a block over several cells is in each."""
    ys, xs = grid_lines(g for g in graphics if is_rule(g) and touch(g.box, table))
    if len(ys) < GRID_LINES or len(xs) < GRID_LINES:
        return None
    ys, xs = sorted(ys, reverse=True), sorted(xs)
    inside = [b for b in blocks if table.holds_center(b.box)]
    return [["<br>".join(b.text for b in inside if b.box.top > lo and b.box.bottom < hi and b.box.right > x0 and b.box.left < x1) for x0, x1 in zip(xs, xs[1:])] for hi, lo in zip(ys, ys[1:])]


def margin_of(b: Block, height: float) -> str | None:
    if b.box.top >= HEADER * height:
        return "header"
    return "footer" if b.box.bottom <= FOOTER * height else None


def bands(bs: list[Block]) -> list[list[Block]]:
    """Blocks whose vertical extents overlap, directly or by way of others."""
    return [[bs[i] for i in part] for part in find_sets(len(bs), lambda i, j: bs[i].box.beside(bs[j].box))]


def open_tables(bs: list[Block], height: float, page: int) -> list[Region]:
    """Tables without rules: aligned rows of narrow blocks far apart."""
    rows = []
    for band in bands(bs):
        band = sorted(band, key=lambda b: b.box.left)
        if len(band) < 2 or any(margin_of(b, height) for b in band):
            continue
        gutter = min(y.box.left - x.box.right for x, y in zip(band, band[1:]))
        if gutter >= max(b.box.width for b in band) and max(b.box.height for b in band) <= height * ROW_HEIGHT:
            rows.append(band)
    rows.sort(key=lambda r: -max(b.box.top for b in r))
    tables: list[list[list[Block]]] = []
    for row in rows:
        above = tables[-1][-1] if tables else None
        if above and len(above) == len(row) and all(abs(x.box.left - y.box.left) <= ROW_ALIGN for x, y in zip(above, row)):
            tables[-1].append(row)
        else:
            tables.append([row])
    return [Region("table", hull(b.box for r in t for b in r), 0.5, page) for t in tables]


def line_tokens(line: Line) -> list[tuple[float, float, str]]:
    """Extents of a line's words; of a line in one piece those of its words on an even grid."""
    words = line.extents()
    if len(words) >= 2:
        return words
    box, text = (line.words[0].box, line.words[0].text) if line.words else (line.box, line.text)
    if not text or box.width <= 0:
        return []
    at = lambda i: box.left + box.width * i / len(text)
    out, start = [], None
    for i, c in enumerate(text + " "):
        if c.isspace() or i == len(text):
            if start is not None:
                out.append((at(start), at(i), text[start:i]))
            start = None
        elif start is None:
            start = i
    return out


def _gaps(line: Line) -> list[tuple[float, float]]:
    t = line_tokens(line)
    return [(a[1], b[0]) for a, b in zip(t, t[1:]) if b[0] > a[1]]


def _meet(xs: list[tuple[float, float]], ys: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What intervals of two lists have in common; side by side if both are in order and apart, as they are but for odd words."""
    if any(b[0] < a[1] for s in (xs, ys) for a, b in zip(s, s[1:])):
        return [(max(a, c), min(z, d)) for a, z in xs for c, d in ys if max(a, c) < min(z, d)]
    out, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        lo, hi = max(xs[i][0], ys[j][0]), min(xs[i][1], ys[j][1])
        if lo < hi:
            out.append((lo, hi))
        if xs[i][1] < ys[j][1]:
            i += 1
        else:
            j += 1
    return out


def corridors(b: Block) -> list[tuple[float, float]]:
    """Wide vertical stretches that are empty in every line of a block of two lines or more."""
    if len(b.lines) < 2:
        return []
    least = (b.size() or 0.0) * CORRIDOR
    found = [(a, z) for a, z in _gaps(b.lines[0]) if z - a >= least]
    for line in b.lines[1:]:
        if not found:
            break
        found = [(a, z) for a, z in _meet(found, _gaps(line)) if z - a >= least]  # a narrow one never widens
    return found


def repeated_margins(pages: list[Page]) -> set[tuple[str, str]]:
    """(margin, text) of running heads and feet: alike and level on pages that follow each other."""
    out: set[tuple[str, str]] = set()
    last: dict[tuple[str, str], tuple[int, float]] = {}
    at = {p.index for p in pages}
    if not any(i + 1 in at for i in at):
        return out
    for p in pages:
        for b in p.blocks:
            margin = margin_of(b, p.height)
            if margin is None or p.height <= 0:
                continue
            key = (margin, P.running_text(b.text))
            y = ((p.height - b.box.top) if margin == "header" else b.box.bottom) / p.height
            if key[1] and key in last and last[key][0] + 1 == p.index and abs(last[key][1] - y) <= REPEAT_Y:
                out.add(key)
            last[key] = (p.index, y)
    return out


def _nearest(b: Block, p: Page, above: bool) -> float:
    """Least gap to any other block, none below zero: a block on the other side gives zero."""
    return min((max(o.box.bottom - b.box.top if above else b.box.bottom - o.box.top, 0.0) for o in p.blocks if o is not b), default=math.inf)


def _room(b: Block, p: Page, above: bool) -> float:
    """Gap to the next block on that side only."""
    gaps = (o.box.bottom - b.box.top if above else b.box.bottom - o.box.top for o in p.blocks if o is not b and (o.box.bottom >= b.box.top if above else o.box.top <= b.box.bottom))
    return min(gaps, default=math.inf)


def _is_formula(b: Block, p: Page, size: float) -> bool:
    if p.width <= 0 or abs(b.box.center[0] - p.width / 2) > FORMULA_CENTER * p.width or b.box.width > FORMULA_WIDTH * p.width:
        return False
    if size > 0 and min(_room(b, p, True), _room(b, p, False)) < FORMULA_ALONE * size:
        return False
    return not P.ends_in(b.text, ".?!:") and P.is_mathematical(b.text)


def classify_block(b: Block, p: Page, body: float, bold_page: bool, repeated: str | None, seen_title: list[bool]) -> tuple[str, float]:
    """Class and confidence by the first rule that holds."""
    text, size, h = b.text, b.size() or 0.0, p.height
    short = len(b.lines) <= SHORT
    low = b.box.height <= MARGIN_HEIGHT * h
    if repeated:
        return f"page_{repeated}", 0.8
    if b.box.top >= HEADER * h and low and _nearest(b, p, False) >= MARGIN_GAP * h:
        return "page_header", 0.6
    if b.box.bottom <= FOOTER * h and low and _nearest(b, p, True) >= MARGIN_GAP * h:
        return "page_footer", 0.6
    if b.box.bottom <= FOOTNOTE_BAND * h and P.has_footnote_mark(text):
        rest = median_size(total(o.styles() for o in p.blocks if o is not b)) or 0.0
        if rest > 0 and size <= FOOTNOTE_SIZE * rest:
            return "footnote", 0.55
    if P.is_list_item(text):
        return "list_item", 0.7
    if P.is_caption(text) and short:
        return "caption", 0.6
    open_end = not P.ends_in(text, ".?!")
    if P.has_heading_number(text) and short and open_end and "   " not in text:
        return "section_header", 0.55
    if body > 0 and size >= HEADING_SIZE * body and short:
        if seen_title[0]:
            return "section_header", 0.6
        seen_title[0] = True
        return "title", 0.65
    if not bold_page and short and size >= body and open_end and bold_share_of(b.styles()) >= BOLD_SHARE:
        return "section_header", 0.55
    if _is_formula(b, p, size):
        return "formula", 0.5
    if len(b.lines) >= 2 and margin_of(b, h) is None and corridors(b):
        return "table", 0.5
    return "text", 0.5


def classify(pages: list[Page]) -> list[Region]:
    """Regions of a document: per page those of unclaimed blocks, then tables, pictures, open tables."""
    repeated, seen_title = repeated_margins(pages), [False]
    out: list[Region] = []
    for p in pages:
        styles = p.styles()
        body = median_size(styles) or 0.0
        bold = bold_share_of(styles) >= BOLD_SHARE
        tables, pics = ruled_tables(p), pictures(p)
        free = [b for b in p.blocks if not any(r.box.holds_center(b.box) for r in tables + pics)]
        loose = open_tables(free, p.height, p.index)
        for b in free:
            if any(r.box.holds_center(b.box) for r in loose):
                continue
            m = margin_of(b, p.height)
            again = m if m and repeated and (m, P.running_text(b.text)) in repeated else None
            kind, confidence = classify_block(b, p, body, bold, again, seen_title)
            out.append(Region(kind, b.box, confidence, p.index))
        out += tables + pics + loose
    return out
