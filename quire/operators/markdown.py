"""Pages and regions as Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import Block, Box, Page, Region
from . import regions as R

MATCH_IOU = 0.9
_BULLET = re.compile(r"[-*•] ")


@dataclass(frozen=True)
class Options:
    page_breaks: bool = True
    image_placeholders: bool = True
    #: The sort by height undoes column order, and graphics are lost on the way; both are the reference behaviour.
    sort_by_top: bool = True
    drop_graphics: bool = True


def plain(pages: list[Page]) -> str:
    return "\n\n---\n\n".join("\n\n".join(b.text for b in p.blocks) for p in pages)


def raw_text(pages: list[Page]) -> str:
    return "\n\n".join("\n\n".join(b.text for b in p.blocks) for p in pages)


def iou(a: Box, b: Box) -> float:
    w, h = min(a.right, b.right) - max(a.left, b.left), min(a.top, b.top) - max(a.bottom, b.bottom)
    both = max(w, 0.0) * max(h, 0.0)
    all_ = a.area + b.area - both
    return both / all_ if all_ > 0 else 0.0


def giou(a: Box, b: Box) -> float:
    around = Box(min(a.left, b.left), min(a.bottom, b.bottom), max(a.right, b.right), max(a.top, b.top)).area
    w, h = min(a.right, b.right) - max(a.left, b.left), min(a.top, b.top) - max(a.bottom, b.bottom)
    both = max(w, 0.0) * max(h, 0.0)
    all_ = a.area + b.area - both
    return 0.0 if around <= 0 else (both / all_ if all_ > 0 else 0.0) - (around - all_) / around


def region_of(b: Block, rs: list[Region]) -> Region | None:
    """The first region of the very same box, else the last of the best overlaps of 0.9 or more."""
    rs = [r for r in rs if r.kind not in ("table", "picture")]
    for r in rs:
        if r.box == b.box:
            return r
    best, most = None, MATCH_IOU
    for r in rs:
        if (x := iou(r.box, b.box)) >= most:
            best, most = r, x
    return best


def gfm(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in r) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join("---" for _ in rows[0]) + " |", *map(line, rows[1:])]) if rows else ""


def open_rows(bs: list[Block]) -> list[list[str]]:
    """Rows of a table without rules: a lone block by its corridors, else bands of blocks."""
    if len(bs) == 1 and (gaps := R.corridors(bs[0])):
        out = []
        for line in bs[0].lines:
            cells: list[list[str]] = [[] for _ in range(len(gaps) + 1)]
            for a, z, text in R.line_tokens(line):
                cells[sum(hi <= (a + z) / 2 for _, hi in gaps)].append(text)
            out.append([" ".join(c) for c in cells])
        return out
    rows = sorted(R.bands(bs), key=lambda r: -max(b.box.top for b in r))
    return [[b.text.replace("\n", "<br>") for b in sorted(r, key=lambda b: b.box.left)] for r in rows]


def block_markdown(b: Block, rs: list[Region]) -> str | None:
    r = region_of(b, rs)
    kind, text = r.kind if r else "text", b.text
    if kind in ("page_header", "page_footer"):
        return None
    if kind == "title":
        return f"# {text}"
    if kind == "section_header":
        return f"## {text}"
    if kind == "list_item":
        return "\n".join(f"- {_BULLET.sub('', line.text.lstrip(), count=1)}" if _BULLET.match(line.text.lstrip()) else f"- {line.text.lstrip()}" for line in b.lines)
    if kind == "caption":
        return f"*{text}*"
    if kind == "footnote":
        first = (text.split() or [""])[0]
        return f"[^{first if len(first.encode()) <= 3 else text}]: {text}"
    return text


def page_markdown(p: Page, rs: list[Region], graphics=(), o: Options = Options()) -> str:
    rs = [r for r in rs if r.page == p.index]
    tables, pics = [r for r in rs if r.kind == "table"], [r for r in rs if r.kind == "picture"]
    items: list[tuple[float, str]] = []
    done = set()
    for b in p.blocks:
        k = next((i for i, r in enumerate(tables) if r.box.holds_center(b.box)), None)
        if k is not None:
            if k not in done:
                done.add(k)
                box = tables[k].box
                rows = R.grid_cells(box, graphics, p.blocks) or open_rows([x for x in p.blocks if box.holds_center(x.box)])
                items.append((box.top, gfm(rows)))
        elif not any(r.box.holds_center(b.box) for r in pics):
            text = block_markdown(b, rs)
            if text is not None:
                items.append((b.box.top, text))
    if o.image_placeholders:
        items += [(r.box.top, "![]()") for r in pics]
    if o.sort_by_top:
        items.sort(key=lambda x: -x[0])
    return "\n\n".join(t for _, t in items)


def structured(pages: list[Page], rs: list[Region], o: Options = Options(), graphics: dict[int, list] | None = None) -> str:
    by: dict[int, list[Region]] = {}
    for r in rs:
        by.setdefault(r.page, []).append(r)
    parts = [page_markdown(p, by.get(p.index, []), (graphics or {}).get(p.index, p.graphics), o) for p in pages]
    return "\n\n---\n\n".join(parts) if o.page_breaks else "\n\n".join(x for x in parts if x)
