"""Reading order by recursive cuts, and paragraphs stitched over page breaks."""

from __future__ import annotations

from ..model import Block, Line, Page, hull, median_size
from . import phrases as P
from .grouping import merge_rotated

CUT, GUTTER_EM, GUTTER_PT = 0.03, 0.8, 2.0
OVERLAY_RATIO, OVERLAY_SHARE = 2.0, 0.5
STITCH_EM, STITCH_PT, STITCH_SIZE, STITCH_EDGE = 1.0, 3.0, 0.15, 0.5


def least_gutter(p: Page) -> float:
    most = p.width * CUT
    em = median_size(p.styles())
    return most if em is None else min(max(GUTTER_EM * em, min(GUTTER_PT, most)), most)


def _gaps(spans) -> list[tuple[float, float]]:
    """(end of a stretch, gap behind it) between the merged spans."""
    out, end = [], None
    for a, z in sorted(spans, key=lambda s: s[0]):
        if end is not None and a > end:
            out.append((end, a - end))
        end = z if end is None else max(end, z)
    return out


def _widest(gaps) -> float | None:
    """Middle of the widest gap, of equal ones the last."""
    best = None
    for at, gap in gaps:
        if best is None or gap >= best[1]:
            best = (at, gap)
    return None if best is None else best[0] + best[1] / 2


def _abreast(bs: list[Block], x: float) -> bool:
    """Whether what lies left and right of ``x`` shares some height."""
    left = [b.box for b in bs if b.box.right <= x]
    right = [b.box for b in bs if b.box.right > x and b.box.left >= x]
    return bool(left and right) and hull(left).beside(hull(right))


def vertical_cut(bs: list[Block], least: float) -> float | None:
    return _widest((at, gap) for at, gap in _gaps((b.box.left, b.box.right) for b in bs) if gap >= least and _abreast(bs, at))


def horizontal_cut(bs: list[Block], height: float) -> float | None:
    return _widest((at, gap) for at, gap in _gaps((b.box.bottom, b.box.top) for b in bs) if gap >= height * CUT)


def overlays(a: Block, b: Block) -> bool:
    """Whether ``a`` is set over ``b`` in much larger type, as a watermark is."""
    x, y = a.size(), b.size()
    if x is None or y is None or x < y * OVERLAY_RATIO:
        return False
    w = max(min(a.box.right, b.box.right) - max(a.box.left, b.box.left), 0.0)
    h = max(min(a.box.top, b.box.top) - max(a.box.bottom, b.box.bottom), 0.0)
    return w * h > 0 and w * h / max(min(a.box.area, b.box.area), 1.0) >= OVERLAY_SHARE


def xy_cut(bs: list[Block], gutter: float, height: float) -> list[Block]:
    """Blocks in reading order: columns first, then stretches of the page, then from the top."""
    if len(bs) < 2:
        return bs
    x = vertical_cut(bs, gutter)
    if x is not None:
        first, rest = [b for b in bs if b.box.center[0] < x], [b for b in bs if b.box.center[0] >= x]
    else:
        y = horizontal_cut(bs, height)
        if y is None:
            over = {id(a): any(a is not b and overlays(a, b) for b in bs) for a in bs}
            return sorted(bs, key=lambda b: (over[id(b)], -b.box.top, b.box.left))
        first, rest = [b for b in bs if b.box.center[1] >= y], [b for b in bs if b.box.center[1] < y]
    if not first or not rest:
        return sorted(bs, key=lambda b: (-b.box.top, b.box.left))
    return xy_cut(first, gutter, height) + xy_cut(rest, gutter, height)


def goes_on(tail_page: Page, tail: Block, head_page: Page, head: Block) -> bool:
    """Whether ``head``, first on its page, continues ``tail``, last on an earlier one."""
    if not tail.lines or not head.lines:
        return False
    if tail.box.bottom > min(b.box.bottom for b in tail_page.blocks) + STITCH_EDGE or head.box.top < max(b.box.top for b in head_page.blocks) - STITCH_EDGE:
        return False
    a, b = tail.size(), head.size()
    em = next((s for s in (a, b) if s is not None), 12.0)
    if abs(tail.box.left - head.box.left) > max(STITCH_EM * em, STITCH_PT):
        return False
    if a is not None and b is not None and abs(a - b) / max(a, b, 1e-7) > STITCH_SIZE:
        return False
    start = head.lines[0].text.lstrip()
    return not P.ends_in(tail.lines[-1].text, ".!?:;\"')»”") and start[:1].islower()


def _stitched(tail: Block, head: Block) -> Block:
    a, b = tail.lines[-1], head.lines[0]
    seam = Line(P.join_hyphenated(a.text, b.text), a.box, a.words + b.words)
    return Block(tail.box, [*tail.lines[:-1], seam, *head.lines[1:]])


def stitch(pages: list[Page]) -> list[Page]:
    pages = [p.with_blocks(list(p.blocks)) for p in pages]
    at = 0
    for k in range(1, len(pages)):
        left, right = pages[at], pages[k]
        if left.blocks and right.blocks and goes_on(left, left.blocks[-1], right, right.blocks[0]):
            left.blocks[-1] = _stitched(left.blocks[-1], right.blocks.pop(0))
        else:
            at = k
    return pages


def assemble(pages: list[Page], keep_graphics: bool = False) -> list[Page]:
    """Pages with their blocks in reading order and sentences joined over page breaks.

    Graphics don't come along unless asked for.
    """
    ordered = []
    for p in pages:
        bs = xy_cut(merge_rotated(p.blocks), least_gutter(p), p.height)
        ordered.append(Page(p.index, p.width, p.height, bs, p.graphics if keep_graphics else []))
    return stitch(ordered)
