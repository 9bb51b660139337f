"""Characters to words, lines and blocks; style breaks; rotated runs."""

from __future__ import annotations

from ..model import Block, Box, Char, Line, Word, hull, median_size, upper_median
from .style import BOLD_SHARE, bold_share_of

WORD_GAP = 0.28
BASELINE = 0.2
SCRIPT_SIZE, SCRIPT_OFFSET, SCRIPT_GAP = 0.8, 0.15, 0.75
LINE_Y, LINE_RATIO = 0.45, 2.0
BLOCK_GAP, BLOCK_OVERLAP, BLOCK_GUTTER = 1.5, 0.5, 1.0
STYLE_RATIO = 1.15
RUN_LINES, RUN_CHARS, RUN_WIDTH, RUN_HEIGHT = 3, 2, 1.5, 1.0
RUN_ALIGN, RUN_ABUT, RUN_GAP, RUN_SHARE = 0.25, 0.05, 0.40, 0.5


def _script(prev: Char, c: Char) -> bool:
    """Whether ``c`` is a sub- or superscript set on to ``prev``."""
    base = max(prev.size, 1.0)
    rise = abs(c.box.bottom - prev.box.bottom)
    return c.size <= base * SCRIPT_SIZE and c.box.beside(prev.box) and rise > max(base, c.size) * SCRIPT_OFFSET and c.box.left - prev.box.right <= base * SCRIPT_GAP


def _word(chars: list[Char]) -> Word:
    return Word("".join(c.text for c in chars if c.text is not None), hull(c.box for c in chars), chars)


def words(chars) -> list[Word]:
    """Words in stream order. White space ends a word and still is the next one's predecessor."""
    out: list[Word] = []
    run: list[Char] = []
    prev = None
    for c in chars:
        cut = space = c.text is not None and c.text.isspace()
        if prev is not None and not cut:
            a, b = prev.box, c.box
            # level and touching, as most are, needs no closer look
            if a.bottom != b.bottom or b.left > a.right:
                em = max(c.size, prev.size, 1.0)
                cut = (abs(b.bottom - a.bottom) > em * BASELINE or b.left - a.right > em * WORD_GAP) and not _script(prev, c)
        if cut and run:
            out.append(_word(run))
            run = []
        if not space:
            run.append(c)
        prev = c
    if run:
        out.append(_word(run))
    return out


def lines(ws: list[Word]) -> list[Line]:
    """A word joins the last line if it is level with that line's first word and of like size."""
    groups: list[list[Word]] = []
    for w in ws:
        if groups:
            anchor = groups[-1][0]
            big, small = max(w.size, anchor.size), min(w.size, anchor.size)
            if abs(w.box.center[1] - anchor.box.center[1]) <= max(big, 1.0) * LINE_Y and big / max(small, 1.0) <= LINE_RATIO:
                groups[-1].append(w)
                continue
        groups.append([w])
    out = []
    for g in groups:
        g = sorted(g, key=lambda w: w.box.left)
        out.append(Line(" ".join(w.text for w in g), hull(w.box for w in g), g))
    return out


def blocks(ls: list[Line]) -> list[Block]:
    """A line joins the last block if it follows closely below and within its columns."""
    out: list[Block] = []
    for line in ls:
        if out:
            last, around = out[-1].lines[-1].box, out[-1].box
            short = max(min(last.height, line.box.height), 1.0)
            shared = max(min(last.top, line.box.top) - max(last.bottom, line.box.bottom), 0.0)
            gutter = max(max(around.left, line.box.left) - min(around.right, line.box.right), 0.0)
            if last.bottom - line.box.top <= short * BLOCK_GAP and shared <= short * BLOCK_OVERLAP and gutter <= short * BLOCK_GUTTER:
                out[-1].lines.append(line)
                out[-1].box = hull((around, line.box))
                continue
        out.append(Block(line.box, [line]))
    return out


def group(chars) -> list[Block]:
    return blocks(lines(words(chars)))


def split_styles(bs: list[Block]) -> list[Block]:
    """Blocks cut where the size jumps or boldness changes from one line to the next."""
    out = []
    for b in bs:
        if len(b.lines) < 2:
            out.append(b)
            continue
        styles = []
        for line in b.lines:
            own = line.styles()
            styles.append((median_size(own) or 0.0, bold_share_of(own) >= BOLD_SHARE))
        parts = [[b.lines[0]]]
        for line, (x, p), (y, q) in zip(b.lines[1:], styles, styles[1:]):
            cut = p != q or (x > 0 and y > 0 and max(x / y, y / x) >= STYLE_RATIO)
            parts.append([line]) if cut else parts[-1].append(line)
        out += [b] if len(parts) < 2 else [Block(hull(x.box for x in p), p) for p in parts]
    return out


def _glyph_em(line: Line) -> float | None:
    """The em of a line that could be one glyph of text set vertically."""
    if not 1 <= len(line.text) <= RUN_CHARS or any(c.isspace() for c in line.text):
        return None
    em = line.words[0].size if line.words else 0.0
    return em if em > 0 and line.box.width <= RUN_WIDTH * em and line.box.height <= RUN_HEIGHT * em else None


def _run_gaps(run: list[Line], em: float) -> list[float] | None:
    tol = RUN_ALIGN * em
    if any(abs(x.box.left - run[0].box.left) > tol or abs(x.box.right - run[0].box.right) > tol for x in run):
        return None
    up = run[1].box.bottom > run[0].box.bottom
    gaps = []
    for a, b in zip(run, run[1:]):
        if (b.box.bottom > a.box.bottom) != up:
            return None
        gap = b.box.bottom - a.box.top if up else a.box.bottom - b.box.top
        if not -RUN_ABUT * em <= gap <= RUN_GAP * em:
            return None
        gaps.append(gap)
    return gaps if sum(abs(g) <= RUN_ABUT * em for g in gaps) / len(gaps) > RUN_SHARE else None


def _merge_run(run: list[Line], gaps: list[float], em: float) -> Line:
    parts = [[run[0]]]
    for line, gap in zip(run[1:], gaps):
        parts.append([line]) if abs(gap) > RUN_ABUT * em else parts[-1].append(line)
    ws = [Word("".join(x.text for x in p), hull(x.box for x in p), [c for x in p for c in x.chars()]) for p in parts]
    return Line(" ".join(w.text for w in ws), hull(x.box for x in run), ws)


def merge_rotated(bs: list[Block]) -> list[Block]:
    """Join lines that are the single glyphs of text set upwards or downwards.

    Where a streak of such lines isn't one run, its first line is let go and the rest tried
    again.
    """
    out = []
    for b in bs:
        kept: list[Line] = []
        ems = [_glyph_em(x) for x in b.lines]
        i = 0
        while i < len(b.lines):
            j = i
            while j < len(b.lines) and ems[j] is not None:
                j += 1
            if j - i >= RUN_LINES:
                em = upper_median(ems[i:j])
                gaps = _run_gaps(b.lines[i:j], em)
                if gaps is not None:
                    kept.append(_merge_run(b.lines[i:j], gaps, em))
                    i = j
                    continue
            kept.append(b.lines[i])
            i += 1
        out.append(Block(b.box, kept))
    return out


def typeset(text: str, size: float = 10.0, left: float = 72.0, top: float = 740.0, advance: float = 0.6, leading: float = 1.4) -> list[Char]:
    """Characters of a text in a fixed-width face, line under line: for tests and examples."""
    out = []
    for k, row in enumerate(text.split("\n")):
        y = top - k * leading * size
        out += [Char(c, Box(left + i * advance * size, y - size, left + (i + 1) * advance * size, y), "Fixed", size) for i, c in enumerate(row)]
    return out
