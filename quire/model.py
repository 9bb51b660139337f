"""Positioned page content: plain records for the per-document steps, and Spark schemas."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import types as T


class Box(NamedTuple):
    """A box in points, origin at the page's lower left, y upwards."""

    left: float
    bottom: float
    right: float
    top: float

    @property
    def width(self) -> float:
        return max(self.right - self.left, 0.0)

    @property
    def height(self) -> float:
        return max(self.top - self.bottom, 0.0)

    @property
    def area(self) -> float:
        return self.width * self.height

    @property
    def center(self) -> tuple[float, float]:
        return (self.left + self.right) / 2, (self.bottom + self.top) / 2

    def holds_center(self, other: Box) -> bool:
        x, y = other.center
        return self.left <= x <= self.right and self.bottom <= y <= self.top

    def beside(self, other: Box) -> bool:
        """Whether the vertical extents overlap (more than touch)."""
        return self.bottom < other.top and other.bottom < self.top


ZERO = Box(0.0, 0.0, 0.0, 0.0)


def hull(boxes) -> Box:
    """The smallest box around all; the zero box for none."""
    boxes = list(boxes)
    if not boxes:
        return ZERO
    ls, bs, rs, ts = zip(*boxes)
    return Box(min(ls), min(bs), max(rs), max(ts))


def upper_median(values) -> float | None:
    """The middle value, of two the larger; None for none."""
    v = sorted(values)  # linear where all are equal, as they mostly are
    return v[len(v) // 2] if v else None


def median_size(styles: Counter) -> float | None:
    """The upper median of the sizes of characters counted by style."""
    left = sum(styles.values()) // 2
    for (size, *_), n in sorted(styles.items(), key=lambda s: s[0][0]):
        if left < n:
            return size
        left -= n
    return None


def total(counts) -> Counter:
    out: Counter = Counter()
    for c in counts:
        for k, n in c.items():
            out[k] += n
    return out


class Char(NamedTuple):
    text: str | None
    box: Box
    font: str = ""
    size: float = 0.0
    weight: int | None = None
    angle: float = 0.0


@dataclass
class Word:
    text: str
    box: Box
    chars: list[Char] = field(default_factory=list)

    @property
    def size(self) -> float:
        return self.chars[0].size if self.chars else 0.0


@dataclass
class Line:
    text: str
    box: Box
    words: list[Word] = field(default_factory=list)

    def chars(self):
        return [c for w in self.words for c in w.chars]

    def extents(self) -> list[tuple[float, float, str]]:
        """Left and right ends and texts of the words."""
        return [(w.box.left, w.box.right, w.text) for w in self.words]

    def styles(self) -> Counter:
        """How many characters there are of every size, weight and font."""
        return Counter([(c.size, c.weight, c.font) for w in self.words for c in w.chars])


@dataclass
class Block:
    box: Box
    lines: list[Line] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join(line.text for line in self.lines)

    def chars(self):
        return [c for line in self.lines for c in line.chars()]

    def styles(self) -> Counter:
        return self.lines[0].styles() if len(self.lines) == 1 else total(line.styles() for line in self.lines)

    def size(self) -> float | None:
        return median_size(self.styles())


class Graphic(NamedTuple):
    kind: str  # stroke, fill, image or shading
    box: Box
    z: int = 0
    stroke_width: float = 1.0
    stroked: bool = True
    filled: bool = False


@dataclass
class Page:
    index: int
    width: float
    height: float
    blocks: list[Block] = field(default_factory=list)
    graphics: list[Graphic] = field(default_factory=list)

    def chars(self):
        return [c for b in self.blocks for c in b.chars()]

    def styles(self) -> Counter:
        return total(b.styles() for b in self.blocks)

    def with_blocks(self, blocks: list[Block]) -> Page:
        return replace(self, blocks=blocks)


class Region(NamedTuple):
    kind: str
    box: Box
    confidence: float
    page: int


#: The region classes, in sort order.
CLASSES = ("caption", "footnote", "formula", "list_item", "page_footer", "page_header", "picture", "section_header", "table", "text", "title")

_F = T.FloatType()
BOX_COLUMNS = [T.StructField(n, _F) for n in ("left", "bottom", "right", "top")]
CHARS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ch", T.StringType()),
        *BOX_COLUMNS,
        T.StructField("font", T.StringType()),
        T.StructField("size", _F),
        T.StructField("weight", T.IntegerType()),
        T.StructField("angle", _F),
    ]
)
GRAPHICS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("z", T.IntegerType()), T.StructField("kind", T.StringType()), *BOX_COLUMNS, T.StructField("stroke_width", _F), T.StructField("stroked", T.BooleanType()), T.StructField("filled", T.BooleanType())])
PAGES = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("width", _F), T.StructField("height", _F)])
BLOCKS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), *BOX_COLUMNS, T.StructField("size", _F)])
REGIONS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("region", T.IntegerType()), T.StructField("class", T.StringType()), *BOX_COLUMNS, T.StructField("confidence", _F)])
MARKDOWN = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())])
