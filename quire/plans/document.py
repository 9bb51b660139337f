"""From character and graphic tables to blocks, regions and Markdown.

All tables are keyed by document and page. The steps that follow one another within a page or
document run in one Arrow call over whole documents, so that a corpus is shuffled once, on
``doc_id``, and its characters are handled by the column; every result is a table again. A document that can't be processed gives an error
row, not a failed job.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BLOCKS, MARKDOWN, REGIONS, Box, Char, Graphic, Page
from ..operators import grouping, markdown, packed, reading_order, regions

CHAR_COLUMNS = ("page", "seq", "ch", "left", "bottom", "right", "top", "font", "size", "weight", "angle")
#: Runs of characters set in one face on one line: the k-th stands ``k * advance * size`` to the right of ``left`` and is ``advance * size`` wide.
RUN_COLUMNS = ("page", "seq", "text", "left", "bottom", "top", "advance", "font", "size", "weight", "angle")
GRAPHIC_COLUMNS = ("page", "z", "kind", "left", "bottom", "right", "top", "stroke_width", "stroked", "filled")
PAGE_COLUMNS = ("page", "width", "height")
#: Characters that are laid out together; a longer document is alone.
CHUNK = 300_000
_ERROR = T.StructField("error", T.StringType())
_TABLES = {"blocks": T.StructType([*BLOCKS, _ERROR]), "regions": T.StructType([*REGIONS, _ERROR]), "markdown": MARKDOWN}


def pages_from_columns(chars: dict[str, list], graphics: dict[str, list], pages: dict[str, list]) -> list[Page]:
    """Pages with grouped blocks from the columns of one document; carriage returns and line feeds are dropped.

    Coordinates must be numbers; a page that only characters or graphics mention is US Letter.
    """
    for c in ("left", "bottom", "right", "top"):
        column = chars[c]
        if None in column or math.isnan(sum(column)):
            k = next(i for i, v in enumerate(column) if v is None or v != v or math.isinf(v))
            raise ValueError(f"character {chars['seq'][k]} of page {chars['page'][k]} has no box")
    boxes = map(Box, *(chars[c] for c in ("left", "bottom", "right", "top")))
    made = list(map(Char, chars["ch"], boxes, [f or "" for f in chars["font"]], [s or 0.0 for s in chars["size"]], chars["weight"], [a or 0.0 for a in chars["angle"]]))
    seq, page_of = chars["seq"], chars["page"]
    by: dict[int, list[Char]] = defaultdict(list)
    for k in sorted(range(len(seq)), key=seq.__getitem__):
        c = made[k]
        if c.text != "\n" and c.text != "\r":
            by[page_of[k]].append(c)
    return _pages({i: grouping.group(cs) for i, cs in by.items()}, graphics, pages)


def _pages(blocks: dict[int, list], graphics: dict[str, list], pages: dict[str, list]) -> list[Page]:
    drawn: dict[int, list[Graphic]] = defaultdict(list)
    for page, z, kind, left, bottom, right, top, stroke, stroked, filled in zip(*(graphics[c] for c in GRAPHIC_COLUMNS)):
        drawn[page].append(Graphic(kind, Box(left, bottom, right, top), z, 1.0 if stroke is None else stroke, stroked is not False, bool(filled)))
    size = {p: (w, h) for p, w, h in zip(*(pages[c] for c in PAGE_COLUMNS))}
    out = []
    for i in sorted({*blocks, *drawn, *size}):
        out.append(Page(i, *size.get(i, (612.0, 792.0)), blocks.get(i, []), sorted(drawn[i], key=lambda g: g.z)))
    return out


def _styles(t: pa.Table, size: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Number and list of the kinds of size, weight and font of a table's rows."""
    font, weight = t.column("font"), t.column("weight")
    if font.null_count == len(font) and weight.null_count == len(weight):
        kinds, code = np.unique(size, return_inverse=True)
        return code, [(s, None, "") for s in kinds.tolist()]
    fonts, weights = font.combine_chunks().dictionary_encode(), weight.combine_chunks().dictionary_encode()
    names, heavy = fonts.dictionary.to_pylist(), weights.dictionary.to_pylist()
    kinds, s = np.unique(size, return_inverse=True)
    f, w = (np.asarray(pc.fill_null(x.indices, len(x.dictionary))).astype(np.int64) for x in (fonts, weights))
    some, code = np.unique((s * (len(names) + 1) + f) * (len(heavy) + 1) + w, return_inverse=True)
    names, heavy = [x or "" for x in names] + [""], heavy + [None]
    of = lambda k: (float(kinds[k // len(heavy) // len(names)]), heavy[k % len(heavy)], names[k // len(heavy) % len(names)])
    return code, [of(k) for k in some.tolist()]


def _number(t: pa.Table, name: str, null: float | None = None) -> np.ndarray | None:
    """A column as numbers of double precision; none if it isn't finite throughout."""
    c = t.column(name)
    if c.null_count and null is None:
        return None
    out = np.asarray(pc.fill_null(c, null) if c.null_count else c).astype(np.float64)
    return out if np.isfinite(out).all() else None


def _keys(t: pa.Table, number: np.ndarray) -> np.ndarray:
    return (number.astype(np.int64) << 32) + (np.asarray(t.column("page")).astype(np.int64) + (1 << 31))


def _packed_chars(t: pa.Table, number: np.ndarray) -> packed.Packed | None:
    """The characters of a table in columns, their pages keyed by document; none if they must be looked at one by one."""
    boxes = [_number(t, c) for c in ("left", "bottom", "right", "top")]
    size, angle, ch = _number(t, "size", 0.0), _number(t, "angle", 0.0), t.column("ch")
    if any(c is None for c in (*boxes, size, angle)) or any(t.column(c).null_count for c in ("page", "seq", "ch")):
        return None
    text = "".join(_list(ch))
    if len(text) != len(ch) or not pc.all(pc.equal(pc.utf8_length(ch), 1)).as_py():
        return None
    return packed.Packed(text, _keys(t, number), np.asarray(t.column("seq")), *boxes, size, *_styles(t, size), angle)


def _packed_runs(t: pa.Table, number: np.ndarray) -> packed.Packed:
    texts = _list(t.column("text"))
    lengths = np.array([len(x) for x in texts])
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    every = lambda c: np.repeat(c, lengths)
    single = lambda c: c.astype(np.float32).astype(np.float64)
    numbers = [_number(t, c) for c in ("left", "bottom", "top", "advance", "size", "angle")]
    if any(c is None for c in numbers) or any(t.column(c).null_count for c in ("page", "seq", "text")):
        raise ValueError("a run of characters lacks a place or a size")
    left, bottom, top, advance, size, angle = numbers
    code, styles = _styles(t, size)
    left = every(left) + place * every(advance) * every(size)
    right = left + every(advance * size)
    return packed.Packed("".join(texts), every(_keys(t, number)), every(np.asarray(t.column("seq"))) + place, single(left), every(bottom), single(right), every(top), every(size), every(code), styles, every(angle))


def pages_from_rows(chars: list[dict], graphics: list[dict], pages: list[dict]) -> list[Page]:
    """The same from rows."""
    columns = lambda rows, names: {n: [r[n] for r in rows] for n in names}
    return pages_from_columns(columns(chars, CHAR_COLUMNS), columns(graphics, GRAPHIC_COLUMNS), columns(pages, PAGE_COLUMNS))


def _list(column: pa.ChunkedArray) -> list:
    """A column as Python values, by way of numpy, which is many times as fast as value by value."""
    if column.null_count == len(column):
        return [None] * len(column)
    kind = column.type
    if column.null_count and not pa.types.is_string(kind):
        return column.to_pylist()
    if pa.types.is_string(kind) or pa.types.is_integer(kind) or pa.types.is_floating(kind):
        return column.to_numpy().tolist()
    return column.to_pylist()


def split_styles(pages: list[Page]) -> list[Page]:
    return [p.with_blocks(grouping.split_styles(p.blocks)) for p in pages]


def to_markdown(pages: list[Page], options: markdown.Options = markdown.Options()) -> str:
    """Style split, classification, reading order, Markdown."""
    split = split_styles(pages)
    found = regions.classify(split)
    done = reading_order.assemble(split, keep_graphics=not options.drop_graphics)
    return markdown.structured(done, found, options)


def _block_rows(doc: str, pages: list[Page]) -> list[tuple]:
    return [(doc, p.index, i, b.text, len(b.lines), *b.box, b.size(), None) for p in pages for i, b in enumerate(p.blocks)]


def _region_rows(doc: str, pages: list[Page]) -> list[tuple]:
    out, seen = [], defaultdict(int)
    for r in regions.classify(split_styles(pages)):
        out.append((doc, r.page, seen[r.page], r.kind, *r.box, r.confidence, None))
        seen[r.page] += 1
    return out


def _arrow(schema) -> pa.Schema:
    kinds = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema])


def _run(chars: DataFrame, graphics: DataFrame | None, pages: DataFrame | None, kind: str, make: Callable[[str, list[Page]], list[tuple]], failed: Callable[[str, str], list[tuple]] | None = None) -> DataFrame:
    """Whole documents, many to a call, over all their rows, which arrive in one shuffle.

    The three tables are laid in one with flat columns, told apart by ``what``; columns that
    a table lacks are null there and cost next to nothing. The number of partitions is fixed, as it
    is the work on them that counts, not their bytes.
    """
    runs = "text" in chars.columns
    char_columns = RUN_COLUMNS if runs else CHAR_COLUMNS
    rows = None
    for what, df, names in ((0, chars, char_columns), (1, graphics, GRAPHIC_COLUMNS), (2, pages, PAGE_COLUMNS)):
        if df is not None:
            df = df.select("doc_id", F.lit(what).cast("tinyint").alias("what"), *names)
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    schema = _arrow(_TABLES[kind])
    several = graphics is not None or pages is not None

    def packed_blocks(t: pa.Table, number: np.ndarray) -> dict[int, dict[int, list]] | None:
        """Blocks by number of the document and page; none if some characters must be looked at one by one."""
        found = (_packed_runs if runs else _packed_chars)(t, number)
        if found is None:
            return None
        out: dict[int, dict[int, list]] = defaultdict(dict)
        for key, blocks in found.blocks().items():
            out[key >> 32][(key & 0xFFFFFFFF) - (1 << 31)] = blocks
        return out

    def documents(t: pa.Table, bounds: list[int]) -> list[tuple]:
        """Result rows of the documents that lie between the bounds."""
        number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        own = [t, None, None]
        if several:
            own = [t.filter(pc.equal(t.column("what"), what)) for what in range(3)]
            number = number[np.asarray(t.column("what")) == 0]
        try:
            blocks = packed_blocks(own[0], number)
        except Exception:  # which of them is at fault shows below
            blocks = None
        columns = lambda x, names: {n: _list(x.column(n)) if x is not None and n in x.column_names else [] for n in names}
        out = []
        for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
            doc, parts = t.column("doc_id")[a].as_py(), own
            if several or blocks is None:
                part = t.slice(a, z - a)
                parts = [part.filter(pc.equal(part.column("what"), what)) for what in range(3)] if several else [part, None, None]
            try:
                others = columns(parts[1], GRAPHIC_COLUMNS), columns(parts[2], PAGE_COLUMNS)
                if blocks is not None:
                    made = _pages(blocks.get(k, {}), *others)
                elif (alone := packed_blocks(parts[0], np.zeros(parts[0].num_rows, np.int64))) is not None:
                    made = _pages(alone.get(0, {}), *others)
                else:
                    made = pages_from_columns(columns(parts[0], CHAR_COLUMNS), *others)
                out += make(doc, made)
            except Exception as e:  # one bad document must not end the job
                error = f"{type(e).__name__}: {e}"
                out += failed(doc, error) if failed else [(doc, *[None] * (len(schema) - 2), error)]
        return out

    def call(batches):
        kept: list[pa.RecordBatch] = []
        rows_kept, enough = 0, 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                kept.append(b)
                rows_kept += b.num_rows
                if rows_kept < enough:
                    continue
            if not rows_kept:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            ids = np.asarray(t.column("doc_id").combine_chunks().dictionary_encode("encode").indices)
            bounds = [0, *(1 + np.flatnonzero(ids[1:] != ids[:-1])).tolist(), t.num_rows]
            if b is not None:  # the last document may go on
                bounds.pop()
                # a long one is looked at again only when there is twice as much of it
                enough = 2 * (t.num_rows - bounds[-1])
            rest = t.slice(bounds[-1])
            kept, rows_kept = rest.to_batches(), rest.num_rows
            size = np.cumsum([0, *(pc.fill_null(pc.utf8_length(t.column("text")), 0).to_pylist() if runs else np.ones(t.num_rows, np.int64))])
            at = 0
            for k in range(1, len(bounds)):
                if k == len(bounds) - 1 or size[bounds[k + 1]] - size[bounds[at]] > CHUNK:
                    part = t.slice(bounds[at], bounds[k] - bounds[at])
                    out = documents(part, [x - bounds[at] for x in bounds[at : k + 1]])
                    at = k
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "doc_id").sortWithinPartitions("doc_id", "what").mapInArrow(call, _TABLES[kind])


def blocks_table(chars: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Blocks in stream order, as grouped from characters; for a document that fails one row with an error and nothing else."""
    return _run(chars, None, pages, "blocks", _block_rows)


def ordered_blocks_table(chars: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Style-split blocks in reading order, stitched over page breaks; errors as in :func:`blocks_table`."""
    return _run(chars, None, pages, "blocks", lambda d, ps: _block_rows(d, reading_order.assemble(split_styles(ps))))


def regions_table(chars: DataFrame, graphics: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Classified regions of every page; errors as in :func:`blocks_table`."""
    return _run(chars, graphics, pages, "regions", _region_rows)


def markdown_table(chars: DataFrame, graphics: DataFrame | None = None, pages: DataFrame | None = None, options: markdown.Options = markdown.Options()) -> DataFrame:
    """Markdown of every document; an empty one and an error for a document that fails."""
    return _run(chars, graphics, pages, "markdown", lambda d, ps: [(d, to_markdown(ps, options), None)], lambda d, e: [(d, "", e)])


def whole(found: DataFrame) -> DataFrame:
    """A table without its column of errors, for those that have no place for one: it stops at the first error."""
    stop = F.raise_error(F.concat(F.lit("document "), F.coalesce("doc_id", F.lit("without a name")), F.lit(": "), "error")).cast("boolean")
    return found.where(F.when(F.col("error").isNull(), True).otherwise(stop)).drop("error")


def typeset_runs(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = 50, size: float = 10.0) -> DataFrame:
    """The same characters as of :func:`typeset_chars`, in runs of one line each: every table function takes either."""
    rows = texts.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("k", "text")).where("text <> ''")
    top = F.lit(740.0) - (F.col("k") % per_page) * 1.4 * size
    real = {"left": F.lit(72.0), "bottom": (top - size).cast("float"), "top": top.cast("float"), "advance": F.lit(0.6), "size": F.lit(size).cast("float"), "angle": F.lit(0.0).cast("float")}
    return rows.select("doc_id", F.floor(F.col("k") / per_page).cast("int").alias("page"), (F.col("k").cast("bigint") * (1 << 32)).alias("seq"), "text", *(c.alias(n) for n, c in real.items()), F.lit("Fixed").alias("font"), F.lit(None).cast("int").alias("weight"))


def typeset_chars(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = 50, size: float = 10.0) -> DataFrame:
    """A character table of plain texts set in a fixed-width face, ``per_page`` lines to a page.

    The texts are shuffled by document, so that their characters, fifty times as large, needn't be
    for the steps that follow. The number of partitions is fixed, as it is the work on them that
    counts, not their bytes.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).repartition(partitions, "doc_id")
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    chars = rows.select("doc_id", "k", F.posexplode(F.split("line", "")).alias("i", "ch")).where("ch <> ''")
    left, top = F.lit(72.0) + F.col("i") * 0.6 * size, F.lit(740.0) - (F.col("k") % per_page) * 1.4 * size
    return chars.select("doc_id", F.floor(F.col("k") / per_page).cast("int").alias("page"), (F.col("k").cast("bigint") * (1 << 32) + F.col("i")).alias("seq"), "ch", left.cast("float").alias("left"), (top - size).cast("float").alias("bottom"), (left + 0.6 * size).cast("float").alias("right"), top.cast("float").alias("top"), F.lit("Fixed").alias("font"), F.lit(size).cast("float").alias("size"), F.lit(None).cast("int").alias("weight"), F.lit(0.0).cast("float").alias("angle"))
