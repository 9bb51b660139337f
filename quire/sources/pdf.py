"""Characters and graphics of simple PDF files.

Reads what needs no font program: pages whose content streams are plain or deflated, set in
fonts of known or even width. It is the fallback for :func:`read_pdfs`, which takes any
``parse(bytes) -> (chars, graphics, pages)``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CHARS, GRAPHICS, PAGES

_NARROW, _WIDE = set("iljtfr.,:;'!|I()[] "), set("mwMWQ@%")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+")
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj(.*?)endobj", re.S)


def advance(c: str, size: float) -> float:
    return size * (0.278 if c in _NARROW else 0.85 if c in _WIDE else 0.556)


def _string(t: bytes) -> str:
    if t[:1] == b"<":
        h = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode()).decode("latin-1")
    s = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), t[1:-1])
    return re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), s).decode("latin-1")


def _content(stream: bytes, fonts: dict[str, str], page: int) -> tuple[list[dict], list[dict]]:
    chars: list[dict] = []
    graphics: list[dict] = []
    stack: list = []
    size, font, x, y, line_x, line_y, leading = 0.0, "", 0.0, 0.0, 0.0, 0.0, 0.0
    path: list[tuple[float, float]] = []
    width, z, inside = 1.0, 0, None

    def show(s: str) -> None:
        nonlocal x, z
        for c in s:
            w = advance(c, size)
            if c not in "\r\n":
                chars.append({"page": page, "seq": len(chars), "ch": c, "left": x, "bottom": y - 0.2 * size, "right": x + w, "top": y + 0.8 * size, "font": font, "size": size, "weight": None, "angle": 0.0})
            x += w

    def paint(filled: bool, stroked: bool) -> None:
        nonlocal z, path
        if path:
            xs, ys = zip(*path)
            graphics.append({"page": page, "z": z, "kind": "fill" if filled else "stroke", "left": min(xs), "bottom": min(ys), "right": max(xs), "top": max(ys), "stroke_width": width, "stroked": stroked, "filled": filled})
            z += 1
        path = []

    for m in _TOKEN.finditer(stream):
        t = m[0]
        if t[:1] in b"(<" or t[:1] == b"/":
            (inside if inside is not None else stack).append(t)
        elif t == b"[":
            inside = []
        elif t == b"]":
            stack.append(inside or [])
            inside = None
        elif re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", t):
            (inside if inside is not None else stack).append(float(t))
        else:
            n = [v for v in stack if isinstance(v, float)]
            if t == b"Tf" and stack:
                font, size = fonts.get(stack[0][1:].decode("latin-1"), ""), n[-1]
            elif t == b"BT":
                x = y = line_x = line_y = 0.0
            elif t in (b"Td", b"TD") and len(n) >= 2:
                leading = -n[-1] if t == b"TD" else leading
                line_x, line_y = line_x + n[-2], line_y + n[-1]
                x, y = line_x, line_y
            elif t == b"Tm" and len(n) >= 6:
                x, y = line_x, line_y = n[-2], n[-1]
            elif t == b"TL" and n:
                leading = n[-1]
            elif t == b"T*":
                line_y -= leading
                x, y = line_x, line_y
            elif t in (b"Tj", b"'") and stack and isinstance(stack[-1], bytes):
                if t == b"'":
                    line_y -= leading
                    x, y = line_x, line_y
                show(_string(stack[-1]))
                z += 1
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                for v in stack[-1]:
                    if isinstance(v, float):
                        x -= v / 1000 * size
                    else:
                        show(_string(v))
                z += 1
            elif t == b"re" and len(n) >= 4:
                path += [(n[-4], n[-3]), (n[-4] + n[-2], n[-3] + n[-1])]
            elif t in (b"m", b"l") and len(n) >= 2:
                path.append((n[-2], n[-1]))
            elif t == b"w" and n:
                width = n[-1]
            elif t in (b"S", b"s"):
                paint(False, True)
            elif t in (b"f", b"F", b"f*"):
                paint(True, False)
            elif t in (b"B", b"b", b"B*", b"b*"):
                paint(True, True)
            elif t == b"n":
                path = []
            stack = []
    return chars, graphics


def parse_simple(data: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Characters, graphics and page sizes of a file; a file without a page is an error."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    ref = lambda body, key: [int(r) for m in [re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)] if m for r in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]
    fonts = {n: (m := re.search(rb"/BaseFont\s*/([^\s/>]+)", b)) and m[1].decode("latin-1") or "" for n, b in objects.items() if b"/BaseFont" in b}
    order: list[int] = []

    def walk(n: int) -> None:
        body = objects.get(n, b"")
        if kids := ref(body, rb"/Kids"):
            for k in kids:
                walk(k)
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(n)

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    for r in roots:
        walk(r)
    if not order:
        raise ValueError("no pages")
    chars: list[dict] = []
    graphics: list[dict] = []
    pages = []
    for i, n in enumerate(order):
        body = objects[n]
        media = re.search(rb"/MediaBox\s*\[\s*([-.\d\s]+)\]", body) or re.search(rb"/MediaBox\s*\[\s*([-.\d\s]+)\]", data)
        x0, y0, x1, y1 = map(float, media[1].split()) if media else (0, 0, 612, 792)
        pages.append({"page": i, "width": x1 - x0, "height": y1 - y0})
        named = {k.decode("latin-1"): fonts.get(int(v), "") for k, v in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", body)}
        for c in ref(body, rb"/Contents"):
            m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", objects.get(c, b""), re.S)
            if m:
                raw = zlib.decompress(m[1]) if b"FlateDecode" in objects[c] else m[1]
                cs, gs = _content(raw, named, i)
                base = sum(x["page"] == i for x in chars)
                chars += [x | {"seq": x["seq"] + base} for x in cs]
                graphics += gs
    return chars, graphics, pages


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[list[dict], list[dict], list[dict]]] = parse_simple) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Character, graphic, page and error tables of all ``*.pdf`` files in ``path``; ``doc_id`` is the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content")
    kinds = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_()}

    def reader(which: int, schema):
        fields = [(f.name, kinds[f.dataType.typeName()]) for f in schema]

        def run(batches):
            for b in batches:
                for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        rows = [{"doc_id": doc} | r for r in parse(content)[which]] if which < 3 else (parse(content), [])[1]
                    except Exception as e:  # a bad file is reported, the others are read
                        rows = [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}] if which == 3 else []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

        return files.mapInArrow(run, schema)

    from pyspark.sql.types import StringType, StructField, StructType

    errors = StructType([StructField("doc_id", StringType()), StructField("error", StringType())])
    return reader(0, CHARS), reader(1, GRAPHICS), reader(2, PAGES), reader(3, errors)


def write_pdf(pages: list[list[tuple[str, float, float, float]]], width: float = 612, height: float = 792) -> bytes:
    """A small uncompressed file of (text, x, y, size) lines, for tests and examples."""
    out, at = bytearray(b"%PDF-1.4\n"), []

    def add(body: bytes) -> None:
        at.append(len(out))
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (len(at), body))

    n = len(pages)
    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n)), n))
    add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    for i, lines in enumerate(pages):
        add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (width, height, 5 + 2 * i))
        esc = lambda s: s.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        stream = b"".join(b"BT /F1 %g Tf %g %g Td (%s) Tj ET\n" % (size, x, y, esc(t)) for t, x, y, size in lines)
        add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    xref = len(out)
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at))
    out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, xref))
    return bytes(out)
