"""Regression cases: JSON files with a page or pages and what should come of them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CLASSES, Block, Box, Char, Graphic, Line, Page, Word, hull

PITFALLS = ("borderless_table", "cross_page_continuation", "embedded_font", "figure_caption", "footnote", "header_footer", "list_nesting", "merged_table_cell", "multi_column", "multi_line_table_cell", "nested_formula", "overlapping_text", "rotated_text", "section_header_vs_bold", "super_subscript")
ROOT_CAUSES = ("geometric", "classification", "ordering")
DEFAULT_SIZE, DEFAULT_FONT = 10.0, "Stage3Corpus"

_BOX = T.ArrayType(T.FloatType())
_LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("bbox", _BOX), T.StructField("font_size", T.FloatType()), T.StructField("font_name", T.StringType())])
_GRAPHIC = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bbox", _BOX), T.StructField("z", T.IntegerType()), T.StructField("stroke_width", T.FloatType()), T.StructField("is_stroked", T.BooleanType()), T.StructField("is_filled", T.BooleanType())])
_PAGE = T.StructType([T.StructField("width", T.FloatType()), T.StructField("height", T.FloatType()), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("lines", T.ArrayType(_LINE))]))), T.StructField("graphics", T.ArrayType(_GRAPHIC))])
_EXPECTED = T.StructType([T.StructField("reading_order", T.ArrayType(T.StringType())), T.StructField("classes", T.ArrayType(T.StructType([T.StructField("block_text", T.StringType()), T.StructField("class", T.StringType())]))), T.StructField("requires_extraction_fix", T.BooleanType())])
CASE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "source_pdf", "pitfall", "root_cause", "description")), T.StructField("draft", T.BooleanType()), T.StructField("page", _PAGE), T.StructField("pages", T.ArrayType(_PAGE)), T.StructField("expected", _EXPECTED)])


class CorpusError(ValueError):
    """A case that can't be used."""


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """All cases under ``path`` by file, ``page`` and ``pages`` made one column; faults stop the query.

    A case must name a known pitfall and cause and have exactly one of ``page`` and ``pages``.
    """
    raw = spark.read.schema(CASE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    fault = (
        F.when(F.col("id").isNull(), "no id")
        .when(~F.coalesce(F.col("pitfall").isin(*PITFALLS), F.lit(False)), "unknown pitfall")
        .when(~F.coalesce(F.col("root_cause").isin(*ROOT_CAUSES), F.lit(False)), "unknown root cause")
        .when(F.col("page").isNull() == F.col("pages").isNull(), "exactly one of page and pages is needed")
    )
    ok = raw.withColumn("id", F.when(fault.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": "), fault)).cast("string")))
    return ok.select("id", F.coalesce("draft", F.lit(False)).alias("draft"), "source_pdf", "pitfall", "root_cause", "description", F.coalesce("pages", F.array("page")).alias("pages"), "expected", "file").orderBy("file")


def pages_of(case: dict) -> list[Page]:
    """A case's pages: one word a line, every character with the line's box."""
    if ("page" in case and case["page"] is not None) == ("pages" in case and case["pages"] is not None):
        raise CorpusError("exactly one of page and pages is needed")
    out = []
    for i, p in enumerate(case.get("pages") or [case["page"]]):
        blocks = []
        for b in p["blocks"]:
            ls = []
            for x in b["lines"]:
                box, size, font = Box(*map(float, x["bbox"])), x.get("font_size"), x.get("font_name")
                size = DEFAULT_SIZE if size is None else float(size)
                ls.append(Line(x["text"], box, [Word(x["text"], box, [Char(c, box, font or DEFAULT_FONT, size) for c in x["text"]])]))
            blocks.append(Block(hull(x.box for x in ls), ls))
        flag = lambda g, k, d: d if g.get(k) is None else g[k]
        graphics = [Graphic(g["kind"], Box(*map(float, g["bbox"])), flag(g, "z", z), flag(g, "stroke_width", 1.0), flag(g, "is_stroked", True), flag(g, "is_filled", False)) for z, g in enumerate(p.get("graphics") or [])]
        out.append(Page(i, float(p["width"]), float(p["height"]), blocks, graphics))
    texts = [b.text for p in out for b in p.blocks]
    if len(set(texts)) != len(texts):
        raise CorpusError("block texts must differ")
    return out


def load_case(path: str | Path) -> dict:
    case = json.loads(Path(path).read_text())
    if case.get("pitfall") not in PITFALLS:
        raise CorpusError(f"unknown pitfall {case.get('pitfall')}")
    if case.get("root_cause") not in ROOT_CAUSES:
        raise CorpusError(f"unknown root cause {case.get('root_cause')}")
    for c in (case.get("expected") or {}).get("classes") or []:
        if c["class"] not in CLASSES:
            raise CorpusError(f"unknown class {c['class']}")
    case["document"] = pages_of(case)
    return case


def load_corpus(folder: str | Path) -> list[dict]:
    """All cases below ``folder``, by path."""
    return [load_case(p) for p in sorted(Path(folder).rglob("*.json"))]


def case_json(case_id: str, pitfall: str, cause: str, description: str, pages: list[Page], order: list[str] | None = None, classes: list[dict] | None = None, draft: bool = True) -> str:
    """A case as pretty JSON, each line with the font of its first character."""
    body = []
    for p in pages:
        lines = lambda b: [{"text": x.text, "bbox": list(x.box), "font_size": x.chars()[0].size if x.chars() else DEFAULT_SIZE, "font_name": x.chars()[0].font if x.chars() else DEFAULT_FONT} for x in b.lines]
        body.append({"width": p.width, "height": p.height, "blocks": [{"lines": lines(b)} for b in p.blocks], "graphics": [{"kind": g.kind, "bbox": list(g.box), "z": g.z, "stroke_width": g.stroke_width, "is_stroked": g.stroked, "is_filled": g.filled} for g in p.graphics]})
    out = {"id": case_id, "draft": draft, "pitfall": pitfall, "root_cause": cause, "description": description}
    out |= {"page": body[0]} if len(body) == 1 else {"pages": body}
    return json.dumps(out | {"expected": {"reading_order": order, "classes": classes or []}}, indent=2, ensure_ascii=False) + "\n"


def write_draft(folder: str | Path, case_id: str, pitfall: str, text: str) -> Path:
    """Write a draft as ``folder/pitfall/id.json``; an existing file is an error."""
    path = Path(folder) / pitfall / f"{case_id}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        f.write(text)
    return path
