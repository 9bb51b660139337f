"""Ground truth in COCO form with text cells beside it."""

from __future__ import annotations

import json
import math
from pathlib import Path

from ..model import CLASSES, Block, Box, Char, Line, Page, Region, Word
from ..operators import grouping, metrics, regions

DEFAULT_SIZE = 10.0
_NAMES = {"Caption": 1, "Footnote": 2, "Formula": 3, "List-item": 4, "Page-footer": 5, "Page-header": 6, "Picture": 7, "Section-header": 8, "Table": 9, "Text": 10, "Title": 11}


class MissingCells(FileNotFoundError):
    """A page image without a cells file."""


def category(number: int, name: str) -> str:
    """Class of a category: by number, else by name."""
    if 1 <= number <= len(CLASSES):
        return CLASSES[number - 1]
    if name in _NAMES:
        return CLASSES[_NAMES[name] - 1]
    raise ValueError(f"unknown category {number} {name}")


def flip(box: list[float], height: float) -> Box:
    x, y, w, h = box
    return Box(x, height - y - h, x + w, height - y)


def scale_of(image_height: float, meta: dict | None) -> float:
    w, h = (meta or {}).get("original_width"), (meta or {}).get("original_height")
    ok = all(v is not None and math.isfinite(v) and v > 0 for v in (w, h))
    s = image_height / h if ok else 1.0
    return s if math.isfinite(s) and s > 0 else 1.0


def load_sample(coco: str | Path, cells: str | Path) -> list[dict]:
    """Pages with their true regions, cells and scale, in the order of the images."""
    data = json.loads(Path(coco).read_text())
    kinds = {c["id"]: category(c["id"], c["name"]) for c in data["categories"]}
    out = []
    for n, image in enumerate(data["images"]):
        stem = Path(image["file_name"]).stem
        path = next((p for p in (Path(cells) / f"{stem}.cells.json", Path(cells) / f"{stem}.json") if p.exists()), None)
        if path is None:
            raise MissingCells(stem)
        found = json.loads(path.read_text())
        truth = [Region(kinds[a["category_id"]], flip(a["bbox"], image["height"]), 1.0, n) for a in data["annotations"] if a["image_id"] == image["id"]]
        rows = [(c["text"], flip(c["bbox"], image["height"]), next((v for v in (c.get("font_size"), (c.get("font") or {}).get("size")) if v is not None), DEFAULT_SIZE)) for c in found["cells"]]
        out.append({"image_id": image["id"], "width": image["width"], "height": image["height"], "truth": truth, "cells": rows, "scale": scale_of(image["height"], found.get("metadata"))})
    return out


def document(sample: list[dict]) -> list[Page]:
    """One block of one word per cell that isn't blank."""
    pages = []
    for i, p in enumerate(sample):
        blocks = []
        for text, box, size in p["cells"]:
            if text.strip():
                blocks.append(Block(box, [Line(text, box, [Word(text, box, [Char(c, box, "", size) for c in text])])]))
        pages.append(Page(i, p["width"], p["height"], blocks))
    return pages


def grouped_document(sample: list[dict]) -> list[Page]:
    """Cells' characters on an even grid, grouped anew, with sizes in image units."""
    pages = []
    for i, p in enumerate(sample):
        chars = []
        for text, box, size in p["cells"]:
            step = box.width / len(text) if text else 0.0
            chars += [Char(c, Box(box.left + k * step, box.bottom, box.left + (k + 1) * step, box.top), "", size * p["scale"]) for k, c in enumerate(text)]
        pages.append(Page(i, p["width"], p["height"], grouping.group(chars)))
    return pages


def evaluate(sample: list[dict], threshold: float = 0.5) -> dict:
    """Scores of the classification of all pages against their truth."""
    found = regions.classify(document(sample))
    return metrics.evaluate_pages([([r for r in found if r.page == i], p["truth"]) for i, p in enumerate(sample)], threshold)


def read_sample(spark, coco: str, cells: str):
    """The same as tables: ``(truth, cells)`` with boxes turned round, one file per page beside the one of the images.

    Annotations without an image are dropped; an image without a cells file stops the query. Of the two possible
    cells files of an image ``<stem>.cells.json`` comes first.
    """
    from pyspark.sql import functions as F

    box = "bbox array<double>"
    schema = f"images array<struct<id: bigint, file_name: string, width: double, height: double>>, categories array<struct<id: bigint, name: string>>, annotations array<struct<image_id: bigint, category_id: bigint, {box.replace(' ', ': ')}>>"
    c = spark.read.schema(schema).option("multiLine", True).json(coco)
    images = c.select(F.posexplode("images").alias("page", "i")).select("page", "i.*", F.regexp_replace(F.regexp_replace("i.file_name", r"^.*/", ""), r"\.[^.]*$", "").alias("stem"))
    by_id = F.create_map(*[F.lit(x) for n, k in enumerate(CLASSES, 1) for x in (n, k)])
    by_name = F.create_map(*[F.lit(x) for name, n in _NAMES.items() for x in (name, CLASSES[n - 1])])
    kinds = c.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.coalesce(F.try_element_at(by_id, F.col("c.id").cast("int")), F.try_element_at(by_name, F.col("c.name"))).alias("class"))
    turned = lambda b, h: [b[0].alias("left"), (h - b[1] - b[3]).alias("bottom"), (b[0] + b[2]).alias("right"), (h - b[1]).alias("top")]
    notes = c.select(F.posexplode("annotations").alias("region", "a")).select("region", "a.*")
    truth = notes.join(images, notes["image_id"] == images["id"]).join(F.broadcast(kinds), "category_id")  # eleven rows
    truth = truth.select("image_id", "page", "region", "class", *turned(F.col("bbox"), F.col("height")))
    cell = "cells array<struct<text: string, bbox: array<double>, font_size: double, font: struct<size: double>>>, metadata struct<original_width: double, original_height: double>"
    files = spark.read.schema(cell).option("multiLine", True).option("pathGlobFilter", "*.json").json(cells).select("*", F.regexp_replace("_metadata.file_name", r"(\.cells)?\.json$", "").alias("stem"), F.col("_metadata.file_name").endswith(".cells.json").alias("own"))
    first = files.where("cells is not null").groupBy("stem").agg(F.max_by(F.struct("cells", "metadata"), "own").alias("f"))
    j = images.join(first, "stem", "left").withColumn("cells", F.when(F.col("f").isNull(), F.raise_error(F.concat(F.lit("no cells of "), "stem")).cast("array<struct<text: string, bbox: array<double>, font_size: double, font: struct<size: double>>>")).otherwise(F.col("f.cells")))
    m = F.col("f.metadata")
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0)
    scale = F.when(ok(m["original_width"]) & ok(m["original_height"]), F.col("height") / m["original_height"]).otherwise(F.lit(1.0))
    out = j.select(F.col("id").alias("image_id"), "page", "height", scale.alias("scale"), F.posexplode("cells").alias("cell", "c"))
    return truth, out.select("image_id", "page", "cell", "c.text", *turned(F.col("c.bbox"), F.col("height")), F.coalesce("c.font_size", "c.font.size", F.lit(DEFAULT_SIZE)).alias("size"), "scale")
