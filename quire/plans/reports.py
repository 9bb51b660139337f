"""Reports: mined pages and their drafts, scoreboards, score changes, benchmark tables, batch summaries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Page
from ..sources import doclaynet
from . import corpus

TOP_DRAFTS = 5
TOP_CHANGES = 15
LEAST_CHANGE = 0.01


def mine(sample: list[dict], make: Callable[[list[dict]], list[Page]] = doclaynet.document) -> list[dict]:
    """``image_id, distance, blocks, rank`` of every page: those that assembly changes most come first, then the lower id.

    ``make`` builds the page of a sample of one, from its cells as they are or grouped anew (``doclaynet.grouped_document``).
    """
    found = []
    for p in sample:
        pages = make([p])
        moved = corpus.reorder_rank(pages)
        found.append({"image_id": p["image_id"], "distance": moved[0]["distance"] if moved else 0, "blocks": sum(len(x.blocks) for x in pages)})
    found.sort(key=lambda r: (-r["distance"], r["image_id"]))
    return [{**r, "rank": k} for k, r in enumerate(found, 1)]


def mining_report(mined: list[dict], top: int | None = None) -> str:
    """A line per page, worst first, under how many pages are changed at all."""
    changed = sum(r["distance"] > 0 for r in mined)
    lines = [f"{changed} of {len(mined)} pages change order"]
    return "\n".join(lines + [f"{r['rank']:>4}  image {r['image_id']}  distance {r['distance']}  blocks {r['blocks']}" for r in mined[:top]])


def drafts(sample: list[dict], top: int = TOP_DRAFTS, make: Callable[[list[dict]], list[Page]] = doclaynet.document) -> dict[str, str]:
    """Draft cases of the ``top`` pages that change order most, by case id."""
    by_id = {p["image_id"]: p for p in sample}
    out = {}
    for r in mine(sample, make)[:top]:
        name = f"mined-{r['image_id']}"
        text = corpus.draft(make([by_id[r["image_id"]]])[0], name) if r["distance"] else None
        if text is not None:
            out[name] = text
    return out


def ranked(pages: DataFrame, distance: str = "distance", key: str = "image_id") -> DataFrame:
    """The first of every worst-first report at scale: ordered by distance, the largest first, then by key."""
    return pages.orderBy(F.col(distance).desc(), key)


def scoreboard_json(cases: list[dict]) -> str:
    """Every pitfall with its passing and total reviewed cases and what each of them gave, and the sums."""
    boards = []
    for s in corpus.score_corpus(cases):
        own = [corpus.evaluate_case(c) for c in cases if c["pitfall"] == s["pitfall"] and not c.get("draft")]
        boards.append({**s, "cases": [{k: r[k] for k in ("id", "passed", "wrong_classes", "token_distance", "block_distance")} for r in own]})
    return json.dumps({"passing": sum(s["passing"] for s in boards), "total": sum(s["total"] for s in boards), "pitfalls": boards}, indent=2)


def blocker_table(registry: dict[str, dict]) -> str:
    """Markdown table of what blocks which pitfalls and what would free them."""
    rows = [f"| {why} | {', '.join(registry[s].get('title', s) for s in slugs)} | {step} |" for why, step, slugs in corpus.blockers(registry)]
    return "\n".join(["| Blocker | Pitfalls | Next step |", "|---|---|---|", *rows])


def blocked_count(registry: dict[str, dict]) -> int:
    return sum(bool(e.get("blocked")) for e in registry.values())


def coverage(cases: list[dict]) -> dict[str, dict[str, int]]:
    """Reviewed cases of every pitfall: those drawn by hand, and those from a file."""
    out = {p: {"by_hand": 0, "from_file": 0} for p in corpus.PITFALLS}
    for c in cases:
        if not c.get("draft"):
            out[c["pitfall"]]["from_file" if c.get("source_pdf") else "by_hand"] += 1
    return out


def coverage_tables(cases: list[dict], registry: dict[str, dict]) -> str:
    """Two Markdown tables: pitfalls shown by pages drawn by hand only, and those that need a file, with the reason."""
    causes = {}
    for c in cases:
        if not c.get("draft"):
            causes.setdefault(c["pitfall"], c["root_cause"])
    hand, file = [], []
    for slug, n in coverage(cases).items():
        entry = registry.get(slug, {})
        if n["from_file"]:
            file.append(f"| `{slug}` | {causes[slug]} | {n['from_file']} | {entry.get('pdf_backed_reason') or ''} |")
        else:
            hand.append(f"| `{slug}` ({entry.get('title', slug)}) | {causes.get(slug, '')} | {n['by_hand']} |")
    return "\n".join(["| Pitfall | Root cause | Cases |", "|---|---|---|", *hand, "", "| Pitfall | Root cause | Cases | Why a file |", "|---|---|---|---|", *file])


def score_changes(scores: DataFrame, baseline: DataFrame, key: str = "doc_id", score: str = "score", least: float = LEAST_CHANGE, top: int = TOP_CHANGES) -> DataFrame:
    """``key, delta, direction``: the ``top`` largest gains and losses against a baseline.

    Documents that either side lacks or has no score for don't count, nor do changes of ``least`` or less.
    """
    both = scores.select(key, F.col(score).alias("_new")).join(baseline.select(key, F.col(score).alias("_old")), key)
    d = both.select(key, (F.col("_new") - F.col("_old")).alias("delta")).where(F.abs("delta") > least)
    loss = d.where("delta < 0").orderBy("delta", key).limit(top).withColumn("direction", F.lit("loss"))
    gain = d.where("delta > 0").orderBy(F.col("delta").desc(), key).limit(top).withColumn("direction", F.lit("gain"))
    return loss.unionByName(gain)


_SCORES = "overall_mean double, nid_mean double, nid_s_mean double, teds_mean double, teds_s_mean double, mhs_mean double, mhs_s_mean double"
_SPEED = "struct<elapsed_per_doc: double, document_count: bigint, processor: string, engine_version: string>"
EVALUATION = f"metrics struct<score: struct<{_SCORES.replace(' double', ': double')}>, missing_predictions: bigint>, speed {_SPEED}, summary {_SPEED}"


def read_engines(spark, path: str) -> DataFrame:
    """Results of engines, one ``<engine>/evaluation.json`` each, best first; speeds come from ``speed``, else ``summary``."""
    r = spark.read.schema(EVALUATION).option("multiLine", True).json(f"{path}/*/evaluation.json")
    pick = lambda f: F.when(F.col("speed").isNotNull(), F.col(f"speed.{f}")).otherwise(F.col(f"summary.{f}"))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/evaluation\.json$", 1).alias("name")
    means = [F.col(f"metrics.score.{c.split()[0]}").alias(c.split()[0].removesuffix("_mean")) for c in _SCORES.split(", ")]
    version = F.coalesce("summary.engine_version", F.lit("unknown")).alias("version")
    out = r.select(name, version, *means, pick("elapsed_per_doc").alias("s_per_doc"), pick("document_count").alias("document_count"), F.col("metrics.missing_predictions").alias("missing_predictions"), pick("processor").alias("processor"))
    return by_overall(out)


def by_overall(engines: DataFrame) -> DataFrame:
    """Best first; engines without a mean come last; equals by name."""
    return engines.orderBy(F.col("overall").desc_nulls_last(), "name")


def engine_table(engines: list[dict]) -> str:
    """Markdown table of a handful of engines in their order, ``N/A`` where there is no figure."""
    show = lambda v, unit="": "N/A" if v is None else f"{v:.3f}{unit}"
    rows = [f"| {e['name']} | {show(e['overall'])} | {show(e['nid'])} | {show(e['teds'])} | {show(e['mhs'])} | {show(e['s_per_doc'], 's')} |" for e in engines]
    return "\n".join(["| Engine | Overall | Order | Tables | Headings | s/doc |", "|---|---|---|---|---|---|", *rows])


def batch_summary(outcomes: DataFrame, wall: Column | float | None = None) -> DataFrame:
    """One row over ``seq, name, ok, pages, chars, seconds``: sums, failures, pace and the slowest file, the last of equals.

    ``wall`` is the time that all took, by default that of the files added up. Without pages or files their pace is 0.
    """
    t = F.sum("seconds") if wall is None else F.lit(wall)
    pace = lambda n: F.when(n > 0, t / n).otherwise(F.lit(0.0))
    pages = F.sum("pages")
    rate = F.when(t > 0, pages / t).otherwise(F.lit(0.0))
    return outcomes.agg(
        F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("failed"), pages.alias("pages"), F.sum("chars").alias("chars"),
        pace(pages).alias("s_per_page"), pace(F.count("*")).alias("s_per_doc"), rate.alias("pages_per_s"), F.max_by("name", F.struct("seconds", "seq")).alias("slowest"),
    )
