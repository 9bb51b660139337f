"""Scoring of the regression corpus, its scoreboard, and mining of reordered pages."""

from __future__ import annotations

import json
from collections import defaultdict

from ..model import Page
from ..operators import metrics, reading_order, regions
from ..sources.corpus import PITFALLS, case_json, pages_of
from .document import split_styles


def evaluate_case(case: dict) -> dict:
    """Whether a case's order and classes come out as expected, and the edit distances of its order."""
    pages = split_styles(case.get("document") or pages_of(case))
    found = regions.classify(pages)
    done = reading_order.assemble(pages)
    expected = case["expected"]
    order = expected.get("reading_order")
    got = [b.text for p in done for b in p.blocks]
    wrong = []
    for e in expected.get("classes") or []:
        b = next((b for p in pages for b in p.blocks if b.text == e["block_text"]), None)
        # regions are looked up by box on whatever page
        r = b and (next((r for r in found if r.box == b.box), None) or next((r for r in found if r.kind in ("table", "picture") and r.box.holds_center(b.box)), None))
        if not r or r.kind != e["class"]:
            wrong.append((e["block_text"], e["class"], r.kind if r else None))
    tokens = lambda x: "\n".join(x).split()
    return {
        "id": case["id"],
        "pitfall": case["pitfall"],
        "order_ok": order is None or got == order,
        "wrong_classes": wrong,
        "passed": (order is None or got == order) and not wrong,
        "token_distance": None if order is None else metrics.edit_distance(tokens(got), tokens(order)),
        "block_distance": None if order is None else metrics.edit_distance(got, order),
    }


def score_corpus(cases: list[dict]) -> list[dict]:
    """Per pitfall: passing and total reviewed cases and the first case's root cause; pitfalls without cases too."""
    by = defaultdict(list)
    for c in cases:
        if not c.get("draft"):
            by[c["pitfall"]].append(c)
    return [{"pitfall": p, "passing": sum(evaluate_case(c)["passed"] for c in by[p]), "total": len(by[p]), "root_cause": by[p][0]["root_cause"] if by[p] else None} for p in PITFALLS]


def load_registry(path: str) -> dict[str, dict]:
    with open(path) as f:
        registry = json.load(f)
    unknown = set(registry) - set(PITFALLS)
    if unknown:
        raise ValueError(f"unknown pitfalls {sorted(unknown)}")
    return registry


def status(score: dict, entry: dict | None) -> str:
    """``fixed``, ``partial`` or ``open``: by override, else by how many cases pass."""
    if entry and entry.get("status_override"):
        return {"fixed": "fixed", "partial": "partial"}.get(entry["status_override"], "open")
    if score["total"] and score["passing"] == score["total"]:
        return "fixed"
    return "partial" if score["passing"] else "open"


def checklist(scores: list[dict], registry: dict[str, dict]) -> str:
    mark = {"fixed": "[x]", "partial": "[~]", "open": "[ ]"}
    return "\n".join(f"- {mark[status(s, registry.get(s['pitfall']))]} {registry.get(s['pitfall'], {}).get('title', s['pitfall'])} ({s['passing']}/{s['total']})" for s in scores)


def scoreboard_text(scores: list[dict]) -> str:
    done, all_ = sum(s["passing"] for s in scores), sum(s["total"] for s in scores)
    return "\n".join([*(f"{s['pitfall']:<26}{s['passing']:>3}/{s['total']}" for s in scores), f"{'total':<26}{done:>3}/{all_}"])


def blockers(registry: dict[str, dict]) -> list[tuple[str, str, list[str]]]:
    """Blocked pitfalls by what blocks and unblocks them, in order of first mention."""
    out: dict[tuple[str, str], list[str]] = {}
    for slug, e in registry.items():
        if b := e.get("blocked"):
            out.setdefault((b["reason"], b["unblocked_by"]), []).append(slug)
    return [(*k, v) for k, v in out.items()]


def splice(doc: str, name: str, body: str) -> str:
    """``doc`` with the text between ``name``'s markers replaced; doing so again changes nothing."""
    begin, end = f"<!-- BEGIN {name} -->", f"<!-- END {name} -->"
    a, z = doc.find(begin), doc.find(end)
    if a < 0 or z < 0 or z < a:
        raise ValueError(f"markers of {name} are missing or reversed")
    return doc[: a + len(begin)] + "\n" + body.strip("\n") + "\n" + doc[z:]


def reorder_rank(pages: list[Page]) -> list[dict]:
    """Pages by how far assembly moves their tokens, the furthest first, then by page."""
    done = {p.index: p for p in reading_order.assemble(pages)}
    words = lambda p: "\n\n".join(b.text for b in p.blocks).split()
    out = [{"page": p.index, "distance": metrics.edit_distance(words(p), words(done[p.index]))} for p in pages if p.index in done]
    return sorted(out, key=lambda r: (-r["distance"], r["page"]))


def minimize(page: Page) -> Page | None:
    """A page of few blocks that assembly still reorders, by dropping one after another from the end; None if it doesn't."""

    def moved(blocks) -> bool:
        p = page.with_blocks(blocks)
        return [b.text for b in reading_order.assemble([p])[0].blocks] != [b.text for b in blocks]

    seen, blocks = set(), []
    for b in page.blocks:
        if b.text not in seen:
            seen.add(b.text)
            blocks.append(b)
    if not moved(blocks):
        return None
    k = len(blocks) - 1
    while k >= 0:
        fewer = blocks[:k] + blocks[k + 1 :]
        if moved(fewer):
            blocks = fewer
        k -= 1
    return page.with_blocks(blocks)


def draft(page: Page, case_id: str) -> str | None:
    """A draft case for a page that is reordered."""
    small = minimize(page)
    if small is None:
        return None
    order = [b.text for b in reading_order.assemble([small])[0].blocks]
    return case_json(case_id, "multi_column", "ordering", "mined: assembly changes the order of these blocks", [small], order)
