import json

import pytest

from quire.model import Box
from quire.plans import corpus as C
from quire.plans import reports as R
from quire.sources import corpus as S
from quire.sources import doclaynet as D


def page(n, cells):
    return {"image_id": n, "width": 600.0, "height": 800.0, "truth": [], "scale": 1.0, "cells": [(t, Box(*b), 10.0) for t, b in cells]}


LEFT, RIGHT = [(f"l{k}", (50, 700 - 20 * k, 250, 712 - 20 * k)) for k in range(4)], [(f"r{k}", (350, 700 - 20 * k, 550, 712 - 20 * k)) for k in range(4)]
ROWS = [c for pair in zip(LEFT, RIGHT) for c in pair]


def test_mined_pages_come_worst_first_and_by_id():
    sample = [page(9, LEFT), page(7, ROWS), page(3, LEFT), page(5, ROWS), page(1, [])]
    got = R.mine(sample)
    assert [r["image_id"] for r in got] == [5, 7, 1, 3, 9] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert got[0]["distance"] > 0 and got[0]["blocks"] == 8 and not got[2]["distance"]
    assert R.mining_report(got, 2).splitlines()[0] == "2 of 5 pages change order" and len(R.mining_report(got, 2).splitlines()) == 3
    assert len(R.mine(sample, D.grouped_document)) == 5


def test_drafts_of_the_worst_pages_can_be_read(tmp_path):
    found = R.drafts([page(7, ROWS), page(5, ROWS), page(3, LEFT)], top=1)
    assert list(found) == ["mined-5"]
    case = json.loads(found["mined-5"])
    assert case["draft"] and case["id"] == "mined-5"
    f = tmp_path / "x.json"
    f.write_text(found["mined-5"])
    assert C.evaluate_case(S.load_case(f))["order_ok"]


def test_scoreboard_outputs():
    drafted = json.loads(R.drafts([page(5, ROWS)])["mined-5"])
    first = {**drafted, "draft": False}
    wrong = {**first, "id": "w", "source_pdf": "a.pdf", "expected": {"reading_order": first["expected"]["reading_order"][::-1]}}
    board = json.loads(R.scoreboard_json([first, wrong, drafted]))
    assert (board["passing"], board["total"]) == (1, 2) and len(board["pitfalls"]) == len(S.PITFALLS)
    assert [c["passed"] for p in board["pitfalls"] for c in p["cases"]] == [True, False]
    assert R.coverage([first, wrong, drafted])["multi_column"] == {"by_hand": 1, "from_file": 1}
    registry = {"multi_column": {"title": "Columns", "pdf_backed_reason": "fonts", "blocked": {"reason": "a", "unblocked_by": "b"}}, "footnote": {"title": "Notes", "blocked": {"reason": "a", "unblocked_by": "b"}}, "caption": {}}
    text = R.coverage_tables([first, wrong], registry)
    assert text.count("multi_column") == 1 and "| fonts |" in text and "`footnote` (Notes)" in text
    assert R.blocker_table(registry).splitlines()[2:] == ["| a | Columns, Notes | b |"] and R.blocked_count(registry) == 2


def test_score_changes(spark):
    new = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.5), (4, None), (5, 0.505), (7, 0.8)], "doc_id int, score double")
    old = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.7), (4, 0.5), (5, 0.5), (6, 0.5), (7, None)], "doc_id int, score double")
    got = [(r["doc_id"], round(r["delta"], 6), r["direction"]) for r in R.score_changes(new, old).collect()]
    assert got == [(2, -0.4, "loss"), (3, -0.2, "loss"), (1, 0.4, "gain")]
    assert R.score_changes(new, old, top=1).count() == 2


def test_engines(spark, tmp_path):
    for name, data in {
        "b": {"metrics": {"score": {"overall_mean": 0.5, "nid_mean": 0.25}, "missing_predictions": 2}, "speed": {"elapsed_per_doc": 0.125, "document_count": 3}, "summary": {"engine_version": "1.0", "elapsed_per_doc": 9.0}},
        "c": {"metrics": {"score": {}}, "summary": {"elapsed_per_doc": 2.0}},
        "a": {"metrics": {"score": {"overall_mean": 0.75}}},
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "evaluation.json").write_text(json.dumps(data))
    rows = [r.asDict() for r in R.read_engines(spark, str(tmp_path)).collect()]
    assert [r["name"] for r in rows] == ["a", "b", "c"] and [r["s_per_doc"] for r in rows] == [None, 0.125, 2.0]
    assert rows[1]["version"] == "1.0" and rows[1]["missing_predictions"] == 2 and rows[0]["version"] == "unknown"
    # the table repeats the rows, place by place
    table = R.engine_table(rows).splitlines()[2:]
    assert table[1] == "| b | 0.500 | 0.250 | N/A | N/A | 0.125s |"
    assert [line.split(" | ")[0].strip("| ") for line in table] == [r["name"] for r in rows]


def test_batch_summary(spark):
    df = spark.createDataFrame([(0, "a", True, 2, 10, 1.0), (1, "b", False, 0, 0, 3.0), (2, "c", True, 4, 20, 3.0)], "seq int, name string, ok boolean, pages int, chars int, seconds double")
    r = R.batch_summary(df).first()
    assert (r["files"], r["failed"], r["pages"], r["chars"], r["slowest"]) == (3, 1, 6, 30, "c")
    assert r["s_per_page"] == pytest.approx(7 / 6) and r["s_per_doc"] == pytest.approx(7 / 3)
    assert R.batch_summary(df, 3.0).first()["pages_per_s"] == 2.0
    none = R.batch_summary(df.limit(0)).first()
    assert none["files"] == 0 and none["s_per_page"] == 0.0 and none["slowest"] is None
