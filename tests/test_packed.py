import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.model import CHARS, Box, Char, Line, Word
from quire.operators import grouping as Gr
from quire.operators import markdown as M
from quire.operators import regions as R
from quire.operators.packed import Packed
from quire.plans import document as D

STYLES = [(10.0, None, "Plain"), (6.0, 700, ""), (0.0, None, "Bold"), (24.0, 400, "Plain")]


def pack(chars, page):
    text, style = "".join(c.text for c, _ in chars), np.array([k for _, k in chars], np.int64)
    boxes = [np.array([getattr(c.box, n) for c, _ in chars], np.float64) for n in ("left", "bottom", "right", "top")]
    return Packed(text, np.array(page, np.int64), np.arange(len(chars)), *boxes, np.array([c.size for c, _ in chars], np.float64), style, STYLES, np.zeros(len(chars)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab1. \t　\n-"), st.integers(0, 3), st.sampled_from([0, 0, 0, 1, 5, 14, 60]), st.sampled_from([0, 1, 4, 9]), st.sampled_from([0, 6, 6, 6, 20, -40]), st.integers(0, 1)), max_size=60))
def test_columns_group_as_characters_do(drawn):
    """Words, lines and blocks, their boxes, texts and styles are those of the rules for single characters."""
    x, y, chars, page = 72.0, 700.0, [], []
    for ch, k, down, up, step, p in drawn:
        x, y = (72.0 if down else x + step), y - down
        size, weight, font = STYLES[k]
        chars.append((Char(ch, Box(x, y + up, x + 6.0, y + up + max(size, 2.0)), font, size, weight, 0.0), k))
        page.append(p)
    got = pack(chars, page).blocks()
    by = {}
    for (c, _), p in zip(chars, page):
        if c.text not in "\r\n":
            by.setdefault(p, []).append(c)
    want = {p: Gr.group(cs) for p, cs in by.items()}
    plain = lambda b: (b.box, b.size(), [(x.text, x.box, x.styles(), R.line_tokens(x), x.words) for x in b.lines], R.corridors(b))
    assert {p: [plain(b) for b in bs] for p, bs in got.items()} == {p: [plain(b) for b in bs] for p, bs in want.items()}


def test_runs_are_the_characters_they_stand_for(spark):
    texts = [(str(i), f"Title {i}\n\n- a  bé\U0001f600 c\n" + "wide   table   row\n" * 2 + "x" * i + "\n" * 60 + f"page {i}\r\n\nlast") for i in range(40)] + [("none", ""), ("null", None)]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    runs, chars = D.typeset_runs(df), D.typeset_chars(df)
    for make in (D.blocks_table, D.ordered_blocks_table, D.regions_table, D.markdown_table):
        got, want = ([tuple(r) for r in make(t).collect()] for t in (runs, chars))
        assert len(got) >= 40 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_documents_share_a_call(spark):
    """A call for every document costs more than its work."""
    chars = D.typeset_runs(spark.createDataFrame([("x", "text")], "doc_id string, text string"))
    for make in (D.blocks_table, D.ordered_blocks_table, D.regions_table, D.markdown_table):
        plan = make(chars)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_documents_over_several_batches(spark):
    """A document that goes on in the next batch stays whole, and a bad one among good ones is alone in its fault."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = [(str(i), "\n".join(["some words"] * (1 + i * i % 23))) for i in range(30)]
        chars = D.typeset_chars(spark.createDataFrame(texts, "doc_id string, text string"))
        bad = spark.createDataFrame([("bad", 0, 0, "x", None, 0.0, 1.0, 1.0, "F", 10.0, None, 0.0), ("odd", 0, 0, "xy", 0.0, 0.0, 9.0, 9.0, None, None, None, None)], CHARS)
        got = {r["doc_id"]: r["text"] for r in D.blocks_table(chars.unionByName(bad)).where("page is not null").collect()}
        failed = [r["doc_id"] for r in D.markdown_table(chars.unionByName(bad)).collect() if r["error"]]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {**dict(texts), "odd": "xy"} and failed == ["bad"]


@pytest.mark.parametrize("spans", [[(0, 5), (6, 9), (40, 60)], [(0, 9), (30, 41), (12, 20)]])
def test_corridors_of_words_in_any_order(spans):
    """Gaps are met side by side only where words come from the left to the right."""
    box = Box(0, 0, 60, 10)
    make = lambda s: Line("x", box, [Word("x", Box(a, 0, z, 10), [Char("x", Box(a, 0, z, 10), "", 1.0)]) for a, z in s])
    one, two = R._gaps(make(spans)), R._gaps(make([(0, 1), (35, 60)]))
    want = [(max(a, c), min(z, d)) for a, z in one for c, d in two if max(a, c) < min(z, d)]
    assert R._meet(one, two) == want and want


def test_regions_of_other_pages_do_not_matter():
    from quire.model import Block, Page, Region

    pages = [Page(i, 612.0, 792.0, [Block(Box(0, 0, 10, 10), [Line(f"t{i}", Box(0, 0, 10, 10))])]) for i in (0, 1)]
    assert M.structured(pages, [Region("title", Box(0, 0, 10, 10), 1.0, 1)]) == "t0\n\n---\n\n# t1"


@pytest.mark.parametrize(("make", "query"), [(D.blocks_table, "grp_blocks"), (D.ordered_blocks_table, "ord_reading_order"), (D.regions_table, "reg_regions")])
def test_a_document_that_fails_shows(spark, monkeypatch, make, query):
    """It gives a row with its error; a query without such a column stops, whatever is asked of it."""
    from quire import queries

    good = D.typeset_chars(spark.createDataFrame([("good", "some words")], "doc_id string, text string"))
    bad = spark.createDataFrame([("bad", 0, 0, "x", None, 0.0, 1.0, 1.0, "F", 10.0, None, 0.0)], CHARS)
    rows = make(good.unionByName(bad)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["page"]) for r in rows] == [("bad", None), ("good", 0)] and "no box" in rows[0]["error"] and rows[1]["error"] is None
    monkeypatch.setattr(queries, "_chars", lambda *_: good.unionByName(bad))
    with pytest.raises(Exception, match="document bad: ValueError"):
        queries.QUERIES[query](spark, "").count()
    monkeypatch.setattr(queries, "_chars", lambda *_: good)
    assert queries.QUERIES[query](spark, "").count() == 1 and "error" not in queries.QUERIES[query](spark, "").columns
