import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire import queries
from quire.model import Block, Box, Char, Graphic, Line, Page, Word, hull
from quire.operators import batch as B
from quire.operators import reading_order as O
from quire.operators.regions import grid_cells, is_rule, ruled_tables
from quire.plans.corpus import minimize, reorder_rank

TINY = "/root/testdata/sf0.001"


def block(text, box, size):
    return Block(box, [Line(text, box, [Word(text, box, [Char(c, box, "", size) for c in text])])])


def columns(pages):
    rows = [(p, *b.box, b.lines[0].words[0].size, len(b.lines[0].text)) for p, x in enumerate(pages) for b in x.blocks]
    return [np.array(c, np.int64 if i in (0, 6) else np.float64) for i, c in enumerate(zip(*rows))]


#: Boxes on a coarse grid, so that gaps and edges are often equal; some inside out, some in large type.
BOXES = st.tuples(st.integers(0, 40), st.integers(0, 50), st.sampled_from([-1, 0, 3, 5, 9, 9, 30]), st.sampled_from([-1, 0, 1, 2, 2, 5]), st.sampled_from([8, 9, 10, 10, 12, 30]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(BOXES, min_size=1, max_size=12), min_size=1, max_size=6), st.booleans())
def test_orders_are_those_of_single_pages(drawn, plain):
    pages = []
    for bs in drawn:
        made = []
        for i, (x, y, w, h, size) in enumerate(bs):
            w, h, size = (abs(w), abs(h), min(size, 12)) if plain else (w, h, size)
            made.append(block(f"b{i + 1}", Box(14.0 * x, 14.0 * y, 14.0 * (x + w), 14.0 * (y + h)), float(size)))
        pages.append(Page(0, 612.0, 792.0, made))
    page, *box, size, chars = columns(pages)
    gutter = B.gutters(page, size, chars, 612.0)
    assert gutter.tolist() == [O.least_gutter(p) for p in pages]
    got = B.orders(page, *box, size, gutter, 792.0)
    at = B.starts_of(page)
    names = lambda bs: [b.text for b in bs]
    want = [names(O.xy_cut(list(p.blocks), O.least_gutter(p), p.height)) for p in pages]
    assert [[f"b{k - a + 1}" for k in got[a : a + len(p.blocks)].tolist()] for a, p in zip(at.tolist(), pages)] == want
    small = [minimize(p) for p in pages]
    assert B.fewest(page, *box, size, chars, 612.0, 792.0).tolist() == [len(p.blocks) if p else 0 for p in small]


def test_deep_cuts():
    """A page that is cut as often as it has blocks, deeper than calls may go."""
    n = 3000
    page, one = np.zeros(n, np.int64), np.arange(n, dtype=np.float64)
    got = B.orders(page, one * 0, one * 100, one * 0 + 10, one * 100 + 10, one * 0 + 10, np.array([2.0]), 792.0)
    assert got.tolist() == list(range(n))[::-1]


def test_page_queries_against_single_pages(spark, monkeypatch):
    """What the queries do with many pages at once is what the operators do with each, also over small batches."""
    by = {}
    for r in queries.boxes(spark, TINY).collect():
        by.setdefault(r["page"], []).append(r)
    want = {"ord_xy_cut": set(), "min_reordered_pages": set(), "reg_table_components": set(), "reg_ruled_grids": set()}
    for n, rows in by.items():
        rows.sort(key=lambda r: r["ord"])
        blocks = [block(f"b{r['ord']}", Box(5 * r["l"], 5 * r["b"], 5 * r["l"] + r["l_quantity"], 5 * r["b"] + 12), r["size"]) for r in rows]
        rules = [Graphic("stroke", Box(r["l"], r["b"], r["l"] + 1, r["t"]) if r["ord"] % 2 else Box(r["l"], r["b"], r["r"], r["b"] + 1), r["ord"]) for r in rows]
        p = Page(0, 612.0, 792.0, blocks, rules)
        want["ord_xy_cut"] |= {(n, i, b.text) for i, b in enumerate(O.xy_cut(list(blocks), O.least_gutter(p), p.height))}
        d = reorder_rank([p])[0]["distance"]
        want["min_reordered_pages"].add((n, d, len(minimize(p).blocks) if d else 0))
        want["reg_table_components"] |= {(n, *map(float, r.box)) for r in ruled_tables(p)}
        grid = grid_cells(hull(g.box for g in rules if is_rule(g)), rules, blocks) or []
        want["reg_ruled_grids"] |= {(n, i, j, t) for i, row in enumerate(grid) for j, t in enumerate(row)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(queries, "PAGE_ROWS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for name, rows in want.items():
            got = [tuple(r) for r in queries.QUERIES[name](spark, TINY).collect()]
            assert len(got) == len(rows) and set(got) == rows, name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    """Whatever the session's number of partitions, a larger table has more of them, and one shuffle serves a page."""
    monkeypatch.setattr(queries, "TASK_BYTES", 1000)
    for name in ("win_style_breaks", "reg_open_table_rows", "ord_xy_cut", "min_reordered_pages", "reg_table_components", "reg_ruled_grids"):
        df = queries.QUERIES[name](spark, TINY)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, name
    assert queries.boxes(spark, TINY).rdd.getNumPartitions() > 20
