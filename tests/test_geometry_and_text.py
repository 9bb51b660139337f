import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.model import Box, hull, upper_median
from quire.operators import phrases as P
from quire.operators.markdown import giou, iou
from quire.operators.regions import bands, find_sets

number = st.integers(0, 60).map(float)
boxes = st.builds(lambda l, b, w, h: Box(l, b, l + w, b + h), number, number, number, number)


@given(boxes, boxes)
def test_overlap_measures(a, b):
    assert iou(a, b) == pytest.approx(iou(b, a)) and 0 <= iou(a, b) <= 1
    assert -1 <= giou(a, b) <= iou(a, b) + 1e-12
    if a.area > 0:
        assert iou(a, a) == 1 and giou(a, a) == 1
    around = hull([a, b])
    assert around.holds_center(a) and around.holds_center(b)


def test_columns_agree_with_python(spark):
    pts = [Box(0, 0, 10, 10), Box(5, 5, 15, 15), Box(0, 0, 0, 0), Box(20, 0, 30, 5), Box(2, 2, 4, 4), Box(10, 0, 12, 30)]
    rows = [tuple(map(float, (*a, *b))) for a in pts for b in pts]
    df = spark.createDataFrame(rows, ", ".join(f"{p}_{c} double" for p in "ab" for c in "lbrt"))
    a, b = G.box("a"), G.box("b")
    G.register(spark)
    got = df.select("*", G.iou(a, b).alias("iou"), G.giou(a, b).alias("giou"), G.beside(a, b).alias("beside"), G.holds_center(a, b).alias("holds"), F.expr("box_iou(a_l,a_b,a_r,a_t,b_l,b_b,b_r,b_t)").alias("sql")).collect()
    for r in got:
        x, y = Box(*r[:4]), Box(*r[4:8])
        assert r["iou"] == pytest.approx(iou(x, y)) == r["sql"] and r["giou"] == pytest.approx(giou(x, y))
        assert r["beside"] == x.beside(y) and r["holds"] == x.holds_center(y)


TEXTS = ["- a", "* b", "• c", "-d", "1. x", "12) y", "1.x", "Figure 3: z", "fig. 2", "Fig 1", "Table  7", "tables 1", "7 Intro", "7.2.1: T", "7. T", "IV. Part", "MMMMMMM. x", "Chapter 3", "section B:", "Part Time", "Appendix a", "†note", "*note", "* note", "¹ x", "⁴ x", "123 x", "1234 x", "12.x", "", "   ", "été", "Été", "end.", "end?! ", "a-", "b‐", "x = 1 + 2", "Σ x", "Page 1 of 22", "1 2 3 4"]


def test_text_columns_agree_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    rows = df.select("t", X.is_list_item(t).alias("item"), X.is_caption(t).alias("caption"), X.has_heading_number(t).alias("heading"), X.has_footnote_mark(t).alias("foot"), (X.math_density(t) >= P.MATH_SHARE).alias("math"), X.running_text(t).alias("running"), X.starts_lower(t).alias("lower"), X.ends_in(t, ".?!").alias("ended"), X.join_hyphenated(t, F.lit(" next")).alias("joined")).collect()
    for r in rows:
        x = r["t"]
        assert (r["item"], r["caption"], r["heading"], r["foot"]) == (P.is_list_item(x), P.is_caption(x), P.has_heading_number(x), P.has_footnote_mark(x)), x
        assert r["math"] == P.is_mathematical(x) and r["ended"] == P.ends_in(x, ".?!") and r["lower"] == x.lstrip()[:1].islower(), x
        assert r["joined"] == P.join_hyphenated(x, " next")
        if not any(c.isupper() and not c.isascii() for c in x):
            assert r["running"] == P.running_text(x), x


@pytest.mark.parametrize(("text", "want"), [("1 2", "# "), ("Page 12 of 3", "page # of #"), ("a1b22", "a#b#"), ("  A   b ", "a b")])
def test_running_text(text, want):
    assert P.running_text(text) == want


def test_upper_median(spark):
    assert [upper_median(x) for x in ([1, 2, 3, 4], [3, 1, 2], [])] == [3, 2, None]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([3.0, 1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(X.upper_median(F.col("v"))).collect()] == [3.0, 2.0, None]


class Item:
    def __init__(self, box):
        self.box = box


@settings(max_examples=150)
@given(st.lists(boxes, max_size=9))
def test_bands_are_islands(bs):
    """Components of overlapping extents are the islands that a running maximum finds."""
    items = [Item(b) for b in bs]
    want = {frozenset(map(id, band)) for band in bands(items)}
    islands, reach = [], -math.inf
    for x in sorted(items, key=lambda i: (i.box.bottom, i.box.top)):
        if not islands or x.box.bottom >= reach:
            islands.append([])
        islands[-1].append(x)
        reach = max(reach, x.box.top)
    assert {frozenset(map(id, i)) for i in islands} == want


def test_find_sets():
    links = {(0, 3), (3, 4), (1, 2)}
    assert sorted(map(sorted, find_sets(6, lambda i, j: (i, j) in links))) == [[0, 3, 4], [1, 2], [5]]


def test_running_key_as_in_sql(spark):
    """The report's form of a running head is that of its SQL also where numbers follow each other."""
    import duckdb

    from quire.queries import _RUNNING

    texts = [*TEXTS, "+1 (2) 3-4 56 on", "1 2.3.4 x", "tel. 1 2", "7 7a 7", "a\x0bb 1\x0b2", "1\u00a02\u30003 ", "x\x011 \x012", "\u0085 A 1 \u0085"]
    body = spark.createDataFrame([(t,) for t in texts], "body string")
    got = [r[0] for r in body.select(X.running_key(F.col("body"))).collect()]
    want = duckdb.execute(f"SELECT list_transform($1, lambda body: {_RUNNING})", [texts]).fetchall()[0][0]
    assert got == want and "+# (#) #-# on" in got and "#.#.# x" in got
