import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire import queries
from quire.operators import metrics as M
from quire.operators import tables as T

CELL = st.tuples(st.sampled_from(["td", "td", "td", "th"]), st.sampled_from(["", "", "", " colspan=2", " rowspan=2", " bbox='1 2 3 4'"]), st.sampled_from(["", "a", "ab", " 12 ", "12345", "x>y", "é", "long text of more than twenty-four", "a\x85"]))
TABLE = st.lists(st.lists(CELL, max_size=4), max_size=4).map(lambda rows: "<table>" + "".join("<tr>" + "".join(f"<{t}{a}>{x}</{t}>" for t, a, x in r) + "</tr>" for r in rows) + "</table>")
ODD = st.sampled_from(["", "<table>", "<table><tr><td>x", "<TABLE><tr><td>a</td></tr></TABLE>", "<table><tbody><tr><td>a<td>b</tr></tbody></table>", "<table><td>a</td></table>", "<table></table></table>", "İ<table><tr><td>a</td></tr></table>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TABLE | ODD, TABLE | ODD), min_size=1, max_size=8))
def test_many_pairs_are_alike_as_single_ones(pairs):
    got = T.similarities([a for a, _ in pairs], [b for _, b in pairs])
    want = [(M.teds_struct(a, b), M.teds(a, b), M.teds_iou(a, b)) for a, b in pairs]
    assert np.array(got).T.tolist() == [list(map(float, w)) for w in want]


def test_pairs_in_pieces_and_with_boxes(monkeypatch):
    """A shape's pairs may be too many for one go; boxes, which no attribute can hold yet, are looked at pair by pair."""
    r = random.Random(0)
    make = lambda: "<table>" + "".join(f"<tr><td>{r.randrange(99999)}</td><td>{r.choice('ANR')}</td></tr>" for _ in range(r.randrange(1, 4))) + "</table>"
    a, b = [make() for _ in range(80)], [make() for _ in range(80)]
    monkeypatch.setattr(T, "CELLS", 100)
    assert T.similarities(a, b)[1].tolist() == [M.teds(x, y) for x, y in zip(a, b)]
    monkeypatch.setattr(M, "_box", lambda v: M.Box(0.0, 0.0, 4.0, float(v)) if v else None)
    c = ["<table><tr><td bbox=4>a</td></tr></table>", "<table><tr><td bbox=3>a</td></tr></table>", a[0]]
    assert T.similarities(c, c[::-1])[2].tolist() == [M.teds_iou(x, y) for x, y in zip(c, c[::-1])]


def test_a_step_is_taken_for_all_pairs_of_two_shapes(monkeypatch):
    """The steps of the tree distance are as many for a thousand pairs as for one."""
    calls = []
    own = T._distance
    monkeypatch.setattr(T, "_distance", lambda *x: calls.append(0) or own(*x))
    monkeypatch.setattr(M, "tree_distance", lambda *_: pytest.fail("a pair on its own"))
    a = [f"<table><tr><td>{i}</td><td>R</td></tr></table>" for i in range(1001)]
    T.similarities(a[:-1], a[1:])
    assert 1 <= len(calls) <= 3


def test_query_compares_with_the_next_order(spark, monkeypatch):
    tiny = "/root/testdata/sf0.001"
    li, own = (spark.read.parquet(f"{tiny}/{t}.parquet").collect() for t in ("lineitem", "orders"))
    cells, orders = {}, {}
    for r in li:
        cells.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_partkey"], r["l_returnflag"]))
    html = {k: "<table>" + "".join(f"<tr><td>{p}</td><td>{f}</td></tr>" for _, p, f in sorted(v)) + "</table>" for k, v in cells.items()}
    for r in own:
        if r["o_orderkey"] in html:
            orders.setdefault(r["o_custkey"], []).append(r["o_orderkey"])
    want = {(x, M.teds_struct(html[x], html[y]), M.teds(html[x], html[y]), M.teds_iou(html[x], html[y])) for v in orders.values() for x, y in zip(sorted(v), sorted(v)[1:])}
    monkeypatch.setattr(queries, "PAIR_ROWS", 50)
    got = [tuple(r) for r in queries.QUERIES["met_table_similarity"](spark, tiny).collect()]
    assert len(got) == len(want) and set(got) == want
