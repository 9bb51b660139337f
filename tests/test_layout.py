import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.model import Block, Box, Char, Graphic, Line, Page, Region, Word, hull
from quire.operators import grouping as Gr
from quire.operators import markdown as M
from quire.operators import reading_order as O
from quire.operators import regions as R


def line(text, left, bottom, right, top, size=10.0, font="Plain"):
    box = Box(left, bottom, right, top)
    return Line(text, box, [Word(text, box, [Char(c, box, font, size) for c in text])])


def block(*lines):
    return Block(hull(x.box for x in lines), list(lines))


def one(text, left, bottom, right, top, size=10.0, font="Plain"):
    return block(line(text, left, bottom, right, top, size, font))


def page(*blocks, graphics=(), index=0):
    return Page(index, 612.0, 792.0, list(blocks), list(graphics))


def run(text, x, y, size=10.0, step=6.0, font="F"):
    return [Char(c, Box(x + i * step, y, x + (i + 1) * step, y + size), font, size) for i, c in enumerate(text)]


def test_words_lines_blocks():
    chars = run("Hello world", 72, 700) + run("next line", 72, 686) + run("far below", 72, 600)
    bs = Gr.group(chars)
    assert [b.text for b in bs] == ["Hello world\nnext line", "far below"]
    assert [w.text for w in bs[0].lines[0].words] == ["Hello", "world"]


def test_scripts_stay_with_their_base():
    base = run("x", 72, 700)
    up = [Char("2", Box(78, 705, 81, 711), "F", 6.0)]
    assert [w.text for w in Gr.words(base + up)] == ["x2"]
    assert [w.text for w in Gr.words(base + [Char("2", Box(95, 705, 98, 711), "F", 6.0)])] == ["x", "2"]
    assert len(Gr.words(run("x", 72, 700) + run("y", 78, 706))) == 2


def test_watermark_size_keeps_lines_apart():
    assert len(Gr.lines(Gr.words(run("body", 72, 700) + run("BIG", 110, 695, 40, 24)))) == 2


def test_empty_characters_still_form_words():
    assert [w.text for w in Gr.words([Char(None, Box(0, 0, 5, 10), "", 10.0)])] == [""]


@settings(max_examples=100)
@given(st.text(alphabet="ab \t", max_size=40))
def test_grouping_keeps_every_visible_character(text):
    bs = Gr.group(Gr.typeset(text))
    assert "".join(b.text for b in bs).replace(" ", "").replace("\n", "") == "".join(text.split())


def test_style_breaks():
    b = block(line("Heading", 72, 700, 150, 714, 14.0), line("text", 72, 686, 150, 696), line("bold", 72, 674, 150, 684, font="X-Bold"))
    assert [x.text for x in Gr.split_styles([b])] == ["Heading", "text", "bold"]
    plain = block(line("a", 0, 0, 1, 1), line("b", 0, 0, 1, 1))
    assert Gr.split_styles([plain]) == [plain]


def glyphs(text, gaps=None, x=50.0):
    out, y = [], 100.0
    for i, c in enumerate(text):
        out.append(line(c, x, y, x + 8, y + 6))
        y += 6 + (gaps or {}).get(i, 0.0)
    return out


def test_rotated_runs():
    (b,) = Gr.merge_rotated([block(*glyphs("SIDEBAR", {3: 3.0}))])
    assert [x.text for x in b.lines] == ["SIDE BAR"]
    assert len(Gr.merge_rotated([block(*glyphs("AB"))])[0].lines) == 2
    loose = block(*glyphs("12345", {i: 3.0 for i in range(5)}))
    assert len(Gr.merge_rotated([loose])[0].lines) == 5
    ragged = block(*[line(c, 50 + 9 * i, 100 + 6 * i, 58 + 9 * i, 106 + 6 * i) for i, c in enumerate("ABCD")])
    assert len(Gr.merge_rotated([ragged])[0].lines) == 4


def rules(*boxes):
    return [Graphic("stroke", Box(*b), i) for i, b in enumerate(boxes)]


GRID = rules((100, 100, 300, 101), (100, 200, 300, 201), (100, 150, 300, 151), (100, 100, 101, 200), (299, 100, 300, 200), (200, 100, 201, 200))


def test_ruled_tables_and_cells():
    p = page(one("a", 110, 160, 130, 170), one("b", 210, 160, 230, 170), one("wide", 150, 110, 250, 120), graphics=GRID)
    (t,) = R.ruled_tables(p)
    assert t.box == Box(100, 100, 300, 201) and t.confidence == 0.75
    assert R.grid_cells(t.box, p.graphics, p.blocks) == [["a", "b"], ["wide", "wide"]]
    assert R.ruled_tables(page(graphics=rules((0, 0, 100, 1)))) == []
    assert R.grid_cells(t.box, [], p.blocks) is None


def test_pictures():
    text = one("t", 100, 400, 200, 410)
    kinds = lambda *g: [r.confidence for r in R.pictures(page(text, graphics=g))]
    assert kinds(Graphic("image", Box(300, 100, 400, 200))) == [0.7]
    assert kinds(Graphic("image", Box(0, 0, 612, 792))) == []
    assert kinds(Graphic("fill", Box(300, 100, 330, 130))) == [0.5]
    assert kinds(Graphic("fill", Box(300, 100, 320, 120))) == kinds(Graphic("fill", Box(90, 390, 210, 420))) == kinds(Graphic("shading", Box(300, 100, 400, 200))) == []


@pytest.mark.parametrize(
    ("b", "others", "kind"),
    [
        (one("Running", 72, 750, 200, 760), [one("body text", 72, 300, 500, 310)], "page_header"),
        (one("3", 300, 20, 310, 30), [one("body text", 72, 300, 500, 310)], "page_footer"),
        (one("1 A note", 72, 120, 200, 128, 8.0), [one("body text here", 72, 300, 500, 310)], "footnote"),
        (one("- item", 72, 400, 200, 410), [one("body", 72, 300, 500, 310)], "list_item"),
        (one("Figure 1: x", 72, 400, 200, 410), [one("body", 72, 300, 500, 310)], "caption"),
        (one("2.1 Methods", 72, 400, 200, 410), [one("body", 72, 300, 500, 310)], "section_header"),
        (one("2.1 Methods end.", 72, 400, 200, 410), [one("body", 72, 300, 500, 310)], "text"),
        (one("Great Title", 72, 400, 200, 420, 20.0), [one("body text that is long", 72, 300, 500, 310)], "title"),
        (one("Bold head", 72, 400, 200, 410, font="A-Bold"), [one("body text that is long", 72, 300, 500, 310)], "section_header"),
        (one("E = m + c2", 256, 400, 356, 410), [one("body", 72, 300, 500, 310)], "formula"),
        (one("Plain words", 72, 400, 200, 410), [one("body", 72, 300, 500, 310)], "text"),
    ],
)
def test_rules_of_the_cascade(b, others, kind):
    found = R.classify([page(b, *others)])
    assert next(r.kind for r in found if r.box == b.box) == kind


def test_repeated_heads_and_second_title():
    head = lambda n: one(f"Report page {n}", 72, 740, 200, 750)
    near = one("close below", 72, 735, 200, 739)
    pages = [page(head(1), near), Page(1, 612.0, 792.0, [head(2), near])]
    assert [r.kind for r in R.classify(pages) if r.box == head(1).box] == ["page_header", "page_header"]
    big = [one("First", 72, 500, 200, 520, 20.0), one("Second", 72, 400, 200, 420, 20.0), one("a body of small text", 72, 300, 400, 310)]
    assert [r.kind for r in R.classify([page(*big)])] == ["title", "section_header", "text"]


def test_tables_without_rules():
    rows = [one(t, x, y, x + 40, y + 10) for y, ts in ((500, "ab"), (480, "cd")) for t, x in zip(ts, (100, 300))]
    (t,) = [r for r in R.classify([page(*rows)]) if r.kind == "table"]
    assert t.box == Box(100, 480, 340, 510)
    b = block(*[line(f"aa   {i}", 100, 500 - 12 * i, 300, 510 - 12 * i) for i in range(3)])
    assert R.corridors(b) and not R.corridors(block(b.lines[0]))


def test_columns_are_read_one_after_the_other():
    left = [one(f"l{i}", 72, 600 - 30 * i, 290, 620 - 30 * i) for i in range(3)]
    right = [one(f"r{i}", 320, 600 - 30 * i, 540, 620 - 30 * i) for i in range(3)]
    mixed = [b for pair in zip(left, right) for b in pair]
    assert [b.text for b in O.assemble([page(*mixed)])[0].blocks] == ["l0", "l1", "l2", "r0", "r1", "r2"]


@settings(max_examples=100)
@given(st.lists(st.tuples(*[st.integers(0, 500)] * 2, *[st.integers(1, 200)] * 2), max_size=12))
def test_reading_order_is_a_permutation(raw):
    bs = [one(str(i), l, b, l + w, b + h) for i, (l, b, w, h) in enumerate(raw)]
    p = page(*bs)
    out = O.xy_cut(list(bs), O.least_gutter(p), p.height)
    assert sorted(map(id, out)) == sorted(map(id, bs))


def test_stitching():
    a = page(one("a sentence that is un-", 72, 80, 500, 90))
    b = Page(1, 612.0, 792.0, [block(line("finished here", 72, 700, 500, 710), line("and more.", 72, 688, 500, 698))])
    c = Page(2, 612.0, 792.0, [one("New start.", 72, 700, 500, 710)])
    out = O.assemble([a, b, c])
    assert [[x.text for x in p.blocks] for p in out] == [["a sentence that is unfinished here\nand more."], [], ["New start."]]
    assert O.assemble([page(one("Done.", 72, 80, 500, 90)), b])[1].blocks


def test_markdown_of_every_class():
    items = [("title", "T"), ("section_header", "S"), ("list_item", "• one"), ("list_item", "2. two"), ("caption", "Figure 1"), ("footnote", "1 note"), ("formula", "x"), ("page_header", "gone"), ("text", "plain")]
    bs = [one(t, 72, 700 - 20 * i, 200, 710 - 20 * i) for i, (_, t) in enumerate(items)]
    rs = [Region(k, b.box, 0.5, 0) for (k, _), b in zip(items, bs)]
    assert M.structured([page(*bs)], rs) == "# T\n\n## S\n\n- one\n\n- 2. two\n\n*Figure 1*\n\n[^1]: 1 note\n\nx\n\nplain"


def test_page_breaks_and_pictures():
    a, b = page(one("A", 72, 700, 200, 710)), Page(1, 612.0, 792.0, [])
    c = Page(2, 612.0, 792.0, [one("C", 72, 700, 200, 710), one("inside", 110, 110, 120, 120)])
    rs = [Region("picture", Box(100, 100, 200, 200), 0.7, 2)]
    assert M.structured([a, b, c], rs) == "A\n\n---\n\n\n\n---\n\nC\n\n![]()"
    assert M.structured([a, b, c], rs, M.Options(False, False)) == "A\n\nC"


def test_tables_as_markdown():
    p = page(one("a|b", 110, 160, 130, 170), one("b", 210, 160, 230, 170), one("c", 110, 110, 130, 120), graphics=GRID)
    rs = [Region("table", Box(100, 100, 300, 201), 0.75, 0)]
    assert M.page_markdown(p, rs, p.graphics) == "| a\\|b | b |\n| --- | --- |\n| c |  |"
    assert M.page_markdown(p, rs) == "| a\\|b | b |\n| --- | --- |\n| c |"


def test_region_of_a_block():
    b = one("x", 0, 0, 100, 100)
    near, far = Region("text", Box(0, 0, 100, 95), 0.5, 0), Region("title", Box(0, 0, 50, 50), 0.5, 0)
    same = Region("caption", b.box, 0.5, 0)
    assert M.region_of(b, [far, near]) == near and M.region_of(b, [near, same]) == same and M.region_of(b, [far]) is None
    assert M.region_of(b, [near, near._replace(kind="formula")]).kind == "formula"
