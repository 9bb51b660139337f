import json

import duckdb
import pytest

import __spark_entry__
from quire import cli, queries
from quire.model import CHARS, GRAPHICS
from quire.operators.grouping import typeset
from quire.operators.markdown import Options
from quire.plans import document as D
from quire.sources import pdf
from quire.streaming.documents import markdown_stream

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def char_rows(doc, text, page=0, size=10.0):
    return [(doc, page, i, c.text, *map(float, c.box), c.font, float(c.size), None, 0.0) for i, c in enumerate(typeset(text, size))]


def test_character_tables_to_markdown(spark):
    rows = char_rows("a", "\n- first\n- second\n\n\n\n\nSome plain words here.") + char_rows("b", "Other")
    rows.append(("bad", 0, 0, "x", None, 0.0, 1.0, 1.0, "F", 10.0, None, 0.0))
    chars = spark.createDataFrame(rows, CHARS)
    got = {r["doc_id"]: r for r in D.markdown_table(chars).collect()}
    assert got["a"]["markdown"] == "- first\n- second\n\nSome plain words here." and got["a"]["error"] is None
    assert got["bad"]["markdown"] == "" and "no box" in got["bad"]["error"]
    blocks = D.blocks_table(chars).where("doc_id = 'a'").orderBy("block").collect()
    assert [b["text"] for b in blocks] == ["- first\n- second", "Some plain words here."] and blocks[0]["size"] == 10.0
    graphics = spark.createDataFrame([("a", 0, 0, "image", 300.0, 100.0, 400.0, 200.0, 1.0, True, False)], GRAPHICS)
    regions = D.regions_table(chars, graphics).where("doc_id = 'a'").orderBy("region").collect()
    assert [r["class"] for r in regions] == ["list_item", "text", "picture"]
    assert D.markdown_table(chars, graphics).where("doc_id = 'a'").first()["markdown"].endswith("\n\n![]()")
    assert D.markdown_table(chars.limit(0)).collect() == []


def test_columns_typeset_as_in_python(spark):
    text = "ab c\n\nd"
    df = D.typeset_chars(spark.createDataFrame([("x", text)], "doc_id string, text string"))
    got = [(r["ch"], round(r["left"], 3), round(r["top"], 3)) for r in df.orderBy("seq").collect()]
    assert got == [(c.text, round(c.box.left, 3), round(c.box.top, 3)) for c in typeset(text)]


@pytest.fixture
def pdfs(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.pdf").write_bytes(pdf.write_pdf([[("Big Title", 72, 700, 24), ("A line of text (with) marks.", 72, 600, 10), ("More text of the body.", 72, 588, 10)], [("Second page text here.", 72, 700, 10)]]))
    (folder / "two.pdf").write_bytes(b"not a file of that kind")
    (folder / "other.PDF").write_bytes(b"")
    return folder


def test_pdf_reader(spark, pdfs):
    chars, graphics, pages, errors = pdf.read_pdfs(spark, str(pdfs))
    md = D.markdown_table(chars, graphics, pages).collect()
    assert [r["markdown"] for r in md] == ["# Big Title\n\nA line of text (with) marks.\nMore text of the body.\n\n---\n\nSecond page text here."]
    assert pages.count() == 2 and [r["error"][:10] for r in errors.collect()] == ["ValueError"]


def test_pdf_graphics_and_compression():
    import zlib

    stream = zlib.compress(b"2 w 10 10 m 110 10 l S 0 0 50 50 re f BT /F1 12 Tf 1 0 0 1 72 700 Tm [(AB) -500 (C)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Pages /Kids [2 0 R] /MediaBox [0 0 200 300] >>\nendobj\n2 0 obj\n<< /Type /Page /Parent 1 0 R /Contents 3 0 R >>\nendobj\n3 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\n"
    chars, graphics, pages = pdf.parse_simple(data)
    assert "".join(c["ch"] for c in chars) == "ABC" and pages == [{"page": 0, "width": 200.0, "height": 300.0}]
    assert [(g["kind"], g["z"]) for g in graphics] == [("stroke", 0), ("fill", 1)] and graphics[0]["stroke_width"] == 2


def test_stream_of_files(spark, pdfs, tmp_path):
    q = markdown_stream(spark, str(pdfs), Options(page_breaks=False)).writeStream.format("memory").queryName("md").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = {r["doc_id"].rsplit("/", 1)[1]: r for r in spark.table("md").collect()}
    assert rows["one.pdf"]["markdown"].endswith("body.\n\nSecond page text here.") and rows["two.pdf"]["error"]


def test_command_line(spark, pdfs, tmp_path, capsys):
    assert [p.name for p in cli.resolve([str(pdfs)])] == ["one.pdf", "two.pdf"]
    with pytest.raises(FileNotFoundError):
        cli.resolve(["/nowhere.pdf"])
    with pytest.raises(SystemExit):
        cli.arguments(["x", "--jobs", "0"])
    assert cli.main([str(pdfs / "one.pdf"), "--no-page-breaks"]) == 0
    assert capsys.readouterr().out.startswith("# Big Title\n\n")
    assert cli.main([str(pdfs)]) == 2
    assert cli.main([str(pdfs), "--out", str(tmp_path / "out"), "--quiet"]) == 1
    assert (tmp_path / "out/two.md").read_text() == "" and (tmp_path / "out/one.md").read_text().startswith("# Big")


def rows_of(df):
    cols = sorted(df.columns)
    fix = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else int(v) if hasattr(v, "item") and not isinstance(v, bool) else v
    return sorted((tuple(map(fix, r)) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, TINY).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and [repr(x) for x in rows_of(got)] == [repr(x) for x in rows_of(want)]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, TINY).count() > 0


def test_ruled_grids_against_brute_force(spark):
    """Every rule counts; of those within 3 points of each other the first; a block is in a grid that holds its centre."""
    pages, want, rules, merged = {}, set(), 0, 0
    for r in queries.boxes(spark, TINY).collect():
        pages.setdefault(r["page"], []).append(r)
    for page, rows in pages.items():
        rows.sort(key=lambda r: r["ord"])
        thin = [(r["l"], r["b"], r["l"] + 1, r["t"]) if r["ord"] % 2 else (r["l"], r["b"], r["r"], r["b"] + 1) for r in rows]
        thin = [x for x in thin if (x[2] - x[0] <= 2 and x[3] - x[1] >= 10) or (x[3] - x[1] <= 2 and x[2] - x[0] >= 10)]
        cuts = {True: [], False: []}
        for l, b, r, t in thin:  # noqa: E741
            flat = r - l >= t - b
            at = (b + t) / 2 if flat else (l + r) / 2
            if any(-3 <= x - at <= 3 for x in cuts[flat]):
                merged += 1
            else:
                cuts[flat].append(at)
        rules += len(thin)
        if min(map(len, cuts.values())) < 2:
            continue
        left, low, right, high = (f(x) for f, x in zip((min, min, max, max), zip(*thin)))
        ys, xs = sorted(cuts[True])[::-1], sorted(cuts[False])
        for i in range(len(ys) - 1):
            for j in range(len(xs) - 1):
                cell = []
                for r in rows:
                    x0, y0 = 5 * r["l"], 5 * r["b"]
                    x1, y1 = x0 + float(r["l_quantity"]), y0 + 12
                    if left <= (x0 + x1) / 2 <= right and low <= (y0 + y1) / 2 <= high and y1 > ys[i + 1] and y0 < ys[i] and x1 > xs[j] and x0 < xs[j + 1]:
                        cell.append(f"b{r['ord']}")
                want.add((page, i, j, "<br>".join(cell)))
    got = [tuple(r) for r in queries.QUERIES["reg_ruled_grids"](spark, TINY).collect()]
    assert len(got) == len(want) and set(got) == want
    assert rules > 5000 and merged > 100 and sum(bool(x[3]) for x in want) > 100 and any("<br>" in x[3] for x in want)


def test_registry(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(queries.QUERIES) <= set(q)
    assert __spark_entry__.entry(spark).columns == ["doc_id", "markdown", "error"]
    json.dumps(o)
