import gzip
import hashlib

from quire.llm import warc

SCHEMA = "page_id bigint, url string, html string, key string"
PAGES = [
    (1, "https://a.example/x?y=1", "<html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- c --><p>One <b>two</b></p><script>var t='</p>';</script><ul><li>a</li><li>b&nbsp;c</li></ul></body></html>"),
    (2, None, None),
    (3, "http://b.example/\r\nX: y", ""),
    (None, "http://c.example", "<p>é" + "x" * 200_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k") for r in rows], SCHEMA)


def test_derivatives_refer_to_their_source(spark):
    rows = warc.derive(warc.responses(pages(spark))).collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        assert r["refers_to"] == r["source_id"] and r["digests_ok"] and r["error"] is None
        ((h, block, _),) = warc.read_records(r["record"])
        assert h["warc-type"] == r["type"] and h["warc-refers-to"] == r["source_id"] and h["warc-record-id"] == r["record_id"]
        assert h["warc-block-digest"] == warc.digest(block) == r["block_digest"] and h["warc-date"] == warc.DATE
    first = {r["type"]: r for r in rows if r["key"] == 1}
    ((_, text, _),) = warc.read_records(first["conversion"]["record"])
    assert text.decode() == "One two\na\nb c"
    ((_, meta, _),) = warc.read_records(first["metadata"]["record"])
    assert b"title: T & U\r\n" in meta and b"http-content-type: text/html; charset=utf-8\r\n" in meta
    assert f"source-payload-digest: {warc.digest(PAGES[0][2].encode())}".encode() in meta
    assert len({r["record_id"] for r in rows}) == len(rows)


def test_digest_is_sha1_in_base32():
    import base64

    assert warc.digest(b"abc") == "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_files_compressed_damaged_and_empty(spark):
    a, b = (warc.response_record(k, f"http://{k}.example", b"<p>hi") for k in (1, 2))
    info = warc.make_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x\r\n")
    wrong = a.replace(b"<p>hi", b"<p>ho")
    files = [(1, info + a + b), (2, gzip.compress(a) + gzip.compress(b)), (3, a + b[:-9]), (4, None), (5, b""), (6, b"rubbish"), (7, wrong), (1, info + a + b)]
    df = spark.createDataFrame(files, "key bigint, warc binary")
    rows = warc.derive(df).collect()
    n = lambda k: sum(r["key"] == k and r["error"] is None for r in rows)
    assert (n(1), n(2), n(3), n(4), n(5), n(6), n(7)) == (8, 4, 2, 0, 0, 0, 2)
    assert {r["key"] for r in rows if r["error"]} == {3, 6}
    assert [r["digests_ok"] for r in rows if r["key"] == 7] == [False, False]
    assert warc.derive(df.limit(0)).collect() == []


def http_record(key, body, *headers):
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return warc.make_record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{key}>"), ("WARC-Target-URI", f"http://{key}.example")], f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body)


def test_a_body_that_cannot_be_decoded_costs_its_own_record_only(spark):
    whole = gzip.compress(b"<p>hi")
    records = [http_record("a", whole, ("Content-Encoding", "gzip")), http_record("b", whole[:-12], ("Content-Encoding", "gzip")), http_record("c", b"junk", ("Content-Encoding", "deflate")), http_record("d", b"<p>ho")]
    rows = warc.derive(spark.createDataFrame([(1, b"".join(records))], "key bigint, warc binary")).collect()
    assert [(r["source_id"], r["type"]) for r in rows] == [("<urn:uuid:a>", "metadata"), ("<urn:uuid:a>", "conversion"), ("<urn:uuid:b>", None), ("<urn:uuid:c>", None), ("<urn:uuid:d>", "metadata"), ("<urn:uuid:d>", "conversion")]
    assert [bool(r["error"]) for r in rows] == [False, False, True, True, False, False]
    assert rows[2]["target_uri"] == "http://b.example" and rows[2]["record"] is None


def test_repeated_headers_are_kept_in_order():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nLink: <x>\r\n more\r\nSet-Cookie: b=2\r\n\r\nhi"
    out, _ = warc.derive_record({}, block)
    ((_, meta, _),) = warc.read_records(out[0][3])
    assert b"http-set-cookie: a=1\r\nhttp-link: <x> more\r\nhttp-set-cookie: b=2\r\n" in meta


def test_broken_pages_take_linear_time():
    import time

    for piece in ("<script ", "<!-- ", "<p ", "<title>", "<title ", "</script", "<style>x", "<head", "&amp", "<"):
        page = piece * (5_000_000 // len(piece))
        start = time.process_time()
        warc.derive_record({}, b"HTTP/1.1 200 OK\r\n\r\n" + page.encode())
        assert time.process_time() - start < 4, piece
    assert warc.to_text("a<script>x</script >b<!-- c --><script>d</SCRIPT>e<!-- f<style>g</style>h<script>i") == "a b e<!-- f hi"
    assert warc.title_of("<title>a</title><title>b</title>") == "a" and warc.title_of("<title>a<title>b") == ""


def test_coded_bodies(spark):
    import zlib

    chunked = b"5;x=y\r\n<p>he\r\nA\r\nllo there\n\r\n0\r\nTrailer: t\r\n\r\n"
    zipped = gzip.compress(b"<p>hi")
    bare = zlib.compressobj(wbits=-15)
    records = [
        http_record("a", chunked, ("Transfer-Encoding", "chunked")),
        http_record("b", b"%x\r\n" % len(zipped) + zipped + b"\r\n0\r\n\r\n", ("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")),
        http_record("c", b"\x8b\x02\x80hi\x03", ("Content-Encoding", "br")),
        http_record("d", b"5\r\nab", ("Transfer-Encoding", "chunked")),
        http_record("e", bare.compress(b"<p>raw") + bare.flush(), ("Content-Encoding", "deflate")),
        http_record("f", zlib.compress(gzip.compress(b"<p>two")), ("Content-Encoding", "gzip, deflate")),
    ]
    rows = warc.derive(spark.createDataFrame([(1, b"".join(records))], "key bigint, warc binary")).collect()
    text = {}
    for r in rows:
        if r["type"] == "conversion":
            ((_, block, _),) = warc.read_records(r["record"])
            text[r["source_id"][-2]] = block.decode()
    assert text == {"a": "hello there", "b": "hi", "e": "raw", "f": "two"}
    assert [r["source_id"][-2] for r in rows if r["error"]] == ["c", "d"]


def test_faults_leave_the_records_around_them(spark):
    a, b, c = (warc.response_record(k, f"http://{k}.example", b"<p>hi") for k in (1, 2, 3))
    cut = gzip.compress(a + b + c * 2000)
    files = [(1, cut[: len(cut) // 2]), (2, a + b.replace(b"Content-Length: 6", b"Content-Length: x").replace(b"Content-Length: 8", b"Content-Length: 9") + c), (3, a + b"WARC/1.1\r\nno header\r\n\r\n" + b + c), (None, a)]
    df = spark.createDataFrame([(*f, "x", "y") for f in files], "key bigint, warc binary, record string, error string")
    rows = warc.derive(df).collect()
    ok = lambda k: len({r["source_id"] for r in rows if r["key"] == k and r["error"] is None})
    assert ok(1) == 3 and sum(r["key"] == 1 and r["error"] is not None for r in rows) == 1
    assert ok(3) == 3 and ok(None) == 1 and ok(2) >= 2 and {r["key"] for r in rows if r["error"]} >= {1, 3}


def test_the_query_against_a_reading_of_every_page(spark):
    """Every page of the table: two records, linked, with digests, and text without a tag that the page's own words make up."""
    from quire.llm import queries

    sf = "/root/testdata/sf0.001"
    pages_ = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_warc_derivatives"](spark, sf).collect()
    assert sorted((r["key"], r["type"]) for r in rows) == sorted((k, t) for k in pages_ for t in ("metadata", "conversion"))
    for r in rows:
        page = pages_[r["key"]]
        ((h, block, _),) = warc.read_records(r["record"])
        assert r["digests_ok"] and h["warc-target-uri"] == r["target_uri"] == page["url"] and h["warc-refers-to"] == warc.record_id("response", str(r["key"]), page["url"])
        if r["type"] == "metadata":
            assert f"source-payload-digest: {warc.digest(page['html'].encode())}\r\n".encode() in block
        else:
            assert block.decode() == plain(page["html"])


def plain(page):
    """Text by a parser of its own kind: the standard library's."""
    from html.parser import HTMLParser

    blocks = "p div h1 h2 h3 h4 h5 h6 li ul ol table tr article section header footer nav blockquote pre main aside br hr".split()

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head", "noscript", "template")
            if not self.skip and tag in blocks:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head", "noscript", "template"):
                self.skip -= 1
                self.out.append(" ")
            elif not self.skip and tag in blocks:
                self.out.append("\n")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data.replace("\n", " "))

    p = Parser()
    p.feed(page)
    p.close()
    lines = (" ".join(x.replace("\xa0", " ").split(" ")).split() for x in "".join(p.out).split("\n"))
    return "\n".join(" ".join(x) for x in lines if x)
