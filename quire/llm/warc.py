"""WARC derivatives: metadata and plain-text conversion records linked to responses.

Every ``response`` record gives two records that refer to it by ``WARC-Refers-To``: one of
type ``metadata`` (``application/warc-fields``) with the source's HTTP status, headers and
digests, and one of type ``conversion`` with its text. Both carry the source's target URI and date.
Record ids follow from the source's id, so a repeated task makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
FIELDS = [("key", pa.int64()), ("source_id", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("block_digest", pa.string()), ("digests_ok", pa.bool_()), ("record", pa.binary()), ("error", pa.string())]
SCHEMA = "key bigint, source_id string, type string, record_id string, refers_to string, target_uri string, date string, block_digest string, digests_ok boolean, record binary, error string"
#: What damaged files and bodies raise.
FAULTS = (ValueError, OSError, EOFError, zlib.error)
_DROPPED = ("script", "style", "head", "noscript", "template")
_OPEN = re.compile(rf"<(?:!--|({'|'.join(_DROPPED)})\b)", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in _DROPPED} | {"": re.compile("-->")}
_BLOCK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|table|tr|article|section|header|footer|nav|blockquote|pre|main|aside)\b|[bh]r\b)[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[\n ]*")
_TITLE, _TITLE_END = re.compile(r"<title[^<>]*>", re.I), re.compile(r"</title", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def record_id(*names: str) -> str:
    """A record id that depends on nothing but ``names``."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(names).encode()).digest()[:16], version=5)}>"


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; the values' line breaks become spaces."""
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_record(key: int | None, url: str, body: bytes, date: str = DATE, mime: str = "text/html; charset=utf-8") -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return make_record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(key), url)), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def _headers(raw: bytes) -> list[tuple[str, str]]:
    """Headers in order, names in lower case; repeated ones each."""
    out: list[tuple[str, str]] = []
    for line in raw.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + text.strip())
        elif ":" in text:
            k, v = text.split(":", 1)
            out.append((k.strip().lower(), v.strip()))
    return out


def inflate(data: bytes, step: int = 1 << 16) -> tuple[bytes, Exception | None]:
    """What a file of gzip members holds, up to a fault if it has one, and the fault."""
    out, at = [], 0
    try:
        while at < len(data):
            d = zlib.decompressobj(31)
            while at < len(data) and not d.eof:
                part = data[at : at + step]
                out.append(d.decompress(part))
                at += len(part) - len(d.unused_data)
            if not d.eof:
                raise EOFError("compressed file ends early")
            while data[at : at + 1] == b"\0":
                at += 1
    except (zlib.error, EOFError) as e:
        return b"".join(out), e
    return b"".join(out), None


def read_records(data: bytes):
    """``(headers, block, fault)`` of every record of a plain or gzip-compressed file; headers by lower-case name.

    A record that can't be read has no headers and no block, but a fault; reading goes on at the next one that begins behind an empty line.
    """
    fault = None
    if data[:2] == b"\x1f\x8b":
        data, fault = inflate(data)
    i = 0
    while True:
        while data[i : i + 2] == b"\r\n":
            i += 2
        if i >= len(data):
            break
        why, n = None, -1
        end = data.find(b"\r\n\r\n", i)
        if data[i : i + 5] != b"WARC/":
            why = f"no record at byte {i}"
        elif end < 0:
            why = "header without end"
        else:
            h = dict(_headers(data[data.index(b"\r\n", i) + 2 : end]))
            size = h.get("content-length", "")
            n = int(size) if size.isascii() and size.isdigit() else -1
            if n < 0 or end + 4 + n > len(data):
                why = "block cut short" if n >= 0 else "no length"
        if why is None:
            yield h, data[end + 4 : end + 4 + n], None
            i = end + 4 + n
            continue
        if fault is None or data.find(b"\r\n\r\nWARC/", i) >= 0:
            yield None, None, ValueError(why)
        i = data.find(b"\r\n\r\nWARC/", i)
        if i < 0:
            break
    if fault is not None:
        yield None, None, fault


def _drop(source: str) -> str:
    """``source`` with comments, scripts, styles and the like as one space each; what is never closed stays.

    Every closing mark is looked for once: if there is none behind one place, there is none behind the next.
    """
    out, kept, at, never = [], 0, 0, set()
    while m := _OPEN.search(source, at):
        at, kind = m.end(), (m[1] or "").lower()
        if kind in never:
            continue
        end = _CLOSE[kind].search(source, at)
        if end is None:
            never.add(kind)
            continue
        out += [source[kept : m.start()], " "]
        kept = at = end.end()
    return "".join([*out, source[kept:]]) if out else source


def to_text(source: str) -> str:
    """The text of an HTML page: scripts, styles, head and comments go, blocks become lines. Linear in the page, closed or not."""
    t = _TAG.sub("", _BLOCK.sub("\n", _drop(source).replace("\n", " ")))
    if "&" in t:
        t = html.unescape(t)
    return _LINES.sub("\n", _SPACES.sub(" ", t)).strip()


def title_of(page: str) -> str:
    """The text of the first title that is closed."""
    m = _TITLE.search(page)
    end = _TITLE_END.search(page, m.end()) if m else None
    return to_text(page[m.end() : end.start()]) if end else ""


def _dechunk(body: bytes) -> bytes:
    """A body of ``Transfer-Encoding: chunked`` in one piece; trailers go."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk without size")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n > len(body):
            raise ValueError("chunk cut short")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if body[at : at + 2] == b"\r\n":
            at += 2


def _codings(value: str) -> list[str]:
    return [c for c in (x.strip().lower() for x in value.split(",")) if c and c != "identity"]


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """Status line, headers, body without transfer codings, and without content codings."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    h = _headers(rest)
    every = lambda name: [c for k, v in h if k == name for c in _codings(v)]
    for coding in reversed(every("transfer-encoding")):
        if coding != "chunked":
            raise ValueError(f"transfer coding {coding}")
        body = _dechunk(body)
    raw = body
    for coding in reversed(every("content-encoding")):
        if coding in ("gzip", "x-gzip"):
            raw = gzip.decompress(raw)
        elif coding == "deflate":
            try:
                raw = zlib.decompress(raw)
            except zlib.error:  # many senders leave the wrapper out
                raw = zlib.decompress(raw, -15)
        else:
            raise ValueError(f"content coding {coding}")
    return status.decode("latin-1"), h, body, raw


def derive_record(h: dict[str, str], block: bytes):
    """The two derivatives of a response: type, id, digest of the block, record; and whether its digests hold."""
    status, http, entity, body = _http(block)
    source, uri, date = h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", "")
    # some writers take the payload's digest before transfer codings are undone, some after
    want = [(h.get("warc-payload-digest"), (block.partition(b"\r\n\r\n")[2], entity)), (h.get("warc-block-digest"), (block,))]
    ok = all(w is None or not w.lower().startswith("sha1:") or any(w.lower() == digest(b).lower() for b in bs) for w, bs in want)
    mime = dict(http).get("content-type", "")
    charset = (m := _CHARSET.search(mime)) and m[1] or "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    is_html = "html" in mime.lower() or not mime
    title = title_of(page) if is_html else ""
    fields = [("source-record-id", source), ("http-status", status), *((f"http-{k}", v) for k, v in http), ("source-payload-digest", h.get("warc-payload-digest", "")), ("source-block-digest", h.get("warc-block-digest", "")), ("charset", charset), ("title", title)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    text = (to_text(page) if is_html else page).encode()
    out = []
    for kind, mime_out, content in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        rid, d = record_id(kind, source), digest(content)
        head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", d), ("Content-Type", mime_out)]
        if payload := h.get("warc-payload-digest"):
            head.append(("WARC-Source-Payload-Digest", payload))
        out.append((kind, rid, d, make_record(head, content)))
    return out, ok


def derive(files: DataFrame, key_col: str = "key", warc_col: str = "warc") -> DataFrame:
    """Derivatives of all responses in a column of WARC bytes.

    Columns as in ``SCHEMA``; ``digests_ok`` says whether the source's own SHA-1 digests hold
    (missing ones do). Records that aren't responses are passed over. A response whose body can't
    be decoded, or is coded in a way not known here, gives one row with its source's id, target, date and ``error``, and the next ones follow. A
    record that can't be read, or the end of a damaged compressed file, gives one row with only ``key`` and ``error``, and what was sound
    before and after it its records; null and empty files give no row. Repeated rows are done each, null keys stay null,
    other columns are ignored. Time is linear in the file, however broken its pages. No rows give no rows.
    """

    def rows_of(key, data):
        for h, block, fault in read_records(data):
            source = None if h is None else h.get("warc-record-id")
            if h is not None and h.get("warc-type", "").lower() != "response":
                continue
            try:
                if fault is not None:
                    raise fault
                out, ok = derive_record(h, block)
            except FAULTS as e:
                yield (key, source, None, None, source, h and h.get("warc-target-uri"), h and h.get("warc-date"), None, None, None, f"{type(e).__name__}: {e}")
                continue
            for kind, rid, d, rec in out:
                yield (key, source, kind, rid, source, h.get("warc-target-uri"), h.get("warc-date"), d, ok, rec, None)

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if not raw.is_valid:
                    continue
                for row in rows_of(key, raw.as_py()):
                    rows.append(row)
                    size += len(row[9] or b"")
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return files.select(F.col(key_col).cast("bigint"), F.col(warc_col)).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*rows), FIELDS)], names=[n for n, _ in FIELDS])


def responses(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``key, warc``: a response record for every page; null URLs and bodies are empty."""

    def run(batches):
        for b in batches:
            out = [response_record(k, u or "", (t or "").encode(), date) for k, u, t in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["key", "warc"])

    return pages.select(F.col(key_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "key bigint, warc binary")
