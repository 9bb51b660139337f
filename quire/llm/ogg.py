"""Ogg containers in a binary column.

A container is a run of pages; every page belongs to one logical stream (serial number),
carries a checksum (CRC-32, polynomial 0x04C11DB7, not reflected) and up to 255 lacing values
that tell packets apart: a packet ends with the first value under 255 and may go on over
pages. A page's granule position is that of the last packet that ends on it.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_OPUS_MS = {**{c: (10, 20, 40, 60)[c % 4] for c in range(12)}, **{c: (10, 20)[c % 2] for c in range(12, 16)}, **{c: (2.5, 5, 10, 20)[c % 4] for c in range(16, 32)}}
FIELDS = [("key", pa.int64()), ("serial", pa.int64()), ("codec", pa.string()), ("packet", pa.int64()), ("granule", pa.int64()), ("seconds", pa.float64()), ("n_bytes", pa.int64()), ("data", pa.binary()), ("damaged", pa.int64()), ("chain", pa.int64()), ("ended", pa.bool_())]
SCHEMA = "key bigint, serial bigint, codec string, packet bigint, granule bigint, seconds double, n_bytes bigint, data binary, damaged bigint, chain bigint, ended boolean"


def crc(page: bytes) -> int:
    """Ogg's checksum, by way of the reflected CRC-32 over bit-reversed bytes."""
    r = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_REVERSED), "big")


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    p = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    p[22:26] = struct.pack("<I", crc(bytes(p)))
    return bytes(p)


def pages_of_stream(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> list[bytes]:
    """Pages of a stream of (packet, granule), each packet starting a page's worth of ``segments`` anew only when full."""
    lacing: list[tuple[int, bytes, int | None]] = []
    for data, granule in packets:
        n = len(data) // 255
        for k in range(n + 1):
            lacing.append((min(255, len(data) - 255 * k), data[255 * k : 255 * k + 255], granule if k == n else None))
    out = []
    for lo in range(0, len(lacing), segments):
        part = lacing[lo : lo + segments]
        ends = [g for _, _, g in part if g is not None]
        flags = (1 if lo and lacing[lo - 1][2] is None else 0) | (2 if lo == 0 else 0) | (4 if lo + segments >= len(lacing) else 0)
        out.append(make_page(serial, len(out), flags, ends[-1] if ends else -1, bytes(n for n, _, _ in part), b"".join(b for _, b, _ in part)))
    return out


def read_pages(data: bytes):
    """``(serial, number, flags, granule, lacing, body, good)`` of every page; rubbish between pages is skipped.

    A page whose checksum fails or that is cut short is reported with ``good`` false, and the search
    goes on behind its capture pattern.
    """
    i = 0
    while (i := data.find(b"OggS", i)) >= 0:
        if i + 27 > len(data):
            yield 0, 0, 0, -1, b"", b"", False
            return
        _, version, flags, granule, serial, number, want, n = _HEAD.unpack_from(data, i)
        lacing = data[i + 27 : i + 27 + n]
        end = i + 27 + n + sum(lacing)
        page = data[i:end]
        good = version == 0 and len(lacing) == n and end <= len(data) and crc(page[:22] + b"\0\0\0\0" + page[26:]) == want
        yield serial, number, flags, granule, lacing, page[27 + n :], good
        i = end if good else i + 4


def opus_samples(packet: bytes) -> int:
    """Duration of an Opus packet at 48 kHz, from its first bytes; 0 if malformed."""
    if not packet:
        return 0
    count = (1, 2, 2, packet[1] & 63 if len(packet) > 1 else 0)[packet[0] & 3]
    return int(_OPUS_MS[packet[0] >> 3] * 48) * count


class _Stream:
    def __init__(self):
        self.codec, self.rate, self.skip = "unknown", None, 0
        self.next = self.headers = None
        self.partial: list[bytes] | None = None
        self.packets: list[list] = []
        self.damaged = self.chain = 0
        self.ended = False

    def identify(self, packet: bytes) -> None:
        if packet[:8] == b"OpusHead" and len(packet) >= 12:
            self.codec, self.rate, self.headers = "opus", 48000, 2
            self.skip = struct.unpack_from("<H", packet, 10)[0]
        elif packet[:7] == b"\x01vorbis" and len(packet) >= 16:
            self.codec, self.rate, self.headers = "vorbis", struct.unpack_from("<I", packet, 12)[0] or None, 3
        elif packet[:5] == b"\x7fFLAC":
            self.codec, self.headers = "flac", 1
            if len(packet) >= 30:
                self.rate = int.from_bytes(packet[27:30], "big") >> 4 or None
        else:
            self.headers = 0


def demultiplex(data: bytes, rate: int | None = None) -> dict[int | tuple[int, int], _Stream]:
    """The logical streams of a container with their packets ``[bytes, granule or None]``, by serial number.

    A page that begins a stream (flag 2) of a number that was seen before begins another stream, chained to it: it goes by
    the number and its place in the chain. A page with the end flag ends its stream; pages that follow it all the same belong to it.

    After a damaged or missing page a packet that it held a part of is lost, and
    counted; the rest is read on. ``rate`` is for codecs that don't tell theirs.
    """
    streams: dict[int | tuple[int, int], _Stream] = {}
    links: dict[int, int] = {}
    lost = 0
    for serial, number, flags, granule, lacing, body, good in read_pages(data):
        if not good:
            lost += 1
            continue
        if flags & 2 and serial in links:
            links[serial] += 1
        n = links.setdefault(serial, 0)
        s = streams.setdefault((serial, n) if n else serial, _Stream())
        s.chain = n
        s.ended |= bool(flags & 4)
        if s.next is not None and number != s.next:
            s.damaged += 1
            s.partial = None
        s.next = number + 1
        goes_on = bool(flags & 1)
        if not goes_on:
            s.partial = []
        at, first, done = 0, goes_on and s.partial is None, []
        for n in lacing:
            piece = body[at : at + n]
            at += n
            if not first:
                if s.partial is None:
                    s.partial = []
                s.partial.append(piece)
            if n < 255:
                if not first:
                    done.append([b"".join(s.partial), None])
                first, s.partial = False, []
        if lacing and lacing[-1] < 255:
            s.partial = []
        elif first:
            s.partial = None
        if done and granule >= 0:
            done[-1][1] = granule
        for p in done:
            if s.headers is None:
                s.identify(p[0])
            s.packets.append(p)
    for s in streams.values():
        s.rate = s.rate or rate
        # within a page, Opus packets count back from its granule position
        if s.codec == "opus":
            later = None
            for k in range(len(s.packets) - 1, s.headers - 1, -1):
                p = s.packets[k]
                p[1] = p[1] if p[1] is not None else later
                later = None if p[1] is None else p[1] - opus_samples(p[0])
    if lost and streams:
        next(iter(streams.values())).damaged += lost
    return streams


def packets(files: DataFrame, key_col: str = "key", ogg_col: str = "ogg", rate: int | None = None) -> DataFrame:
    """Every packet of every logical stream of a column of Ogg bytes.

    ``granule`` is the position at the packet's end, null where the container doesn't give
    it; ``seconds`` is that over the stream's rate (less Opus's pre-skip), null for
    header packets. ``damaged`` counts, in every row of a stream, pages that failed their
    checksum or were missing (failed ones count with the first stream, as their serial number can't be
    trusted; a page cut short at the file's end is one). ``chain`` numbers the streams that follow one another under one serial number, from 0, each
    with its own packet numbers and headers; ``ended`` says whether the stream's last page was there. Null and empty files and files without a sound page give no row.
    Repeated rows are done each, null keys stay null, other columns are ignored, whatever their names; very long packets go over as many pages as they need. No rows give no rows.
    """

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if not raw.is_valid:
                    continue
                for name, s in demultiplex(raw.as_py(), rate).items():
                    serial = name[0] if isinstance(name, tuple) else name
                    for k, (data, granule) in enumerate(s.packets):
                        head = k < (s.headers or 0)
                        at = None if head or granule is None or not s.rate else (granule - s.skip) / s.rate
                        rows.append((key, serial, s.codec, k, granule, at, len(data), data, s.damaged, s.chain, s.ended))
                        size += len(data)
                if size > 4 << 20 or len(rows) > 20_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return files.select(F.col(key_col).cast("bigint"), F.col(ogg_col)).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*rows), FIELDS)], names=[n for n, _ in FIELDS])


def conversation_ogg(turns: list[tuple[str, bytes]]) -> bytes:
    """A container with one Opus-framed stream per role, its turns as packets of 20 ms."""
    by: dict[str, list[tuple[bytes, int]]] = {}
    for role, text in turns:
        p = by.setdefault(role, [(b"OpusHead\x01\x01" + struct.pack("<H", 312) + struct.pack("<I", 48000) + b"\0\0\0", 0), (b"OpusTags" + struct.pack("<I", 0) * 2, 0)])
        p.append((b"\x08" + text, 312 + 960 * (len(p) - 1)))
    streams = [pages_of_stream(k + 1, by[role], 16) for k, role in enumerate(sorted(by))]
    return b"".join(page for group in _zip_longest(streams) for page in group)


def _zip_longest(streams: list[list[bytes]]):
    for k in range(max((len(s) for s in streams), default=0)):
        yield [s[k] for s in streams if k < len(s)]


def conversations_as_ogg(turns: DataFrame) -> DataFrame:
    """``key, ogg``: every conversation (``conv_id, turn, role, text``) as a multiplexed container.

    Turns are ordered by number, then role and text; null text is empty and a null role ``user``.
    Rows without conversation id are dropped.
    """
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("key"), F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = t.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = [conversation_ogg([(x["role"], x["text"].encode()) for x in ts]) for ts in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["key", "ogg"])

    return convs.mapInArrow(run, "key bigint, ogg binary")
