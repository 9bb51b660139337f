import random
import struct

from quire.llm import ogg


def crc_bit_by_bit(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r >> 31 else 0)) & 0xFFFFFFFF
    return r


def head(skip=312):
    return b"OpusHead\x01\x02" + struct.pack("<H", skip) + struct.pack("<I", 48000) + b"\0\0\0"


def stream(serial, sizes, segments=7):
    r = random.Random(serial)
    packets = [(head(), 0), (b"OpusTags" + b"\0" * 8, 0)]
    for k, n in enumerate(sizes, 1):
        packets.append((b"\x08" + bytes(r.randrange(256) for _ in range(n)), 312 + 960 * k))
    return packets, ogg.pages_of_stream(serial, packets, segments)


def test_checksum():
    r = random.Random(0)
    for n in (0, 1, 7, 300):
        data = bytes(r.randrange(256) for _ in range(n))
        assert ogg.crc(data) == crc_bit_by_bit(data)


def test_packets_of_multiplexed_streams_come_back():
    sizes = [0, 1, 254, 255, 510, 3000, 253, 20]
    pa, a = stream(5, sizes)
    pb, b = stream(9, [100] * 5, 3)
    data = b"".join(p for pair in zip(a, b) for p in pair) + b"".join(a[len(b) :] + b[len(a) :])
    got = ogg.demultiplex(b"junk" + data)
    assert [x[0] for x in got[5].packets] == [p for p, _ in pa] and [x[0] for x in got[9].packets] == [p for p, _ in pb]
    assert [x[1] for x in got[5].packets[2:]] == [g for _, g in pa[2:]]
    assert got[5].codec == "opus" and got[5].damaged == got[9].damaged == 0


def test_damage_loses_only_what_it_held():
    packets, pages = stream(3, [600] * 30)
    bad = bytearray(b"".join(pages))
    at = len(b"".join(pages[:4])) + 40
    bad[at] ^= 1
    s = ogg.demultiplex(bytes(bad))[3]
    kept = [x[0] for x in s.packets]
    assert s.damaged == 2 and 0 < len(packets) - len(kept) <= 4 and all(p in [q for q, _ in packets] for p in kept)
    missing = ogg.demultiplex(b"".join(pages[:4] + pages[5:]))[3]
    assert [x[0] for x in missing.packets] == kept
    assert ogg.demultiplex(b"") == {} and ogg.demultiplex(b"OggS\0") == {}


def test_other_codecs_keep_their_clock():
    ident = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + b"\0" * 14
    pages = ogg.pages_of_stream(1, [(ident, 0), (b"\x03vorbis", 0), (b"\x05vorbis", 0), (b"x" * 50, 44100)])
    s = ogg.demultiplex(b"".join(pages))[1]
    assert (s.codec, s.rate, s.headers, s.packets[-1][1]) == ("vorbis", 44100, 3, 44100)


def test_conversations(spark):
    rows = [(1, 0, "user", "héllo"), (1, 1, "assistant", "w" * 70_000), (1, 2, None, ""), (1, 2, None, ""), (2, 0, "system", None), (None, 0, "user", "x"), (3, None, "user", "y")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, key string")
    out = ogg.packets(ogg.conversations_as_ogg(df)).collect()
    texts = sorted(r["data"][1:].decode() for r in out if r["seconds"] is not None)
    assert texts == sorted((t or "") for i, _, _, t in rows if i is not None)
    user = sorted((r["packet"], round(r["seconds"], 6)) for r in out if r["key"] == 1 and r["serial"] == 2 and r["seconds"] is not None)
    assert user == [(2, 0.02), (3, 0.04), (4, 0.06)]
    assert ogg.packets(spark.createDataFrame([(1, None), (2, b"")], "key bigint, ogg binary")).collect() == []
    assert ogg.packets(ogg.conversations_as_ogg(df.limit(0))).collect() == []


def test_chained_streams_of_one_serial_number(spark):
    pa, a = stream(5, [10, 300, 20])
    pb, b = stream(5, [40, 50], 2)
    data = b"".join(a + b)
    got = ogg.demultiplex(data)
    assert list(got) == [5, (5, 1)] and all(s.damaged == 0 and s.ended and s.codec == "opus" and s.headers == 2 for s in got.values())
    assert [x[0] for x in got[5].packets] == [p for p, _ in pa] and [x[0] for x in got[5, 1].packets] == [p for p, _ in pb]
    cut = ogg.demultiplex(b"".join(b[:-1]) + b[-1][:20])[5]
    assert not cut.ended and cut.damaged == 1
    rows = ogg.packets(spark.createDataFrame([(1, data, 3, "s"), (1, data, 3, "s"), (None, data, 3, "s")], "key bigint, ogg binary, serial int, data string")).collect()
    assert len(rows) == 3 * (len(pa) + len(pb)) and sum(r["key"] is None for r in rows) == len(pa) + len(pb)
    assert [(r["chain"], r["packet"]) for r in rows[: len(pa) + len(pb)]] == [(0, k) for k in range(len(pa))] + [(1, k) for k in range(len(pb))]


def test_the_query_against_a_reading_of_its_own(spark):
    """Every turn of the table as a packet, at its time: 20 ms apart within its role; two headers before."""
    from collections import defaultdict

    from quire.llm import queries

    sf = "/root/testdata/sf0.001"
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"], r["role"], r["text"])):
        turns[r["conv_id"], r["role"]].append(r["text"].encode())
    serial = {k: 1 + sorted(role for c, role in turns if c == k[0]).index(k[1]) for k in turns}
    got = defaultdict(list)
    for r in queries.QUERIES["op4_ogg_packets"](spark, sf).collect():
        assert (r["codec"], r["damaged"], r["chain"], r["ended"]) == ("opus", 0, 0, True) and r["n_bytes"] == len(r["data"])
        got[r["key"], r["serial"]].append((r["packet"], r["seconds"], bytes(r["data"])))
    assert set(got) == {(c, serial[c, role]) for c, role in turns}
    for (c, role), texts in turns.items():
        packets = sorted(got[c, serial[c, role]], key=lambda x: x[0])
        assert [p[2][1:] for p in packets[2:]] == texts and [p[2][:8] for p in packets[:2]] == [b"OpusHead", b"OpusTags"]
        assert [p[1] for p in packets[:2]] == [None, None] and all(abs(p[1] - 0.02 * k) < 1e-9 for k, p in enumerate(packets[2:], 1))
