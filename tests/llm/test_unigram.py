import struct

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import unigram as U
from quire.llm.queries import MODEL
from quire.llm.shared import text_parts

TEXTS = ["", " ", "\n", "Hello world\nfoo", "  a  b ", "日本語 テスト😀x", "a\tb", "the the the", "é́ ñandú", "\U00013000\U00013001 q", "x" * 700 + " yyy \n\n zz", "Aé" * 200, "tabs\t\tand\r\nlines"]


@pytest.fixture(scope="module")
def model():
    return U.load(MODEL)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def as_unigram(path):
    """The model file as one of the library's unigram kind, with the scores that we use."""
    field = lambda no, v: varint(no << 3 | 2) + varint(len(v)) + v
    out = b""
    for t, s, k in U.read_pieces(path):
        out += field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k))
    raw = open(path, "rb").read()
    for no, v in U._fields(raw):
        if no == 2:
            out += field(2, b"".join((varint(k << 3 | 2) + varint(len(x)) + x) if isinstance(x, bytes) and k not in (10, 15, 51) else (varint(k << 3 | 5) + x if isinstance(x, bytes) else varint(k << 3) + varint(1 if k == 3 else x)) for k, x in U._fields(v)))
        elif no == 3:
            out += field(3, b"".join((varint(k << 3 | 2) + varint(len(x)) + x) if isinstance(x, bytes) else varint(k << 3) + varint(x) for k, x in U._fields(v)))
    return out


def encoded(model, texts):
    out = []
    for _, data, offs in text_parts(pa.array(texts)):
        ids, count = U.encode_rows(model, data, offs)
        out += np.split(ids, np.cumsum(count)[:-1])
    return [x.tolist() for x in out]


def score(model, ids):
    return sum(model.score[i] for i in ids)


def test_same_ids_as_the_library(model):
    spm = pytest.importorskip("sentencepiece")
    lib = spm.SentencePieceProcessor(model_proto=as_unigram(MODEL))
    for t, ids in zip(TEXTS, encoded(model, TEXTS)):
        want = lib.encode(t)
        # equally good paths may differ, as the library adds in single precision
        assert ids == want or score(model, ids) >= score(model, want) - 1e-6, t


def best_by_brute_force(model, pieces, data):
    best = [0.0] + [-np.inf] * len(data)
    for i in range(len(data)):
        if best[i] == -np.inf:
            continue
        for w, s in pieces.items():
            if data.startswith(w, i):
                best[i + len(w)] = max(best[i + len(w)], best[i] + s)
        n = next(k for k in range(1, 5) if i + k >= len(data) or data[i + k] & 0xC0 != 0x80)
        if data[i : i + n] not in pieces:
            best[i + n] = max(best[i + n], best[i] + model.unk_score)
    return best[-1]


def test_best_score_against_brute_force(model):
    pieces = {t.encode().replace(U.MARK, b" "): s for t, s, k in U.read_pieces(MODEL) if k == U.NORMAL}
    texts = ["the anning edition", "été très là", "q\U00013000z", "of of  of"]
    for t, ids in zip(texts, encoded(model, texts)):
        data = (" " + t).encode()
        unknown = sum(c not in {p.decode() for p in pieces if len(p.decode()) == 1} for c in t)
        got = sum(model.score[i] for i in ids if i not in set(model.byte_id.tolist())) + unknown * model.unk_score
        assert got == pytest.approx(best_by_brute_force(model, pieces, data))


def test_table_and_edge_cases(spark, model):
    texts = [*TEXTS, "a▁b", None, "word " * 40_000, "z" * 30_000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "x", "k", 2), (3, TEXTS[3], "k", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_ids int")
    out = U.encode(df, model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert r["ids"] is None and r["lossless"] is None and r["n_ids"] == 0
        else:
            assert r["lossless"] == ("▁" not in t) and r["n_ids"] == len(r["ids"])
    back = {r["doc_id"]: r["text"] for r in U.decode(out.where("doc_id is not null"), model).collect()}
    for i, t in enumerate(texts):
        assert back[i] == (t if t is None else t.replace("▁", " "))
    assert U.encode(df.limit(0), model).collect() == []


def test_decoding_refuses_ids_out_of_range(spark):
    from pyspark.errors import PythonException

    m = U.load()
    for bad in ([-1], [len(m.size)], [5, None]):
        df = spark.createDataFrame([(1, bad, "t")], "doc_id bigint, ids array<int>, text string")
        with pytest.raises(PythonException):
            U.decode(df, m).collect()
    df = spark.createDataFrame([(1, None, "t"), (None, [], "t"), (None, [], "t")], "doc_id bigint, ids array<int>, text string")
    assert sorted(map(tuple, U.decode(df, m).collect()), key=repr) == [(1, None), (None, ""), (None, "")]


def test_other_normalisers_are_refused(tmp_path):
    with open(U.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    path = tmp_path / "other.model"
    path.write_bytes(raw + b"\x1a\x02\x20\x01")  # remove_extra_whitespaces
    with pytest.raises(ValueError):
        U.load(str(path))


def test_lengths_around_the_step_limit_give_equal_ids():
    """Stretches of up to and over ``STEP_LIMIT`` bytes go two ways with the same result."""
    import numpy as np

    m, r = U.load(), np.random.default_rng(3)
    letters = np.frombuffer("abcdefghijklmnopqrstuvwxyz".encode(), np.uint8)
    rows = [r.choice(letters, n) for n in (190, 191, 192, 193, 194, 400) for _ in range(6)]
    size = np.array([len(x) for x in rows])
    both = []
    limit = U.STEP_LIMIT
    for U.STEP_LIMIT in (0, limit, 1000):
        both.append(U.segment(m, np.concatenate(rows), size))
    U.STEP_LIMIT = limit
    assert all((a == both[0][0]).all() and (n == both[0][1]).all() for a, n in both[1:])


def test_short_stretches_go_in_step_without_sorting_their_edges(monkeypatch):
    """Sorting all edges took most of the time; the pushes must give what going edge by edge does, also for characters without a piece."""
    m, r = U.load(), np.random.default_rng(7)
    letters = list("abcdefghij éñ日本😀\U00013000,.12")
    rows = [np.frombuffer("".join(r.choice(letters, n)).encode(), np.uint8) for n in [0, 1, 2, 48, *r.integers(1, 40, 200)]]
    d, size = np.concatenate(rows), np.array([len(x) for x in rows])
    monkeypatch.setattr(U, "STEP_LIMIT", 0)
    want = U.segment(m, d, size)
    monkeypatch.setattr(U, "STEP_LIMIT", 192)

    def refuse(*_):
        raise AssertionError("edges are sorted")

    monkeypatch.setattr(U.np, "lexsort", refuse)
    got = U.segment(m, d, size)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    none = U.segment(m, d[:0], size[:0])
    assert len(none[0]) == len(none[1]) == 0
