"""SentencePiece-style unigram encoding and decoding.

Pieces and their log scores come from a model file. They are stored in a double-array
trie over bytes; every text's best segmentation (largest sum of scores) is found by Viterbi
over the pieces that the trie finds at each character. Characters without a piece
fall back to byte pieces. A space is written as the marker U+2581 and one marker is set before
every text that isn't empty; decoding turns markers into spaces and drops that one.

No piece holds a marker behind another character, so a best path can be put together from the
best paths of the stretches between markers. Each distinct stretch of a batch is
segmented once, all of them in step.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import list_array, text_parts
from .spans import gather, hash_spans, starts

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
_SPACE = 32
#: Stretches up to this many bytes are segmented in step, longer ones edge by edge.
STEP_LIMIT = 192
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    base: np.ndarray  # double array: node s goes by byte c to base[s] + c, if check there is s
    check: np.ndarray
    value: np.ndarray  # piece that ends at a node, or -1
    score: np.ndarray
    unk_score: float
    byte_id: np.ndarray  # piece of every byte
    flat: np.ndarray  # bytes that the pieces decode to, one after another
    begin: np.ndarray
    size: np.ndarray
    solo: np.ndarray  # bytes that no piece holds beside others: stretches may be cut around them
    longest: int


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """Text, log score and type of every piece of a model file.

    A file of merge ranks instead of log scores (model type 2) says no more than an order
    of frequency; Zipf's law makes it log scores: minus the logarithm of the rank.
    """
    out, by_rank = [], False
    with open(path, "rb") as f:
        raw = f.read()
    for no, v in _fields(raw):
        if no == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, x in _fields(v):
                if k == 1:
                    text = x.decode()
                elif k == 2:
                    score = struct.unpack("<f", x)[0]
                elif k == 3:
                    kind = x
            out.append((text, score, kind))
        elif no == 2:
            by_rank = any(k == 3 and x == 2 for k, x in _fields(v))
    if by_rank:
        normal = sorted((i for i, p in enumerate(out) if p[2] == NORMAL), key=lambda i: -out[i][1])
        for rank, i in enumerate(normal, 2):
            out[i] = (out[i][0], struct.unpack("<f", struct.pack("<f", -math.log(rank)))[0], NORMAL)
    return out


def double_array(words: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, value`` of the trie of ``words``; node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for w, v in zip(words, values):
        s = 0
        for c in w:
            t = children[s].get(c)
            if t is None:
                t = len(children)
                children[s][c] = t
                children.append({})
                value.append(-1)
            s = t
        value[s] = v
    size = len(children) * 2 + 1024
    base, check, val = [0] * size, [-1] * size, [-1] * size
    used = bytearray(size)
    used[:257] = b"\1" * 257
    place = {0: 0}
    free, wide = 257, 0
    for node in range(len(children)):
        kids = children[node]
        if not kids:
            continue
        s, labels = place[node], sorted(kids)
        while used[free]:
            free += 1
        # nodes of several children leave crowded stretches behind, which those of one fill
        b = max(1, free - labels[0]) if len(labels) == 1 else max(1, free - labels[0], wide)
        tries = 0
        while any(b + c < size and used[b + c] for c in labels):
            b, tries = b + 1, tries + 1
        if tries > 40:
            wide = b - 20
        if b + 256 >= size:
            grow = size
            base, check, val, size = base + [0] * grow, check + [-1] * grow, val + [-1] * grow, size + grow
            used.extend(bytes(grow))
        base[s] = b
        for c in labels:
            used[b + c] = 1
            check[b + c] = s
            val[b + c] = value[kids[c]]
            place[kids[c]] = b + c
    top = max(place.values()) + 257
    return tuple(np.array(x[:top], np.int32) for x in (base, check, val))


def check_normaliser(path: str) -> None:
    """Refuse a model whose normaliser isn't the one built here: text as it is, a marker before it, markers for spaces."""
    # the format's own defaults
    spec = {"charsmap": b"", "prefix": 1, "fewer spaces": 1, "markers": 1}
    with open(path, "rb") as f:
        raw = f.read()
    for no, v in _fields(raw):
        if no == 3:
            for k, x in _fields(v):
                if 2 <= k <= 5:
                    spec[list(spec)[k - 2]] = x
    if spec != {"charsmap": b"", "prefix": 1, "fewer spaces": 0, "markers": 1}:
        raise ValueError(f"the model's normaliser isn't supported: {({k: len(v) if k == 'charsmap' else v for k, v in spec.items()})}")


def load(path: str = DEFAULT_MODEL) -> Model:
    check_normaliser(path)
    pieces = read_pieces(path)
    normal = [s for _, s, k in pieces if k == NORMAL]
    low, high = min(normal), max(normal)
    in_trie = [(i, t.encode().replace(MARK, b" "), s, k) for i, (t, s, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED) and t]
    if any(b" " in w.lstrip(b" ") for _, w, _, _ in in_trie) or not any(w == b" " for _, w, _, _ in in_trie):
        raise ValueError("pieces must hold markers at their start only, and the marker must be a piece")
    score = np.array([s for _, s, _ in pieces])
    for i, w, _, k in in_trie:
        if k == USER:
            score[i] = len(pieces[i][0].encode()) * high - 0.1
    byte_id = np.full(256, -1, np.int32)
    out = []
    for i, (t, _, k) in enumerate(pieces):
        if k == BYTE:
            byte_id[int(t[1:-1], 16)] = i
            out.append(bytes([int(t[1:-1], 16)]))
        else:
            out.append(b"" if k in (UNKNOWN, CONTROL) else t.encode().replace(MARK, b" "))
    if (byte_id < 0).any():
        raise ValueError("the model lacks byte pieces")
    size = np.array([len(x) for x in out])
    solo = np.ones(256, bool)
    for _, w, _, _ in in_trie:
        if len(w) > 1:
            solo[list(w)] = False
    solo[128:] = False
    solo[_SPACE] = False
    return Model(*double_array([w for _, w, _, _ in in_trie], [i for i, _, _, _ in in_trie]), score, low - 10, byte_id, np.frombuffer(b"".join(out), np.uint8), starts(size), size, solo, max(len(w) for _, w, _, _ in in_trie))


def _edges(m: Model, d: np.ndarray, end_of: np.ndarray):
    """All pieces at all characters: start, end and piece (-1: a character without one)."""
    first = np.flatnonzero((d & 0xC0) != 0x80)
    nxt = np.append(first[1:], len(d))
    char_end = np.empty(len(d) + 1, np.int64)
    char_end[first] = np.minimum(nxt, end_of[first])
    single = np.zeros(len(d) + 1, bool)
    at, state, far = first, np.zeros(len(first), np.int32), 0
    a, b, v = [], [], []
    while len(at):
        ok = at + far < end_of[at]
        at, state = at[ok], state[ok]
        to = m.base[state] + d[at + far]
        ok = m.check[to] == state
        at, state = at[ok], to[ok]
        far += 1
        got = m.value[state]
        hit = got >= 0
        s = at[hit]
        a.append(s)
        b.append(s + far)
        v.append(got[hit])
        single[s[char_end[s] == s + far]] = True
    lone = first[~single[first]]
    a.append(lone)
    b.append(char_end[lone])
    v.append(np.full(len(lone), -1, np.int32))
    return np.concatenate(a), np.concatenate(b), np.concatenate(v)


def _in_step(m: Model, d: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the best path of every stretch, the bytes that each covers and the number of pieces of each stretch.

    All stretches go forward together, a byte at a time: what starts there is pushed to where it ends. No two
    stretches share a node, so nothing is sorted. Earlier starts come first and only a better path replaces one.
    """
    n = len(size)
    order = np.argsort(-size.astype(np.int16), kind="stable")
    size_of = size[order]
    most = int(size_of[0]) if n else 0
    # stretches, the longest first, that have at least r bytes; row r of the nodes and row r of the bytes lie side by side
    at_least = n - starts(np.bincount(size, minlength=most + 1))
    row = starts(at_least)
    first = np.flatnonzero((d & 0xC0) != 0x80)
    width = np.zeros(len(d), np.int16)
    end_of = np.repeat(np.cumsum(size), size)
    width[first] = np.minimum(np.append(first[1:], len(d)), end_of[first]) - first
    begin = starts(size)[order]
    total = int(at_least.sum())
    best, back, far_back = np.full(total, -np.inf), np.full(total, -1, np.int32), np.zeros(total, np.int16)
    best[:n] = 0
    byte = [d[begin[: at_least[r + 1]] + r].astype(np.int64) for r in range(most)]
    node_score = np.where(m.value >= 0, m.score[np.maximum(m.value, 0)], -np.inf)
    base, check, value = m.base.astype(np.int64), m.check, m.value

    def push(node, cand, piece, far):
        k = np.flatnonzero(cand > best[node])
        node = node[k]
        best[node] = cand[k]
        back[node] = piece[k] if piece is not None else -1
        far_back[node] = far[k] if piece is None else far

    for r in range(most):
        here = best[row[r] : row[r] + at_least[r + 1]]
        wide = width[begin[: at_least[r + 1]] + r]
        go = np.flatnonzero((wide > 0) & (here > -np.inf))
        lone = np.ones(len(here), bool)
        k, state, far, widest = go, np.zeros(len(go), np.int64), 0, int(wide.max(initial=0))
        while r + far < most:
            cut = np.searchsorted(k, at_least[r + far + 1])  # the others end before
            k, state = k[:cut], state[:cut]
            to = base[state] + byte[r + far][k]
            ok = np.flatnonzero(check[to] == state)
            if not len(ok):
                break
            k, state = k[ok], to[ok]
            far += 1
            w = node_score[state]
            if far <= widest:
                lone[k[(wide[k] == far) & (w > -np.inf)]] = False
            push(row[r + far] + k, here[k] + w, value[state], far)
        k = go[lone[go]]
        if len(k):
            push(row[r + wide[k].astype(np.int64)] + k, here[k] + m.unk_score, None, wide[k])
    # backwards, the last piece first; each path's pieces are then laid out by its length
    alive, left, depth = np.flatnonzero(size_of > 0), size_of.copy(), np.zeros(n, np.int64)
    trail = []
    while len(alive):
        node = row[left[alive]] + alive
        trail.append((alive, back[node], far_back[node]))
        left[alive] -= far_back[node]
        depth[alive] += 1
        alive = alive[left[alive] > 0]
    count = np.empty(n, np.int64)
    count[order] = depth
    piece, bytes_ = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int64)
    last = (starts(count) + count - 1)[order]
    for step, (k, p, far) in enumerate(trail):
        piece[last[k] - step] = p
        bytes_[last[k] - step] = far
    return piece, bytes_, count


def _by_edges(m: Model, d: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_in_step`, edge by edge."""
    n, begin = len(size), starts(size)
    seg = np.repeat(np.arange(n), size)
    a, b, v = _edges(m, d, (begin + size)[seg] if len(d) else np.empty(0, np.int64))
    w = np.where(v >= 0, m.score[np.maximum(v, 0)], m.unk_score)
    order = np.lexsort((a, b))
    a, b, v, w = a[order], b[order], v[order], w[order]
    # a stretch of k bytes has k + 1 nodes
    na, nb = a + seg[a], b + seg[a]
    best, back = np.full(len(d) + n, -np.inf), np.full(len(d) + n, -1, np.int64)
    best[begin + np.arange(n)] = 0
    got = best.tolist() if len(best) < 1 << 16 else best
    for k in range(len(a)):
        c = got[na[k]] + w[k]
        if c > got[nb[k]]:
            got[nb[k]] = c
            back[nb[k]] = k
    edges, count = [], np.zeros(n, np.int64)
    for i in range(n):
        path, cur = [], begin[i] + size[i] + i
        while cur > begin[i] + i:
            path.append(back[cur])
            cur = na[back[cur]]
        edges += path[::-1]
        count[i] = len(path)
    edges = np.array(edges, np.int64)
    return v[edges].astype(np.int32), b[edges] - a[edges], count


def segment(m: Model, d: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of every stretch of ``d``, and their numbers.

    Of equally good pieces that end at one place the one that starts first is taken.
    """
    short = size <= STEP_LIMIT
    if short.all():
        piece, width, count = _in_step(m, d, size)
    elif not short.any():
        piece, width, count = _by_edges(m, d, size)
    else:
        begin, count, parts = starts(size), np.empty(len(size), np.int64), []
        for which, how in ((short, _in_step), (~short, _by_edges)):
            p, w, count[which] = how(m, d[gather(begin[which], size[which])], size[which])
            parts.append((which, p, w))
        piece, width = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int64)
        for which, p, w in parts:
            to = gather(starts(count)[which], count[which])
            piece[to], width[to] = p, w
    raw = piece < 0
    if not raw.any():
        return piece, count
    # pieces cover their stretches without gaps
    each = np.where(raw, width, 1)
    ids = np.repeat(piece, each)
    ids[ids < 0] = m.byte_id[d[gather((np.cumsum(width) - width)[raw], width[raw])]]
    return ids, np.bincount(np.repeat(np.arange(len(size)), count), weights=each, minlength=len(size)).astype(np.int64)


def encode_rows(m: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one row after another, and their numbers per row."""
    rows = len(offs) - 1
    if MARK in data.tobytes():
        text = [data[offs[i] : offs[i + 1]].tobytes().replace(MARK, b" ") for i in range(rows)]
        data = np.frombuffer(b"".join(text), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in text])])
    size = np.diff(offs)
    has = size > 0
    d = np.insert(data, offs[:-1][has], _SPACE)
    size = size + has
    begin = starts(size)
    if not len(d):
        return np.empty(0, np.int32), np.zeros(rows, np.int64)
    space, solo = d == _SPACE, m.solo[d]
    edge = np.zeros(len(d), bool)
    edge[1:] = (space[1:] & ~space[:-1]) | solo[1:] | solo[:-1]
    edge[begin[has]] = True
    at = np.flatnonzero(edge)
    length = np.diff(np.append(at, len(d)))
    row = np.searchsorted(begin[has], at, "right") - 1
    row = np.flatnonzero(has)[row]
    _, one, back = np.unique(hash_spans(d, at, length), return_index=True, return_inverse=True)
    ids, count = segment(m, d[gather(at[one], length[one])], length[one])
    each = count[back]
    return ids[gather(starts(count)[back], each)], np.bincount(row, weights=each, minlength=rows).astype(np.int64)


def decode_rows(m: Model, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, one row after another, and their numbers per row."""
    size = m.size[ids]
    out = m.flat[gather(m.begin[ids], size)]
    row = np.repeat(np.arange(len(count)), count)
    length = np.bincount(row, weights=size, minlength=len(count)).astype(np.int64)
    begin, has = starts(length), length > 0
    lead = begin[has][out[begin[has]] == _SPACE]
    drop = np.zeros(len(count), np.int64)
    drop[np.flatnonzero(has)[out[begin[has]] == _SPACE]] = 1
    return np.delete(out, lead), length - drop


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids, lossless`` of every text.

    ``lossless`` says whether decoding gives the text back byte for byte; only texts that hold the
    marker character itself don't. Null texts have null ids, empty ones none. Null ids and
    repeated rows pass through, other columns are ignored.
    """

    def run(batches):
        for b in batches:
            valid = np.asarray(b.column(1).is_valid())
            for lo, data, offs in text_parts(b.column(1)):
                n = len(offs) - 1
                ids, count = encode_rows(model, data, offs)
                back, size = decode_rows(model, ids, count)
                # rows of equal length are compared in one piece
                ok = size == np.diff(offs)
                if ok.all():
                    diff = np.flatnonzero(back != data)
                    ok[np.unique(np.searchsorted(offs, diff, "right") - 1)] = False
                else:
                    at = starts(size)
                    for i in np.flatnonzero(ok):
                        ok[i] = bool((back[at[i] : at[i] + size[i]] == data[offs[i] : offs[i + 1]]).all())
                null = ~valid[lo : lo + n]
                arr = list_array(ids, count)
                if null.any():
                    arr = pa.ListArray.from_arrays(arr.offsets, arr.values, mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(count), arr, pa.array(ok, mask=null)], names=["doc_id", "n_ids", "ids", "lossless"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, n_ids bigint, ids array<int>, lossless boolean")


def decode(rows: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every row of ids; null ids give a null text, none an empty one, a null among them or one out of range an error.

    Bytes that aren't UTF-8 become replacement characters. Null ids of rows and repeated rows pass through, other columns are ignored.
    """

    def run(batches):
        for b in batches:
            arr = b.column(1)
            count = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = arr.flatten()
            ids = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            if ((ids < 0) | (ids >= len(model.size))).any():
                raise ValueError(f"ids must be from 0 to {len(model.size) - 1}, and not null")
            out, size = decode_rows(model, ids, count)
            at = starts(size)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + n].decode("utf-8", "replace") if ok else None for i, n, ok in zip(at, size, arr.is_valid().to_pylist())], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("bigint"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
