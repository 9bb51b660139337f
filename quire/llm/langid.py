"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW`` bytes (of half that in training; state starts at zero at
either end of a window), gives every byte position a
distribution over the languages, and a document the mean of its positions'
distributions. Gates are hard sigmoids (a clipped line) and candidates softsigns, which
cost a fraction of the exponential forms and train as well here. It is trained in numpy by backpropagation through time on a bounded
sample of labelled documents and is a few thousand numbers large, so it travels in the
task closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_parts

WINDOW = 128
HIDDEN = 8
#: Labelled documents per language that training may look at, and how many characters of each, from its middle.
PER_LANGUAGE = 256
SAMPLE_CHARS = 16_384
#: A byte's label takes one byte, of which 255 marks no byte.
MOST_LANGUAGES = 255
#: Documents whose best pooled probability is lower are rejected.
MIN_PROB = 0.4


@dataclass
class Model:
    """Weights; the first axis of ``emb``, ``u`` and ``un`` is the direction (0 forward)."""

    langs: list[str]
    emb: np.ndarray  # 2 x 3h x 256, input part of update, reset and candidate
    u: np.ndarray  # 2 x 2h x h
    un: np.ndarray  # 2 x h x h
    out: np.ndarray  # langs x 2h
    bias: np.ndarray  # langs x 1

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, self.u, self.un, self.out, self.bias]


def start(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *s: (r.standard_normal(s) / np.sqrt(hidden)).astype(np.float32)
    return Model(langs, f(2, 3 * hidden, 256), f(2, 2 * hidden, hidden), f(2, hidden, hidden), f(len(langs), 2 * hidden), np.zeros((len(langs), 1), np.float32))


def _gate(x):
    return np.clip(0.25 * x + 0.5, 0, 1)


def _gate_slope(g):
    return 0.25 * ((g > 0) & (g < 1))


def loss_and_grads(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients.

    ``x`` is T x N bytes, ``y`` the N windows' language numbers.
    """
    steps, n = x.shape
    h = m.u.shape[2]
    keep = []
    outs = np.zeros((2, steps, h, n), np.float32)
    for d in (0, 1):
        prev, trace = np.zeros((h, n), np.float32), {}
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = m.emb[d][:, x[t]]
            zr = _gate(g[: 2 * h] + m.u[d] @ prev)
            z, r = zr[:h], zr[h:]
            rh = r * prev
            c = g[2 * h :] + m.un[d] @ rh
            c /= 1 + np.abs(c)
            trace[t] = (prev, z, r, rh, c)
            prev = prev + z * (c - prev)
            outs[d, t] = prev
        keep.append(trace)
    flat = np.concatenate([outs[0], outs[1]], 1)  # T x 2h x N
    logits = m.out @ flat + m.bias
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log(p[:, y, np.arange(n)] + 1e-9).mean())
    p[:, y, np.arange(n)] -= 1
    p /= steps * n
    d_out = p.transpose(1, 0, 2).reshape(len(m.langs), -1) @ flat.transpose(0, 2, 1).reshape(-1, 2 * h)
    d_bias = p.sum((0, 2))[:, None]
    d_flat = m.out.T @ p
    d_emb, d_u, d_un = np.zeros_like(m.emb), np.zeros_like(m.u), np.zeros_like(m.un)
    order = np.argsort(x.ravel(), kind="stable")
    seen, begins = np.unique(x.ravel()[order], return_index=True)
    for d in (0, 1):
        back = np.zeros((h, n), np.float32)
        das = np.empty((steps, 3 * h, n), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            prev, z, r, rh, c = keep[d][t]
            dh = d_flat[t, d * h : (d + 1) * h] + back
            dc = dh * z * (1 - np.abs(c)) ** 2
            drh = m.un[d].T @ dc
            dz = dh * (c - prev) * _gate_slope(z)
            dr = drh * prev * _gate_slope(r)
            gate = np.concatenate([dz, dr])
            back = dh * (1 - z) + drh * r + m.u[d].T @ gate
            d_un[d] += dc @ rh.T
            d_u[d] += gate @ prev.T
            das[t, : 2 * h], das[t, 2 * h :] = gate, dc
        flat_das = das.transpose(1, 0, 2).reshape(3 * h, -1)[:, order]
        d_emb[d][:, seen] = np.add.reduceat(flat_das, begins, axis=1)
    return loss, [d_emb, d_u, d_un, d_out.astype(np.float32), d_bias.astype(np.float32)]


def train(texts: list[str], langs_of: list[str], steps: int = 260, batch: int = 192, window: int = 64, hidden: int = HIDDEN, seed: int = 7, rate: float = 0.02) -> Model:
    """Fit by Adam on random windows, the languages drawn equally often."""
    langs = sorted(set(langs_of))
    m = start(langs, hidden, seed)
    r = np.random.default_rng(seed)
    raw = [[np.frombuffer(t.encode(), np.uint8) for t, k in zip(texts, langs_of) if k == lang and t.strip()] for lang in langs]
    joined = [np.concatenate([np.concatenate([a, [10]]) for a in rows]) if rows else np.array([32]) for rows in raw]
    joined = [np.resize(a, max(len(a), window + 1)).astype(np.uint8) for a in joined]
    first, second = [np.zeros_like(a) for a in m.arrays()], [np.zeros_like(a) for a in m.arrays()]
    for step in range(1, steps + 1):
        y = np.arange(batch) % len(langs)
        x = np.stack([joined[k][(o := r.integers(0, len(joined[k]) - window)) : o + window] for k in y], 1)
        _, grads = loss_and_grads(m, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(m.arrays(), grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return m


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """The bounded labelled sample, on the driver: ``per_language`` texts of each language, ``SAMPLE_CHARS`` characters long, at most.

    Every language that labels a text is learned, however rare; of each, the ids of least hash are taken (the rank filter
    is applied before the shuffle), and of an id that repeats one text. Rows without id, text or language are left out. More than
    ``MOST_LANGUAGES`` languages are an error.
    """
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    d = d.where("i is not null and t is not null and l is not null")
    w = Window.partitionBy("l").orderBy("h", "i")
    # an id counts once, whatever the number of its rows
    ids = d.select("i", "l").distinct().withColumn("h", F.xxhash64("i")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_language)
    ids = [(r["i"], r["l"]) for r in ids.select("i", "l").limit(per_language * (MOST_LANGUAGES + 1)).collect()]
    if not ids:
        return [], []
    if len({k for _, k in ids}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    chosen = docs.sparkSession.createDataFrame(ids, d.select("i", "l").schema)
    at = F.greatest(F.lit(1), F.floor((F.char_length("t") - SAMPLE_CHARS) / 2) + 1).cast("int")
    mine = d.join(F.broadcast(chosen), ["i", "l"]).select("i", "l", F.substring(F.col("t"), at, F.lit(SAMPLE_CHARS)).alias("t"))
    rows = mine.groupBy("i", "l").agg(F.min("t").alias("t")).collect()
    rows = sorted(((r["i"], r["l"], r["t"]) for r in rows))
    return [r[2] for r in rows], [r[1] for r in rows]


def _positions(m: Model, x: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Probabilities langs x T x N for windows sorted by falling length.

    ``x`` is T x N bytes; at step t only the first ``active[t]`` windows reach so far.
    Rows of states lie together, so that a byte's input part is one short copy.
    """
    steps, n = x.shape
    h = m.u.shape[2]
    quarter = np.float32(0.25)
    hid = np.zeros((2, steps, n, h), np.float32)
    idx = x.astype(np.intp)
    none, one = np.zeros((n, h), np.float32), np.ones((n, h), np.float32)
    z, r, c, a = (np.empty((n, h), np.float32) for _ in range(4))
    for d in (0, 1):
        ez, er, ec = (np.ascontiguousarray(m.emb[d, j * h : (j + 1) * h].T) for j in range(3))
        ez, er = quarter * ez + np.float32(0.5), quarter * er + np.float32(0.5)
        uz, ur, uc = (np.ascontiguousarray(w.T) for w in (m.u[d, :h] * quarter, m.u[d, h:] * quarter, m.un[d]))
        last = none
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            k = int(active[t])
            if k == 0:
                continue
            i, prev, out = idx[t, :k], last[:k], hid[d, t, :k]
            zk, rk, ck, ak, zero, full = z[:k], r[:k], c[:k], a[:k], none[:k], one[:k]
            for e, u, g in ((ez, uz, zk), (er, ur, rk)):
                np.matmul(prev, u, out=g)
                np.take(e, i, axis=0, out=ak, mode="clip")
                g += ak
                np.maximum(g, zero, out=g)
                np.minimum(g, full, out=g)
            rk *= prev
            np.matmul(rk, uc, out=ck)
            np.take(ec, i, axis=0, out=ak, mode="clip")
            ck += ak
            np.abs(ck, out=ak)
            ak += full
            ck /= ak
            ck -= prev
            ck *= zk
            np.add(ck, prev, out=out)
            last = hid[d, t]
    q = hid[0].reshape(-1, h) @ m.out[:, :h].T
    q += hid[1].reshape(-1, h) @ m.out[:, h:].T
    q = np.ascontiguousarray(q.T)
    q += m.bias
    q -= q.max(0)
    np.exp(q, out=q)
    q /= q.sum(0)
    return q.reshape(len(m.langs), steps, n)


def _first_best(p: np.ndarray) -> np.ndarray:
    """Index of the largest along the first axis, the first of equals."""
    most, best = p[0].copy(), np.zeros(p.shape[1:], np.uint8)
    for j in range(1, len(p)):
        best[p[j] > most] = j
        np.maximum(most, p[j], out=most)
    return best


def label_rows(m: Model, data: np.ndarray, offs: np.ndarray, window: int = WINDOW, width: int = 2048):
    """Label of every byte, and per row the pooled probabilities and label counts."""
    rows, langs = len(offs) - 1, len(m.langs)
    size = np.diff(offs)
    windows = -(-size // window)
    row = np.repeat(np.arange(rows), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = offs[:-1][row] + nth * window
    length = np.minimum(size[row] - nth * window, window)
    order = np.argsort(-length, kind="stable")
    labels = np.empty(len(data) + window, np.uint8)
    sums, votes = np.zeros((rows, langs)), np.zeros((rows, langs), np.int64)
    spans = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(window, np.uint8)]), window)
    marks = np.lib.stride_tricks.sliding_window_view(labels, window, writeable=True)
    steps = np.arange(window)[:, None]
    for lo in range(0, len(order), width):
        k = order[lo : lo + width]
        active = (length[k][None, :] > steps).sum(1)
        p = _positions(m, np.ascontiguousarray(spans[begin[k]].T), active)
        best = _first_best(p)
        full = int(active[-1])
        if full:
            marks[begin[k[:full]]] = best[:, :full].T
        for j in range(full, len(k)):
            labels[begin[k[j]] : begin[k[j]] + length[k[j]]] = best[: length[k[j]], j]
        if full < len(k):
            real = steps < length[k[full:]][None, :]
            p[:, :, full:] *= real
            best[:, full:][~real] = 255
        own = p.sum(1, dtype=np.float64)
        for j in range(langs):
            sums[:, j] += np.bincount(row[k], weights=own[j], minlength=rows)
            votes[:, j] += np.bincount(row[k], weights=(best == j).sum(0), minlength=rows).astype(np.int64)
    labels = labels[: len(data)]
    with np.errstate(invalid="ignore", divide="ignore"):
        pooled = sums / size[:, None]
    return labels, pooled, votes


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_labels: bool = True) -> DataFrame:
    """Label every byte of every text and pool the document's probabilities.

    Returns ``doc_id, lang_pred, prob, n_bytes, counts, labels``: the most probable
    language, its pooled probability, bytes in the text, positions labelled with each of
    ``model.langs`` and (``with_labels``) one byte per text byte numbering its language. Null
    and empty texts have no position: null language and probability. Null ids, repeated
    rows and other columns pass through or are ignored; ties go to the first language.
    """
    names = model.langs

    def run(batches):
        for b in batches:
            for lo, data, offs in text_parts(b.column(1)):
                n = len(offs) - 1
                labels, pooled, votes = label_rows(model, data, offs)
                has = np.diff(offs) > 0
                best = np.where(has, np.nan_to_num(pooled).argmax(1), 0)
                cols = [
                    b.column(0).slice(lo, n),
                    pa.array([names[k] if ok else None for k, ok in zip(best, has)], pa.string()),
                    pa.array(np.nan_to_num(pooled[np.arange(n), best]), pa.float64(), mask=~has),
                    pa.array(np.diff(offs)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), pa.array(votes.ravel())),
                ]
                if with_labels:
                    cols.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(labels)]))
                yield pa.RecordBatch.from_arrays(cols, names=fields)

    fields = ["doc_id", "lang_pred", "prob", "n_bytes", "counts"] + ["labels"] * with_labels
    schema = "doc_id bigint, lang_pred string, prob double, n_bytes bigint, counts array<bigint>" + ", labels binary" * with_labels
    if not names:
        empty = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("prob"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), F.array().cast("array<bigint>").alias("counts"))
        return empty.withColumn("labels", F.lit(None).cast("binary")) if with_labels else empty
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> Model:
    """Train on the bounded sample of ``docs``; no labelled text gives a model of no languages."""
    texts, langs = training_rows(docs, id_col, text_col, lang_col)
    return train(texts, langs, **kw) if texts else start([])


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_prob: float = MIN_PROB) -> DataFrame:
    """The rows of ``docs`` whose text is identified with at least ``min_prob``, all columns kept.

    Rejected are null and empty texts and those whose best pooled probability is lower.
    A model of no languages can reject nothing and keeps every row with a text.
    """
    fields = docs.columns
    if not model.langs:
        return docs.where(F.octet_length(text_col) > 0)
    at = fields.index(text_col)

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, data, offs in text_parts(b.column(at)):
                _, pooled, _ = label_rows(model, data, offs)
                keep[lo : lo + len(offs) - 1] = np.nan_to_num(pooled).max(1) >= min_prob
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
