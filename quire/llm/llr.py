"""Quality by the log-likelihood ratio of hashed n-grams: trusted target against raw corpus.

Features of a text are its tokens (words and runs of marks, see :mod:`.scan`) and its token
pairs, hashed into ``BUCKETS``; pairs of equal tokens share one feature whatever the token,
so that stuttering text is seen however rare its words are. Two multinomials are counted:
the raw one over every document, the target one over every trusted document. A
document's score is the mean over its features of log(target / raw), and a document is
kept when its score reaches one threshold that is the same for all, set on every labelled
document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import mix, tokens
from .shared import discard, materialize, text_parts

BITS = 16
BUCKETS = 1 << BITS
#: Additive smoothing of the bucket counts, in features.
ALPHA = 1.0
#: Labelled ids up to which they are broadcast; beyond that texts and scores are shuffled to them.
BROADCAST_ROWS = 1_000_000
#: Different scores of labelled texts that one task looks through for the threshold, about.
CUT_ROWS = 1_000_000
#: Dropping a good document weighs as much as keeping this many bad ones, as shares of their kind.
GOOD_WEIGHT = 4.0
_REPEAT = np.uint64(0x5DEECE66D1234567)


@dataclass
class Model:
    llr: np.ndarray  # float64, one per bucket
    threshold: float


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature: tokens first, then token pairs."""
    h, row = tokens(data, offs, marks=True)
    if not len(h):
        return np.empty(0, np.int64), row
    same = row[1:] == row[:-1]
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[1:] == h[:-1]] = _REPEAT
    both = np.concatenate([h, pair[same]])
    return (both >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, row[1:][same]])


def count(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Feature counts per bucket over all of ``docs``.

    One pass over the texts; each task sends its non-empty buckets once, however many
    documents it reads, and the sums come to the driver as ``BUCKETS`` rows.
    """

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, data, offs in text_parts(b.column(0)):
                n += np.bincount(features(data, offs)[0], minlength=BUCKETS)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], names=["bucket", "n"])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"]] = sums["n"]
    return out


def ratios(raw: np.ndarray, target: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Smoothed log-likelihood ratio per bucket; all zero if either count is empty."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    p = lambda c: np.log((c + alpha) / (c.sum() + alpha * len(c)))
    return p(target) - p(raw)


def score_rows(llr: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean ratio of each row's features (NaN without any) and their number."""
    f, row = features(data, offs)
    n = len(offs) - 1
    size = np.bincount(row, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(row, weights=llr[f], minlength=n) / size, size


def _cheapest(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, below: tuple, totals: tuple, weight: float) -> tuple[float, float]:
    """Least cost and its cut among those right below each of the sorted different ``scores``.

    ``good`` and ``bad`` count each score; ``below`` is the next lower score (None: there is none) and
    the good and bad ones up to it, ``totals`` are all the good and bad ones.
    """
    last, g, b = below
    cuts = np.concatenate([[scores[0] - 1.0 if last is None else (scores[0] + last) / 2], (scores[1:] + scores[:-1]) / 2])
    cost = weight * (g + np.cumsum(good) - good) / totals[0] + 1 - (b + np.cumsum(bad) - bad) / totals[1]
    k = np.argmin(cost)
    return float(cost[k]), float(cuts[k])


def choose_threshold(good: np.ndarray, bad: np.ndarray, weight: float = GOOD_WEIGHT) -> float:
    """Threshold of least weight * share of good below it + share of bad at or above it.

    Candidates lie midway between neighbouring scores; the lowest of equally good ones is
    taken. Without bad scores nothing is cut (minus infinity).
    """
    if not len(bad) or not len(good):
        return float("-inf")
    all_ = np.unique(np.concatenate([good, bad]))
    each = [np.bincount(np.searchsorted(all_, x), minlength=len(all_)) for x in (good, bad)]
    return _cheapest(all_, *each, (None, 0, 0), (len(good), len(bad)), weight)[1]


def find_threshold(scores: DataFrame, weight: float = GOOD_WEIGHT) -> float:
    """:func:`choose_threshold` over a table ``score, good`` of any size.

    Rows are counted by score; the different scores are cut at quantiles into ranges of about ``CUT_ROWS``,
    each range is searched by a task that knows what lies below it, and the driver gets a row per range.
    """
    each = materialize(scores.groupBy("score").agg(F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad")), "llr-scores")
    try:
        parts = -(-each.count() // CUT_ROWS)
        edges = np.unique(each.approxQuantile("score", [k / parts for k in range(1, parts)], 0.25 / parts)) if parts > 1 else np.empty(0)

        def place(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, b.column(0).to_numpy(zero_copy_only=False), "right")), *b.columns], names=["part", "score", "good", "bad"])

        placed = each.mapInArrow(place, "part bigint, score double, good bigint, bad bigint")
        below, at = {}, (None, 0, 0)
        for r in placed.groupBy("part").agg(F.max("score").alias("last"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect():
            below[r["part"]] = at
            at = (r["last"], at[1] + r["good"], at[2] + r["bad"])
        totals = at[1:]
        if not all(totals):
            return float("-inf")

        def search(key, t):
            t = t.sort_by("score")
            cost, found = _cheapest(*(t.column(c).to_numpy() for c in ("score", "good", "bad")), below[key[0].as_py()], totals, weight)
            return pa.table({"cost": [cost], "cut": [found]})

        return min((r["cost"], r["cut"]) for r in placed.groupBy("part").applyInArrow(search, "cost double, cut double").collect())[1]
    finally:
        discard(each)


def _scores(docs: DataFrame, llr: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for lo, data, offs in text_parts(b.column(1)):
                n = len(offs) - 1
                s, size = score_rows(llr, data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(size.astype(np.int64)), pa.array(np.nan_to_num(s), mask=size == 0)], names=["doc_id", "n_features", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_features bigint, score double")


def _labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, good, trusted`` of every id that has a quality, one row each."""
    good = F.col("quality").cast("double") == 1
    toxic = F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)) != 0 if "toxic" in labels.columns else F.lit(False)
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), good.alias("good"), (good & ~toxic).alias("trusted"))
    return rows.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("trusted").alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count both multinomials and set the threshold, over all documents and all labels.

    ``labels`` has ``doc_id, quality`` and perhaps ``toxic``. Trusted are documents of quality 1
    that aren't toxic, by any row of their id. The raw multinomial covers all of ``docs``: null and empty texts add nothing, repeated rows
    count each, and every row of a trusted id counts as target. Without target or raw features all ratios are 0; without good or bad scores nothing is cut.

    Up to ``BROADCAST_ROWS`` labelled ids are broadcast. Beyond, the texts are shuffled once, for the target; for the threshold
    all texts are scored and only ids and scores are shuffled.
    """
    known = materialize(_labelled(labels), "llr-labels")
    try:
        few = known.count() <= BROADCAST_ROWS
        near = F.broadcast if few else lambda x: x.hint("shuffle_hash")
        texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        llr = ratios(count(texts), count(texts.join(near(known.where("trusted").select("doc_id")), "doc_id", "left_semi")))
        # a broadcast keeps other texts from Python
        chosen = texts.join(near(known.select("doc_id")), "doc_id", "left_semi") if few else texts
        got = _scores(chosen, llr, "doc_id", "text").where("score is not null").join(near(known.select("doc_id", "good")), "doc_id")
        return Model(llr, find_threshold(got.select("score", "good")))
    finally:
        discard(known)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, score, keep`` of every document.

    Texts without a feature (null, empty, white space) have a null score and aren't kept.
    Null ids pass through, repeated rows are scored each, other columns are ignored; a
    score equal to the threshold is kept.
    """
    s = _scores(docs, model.llr, id_col, text_col)
    return s.withColumn("keep", F.coalesce(F.col("score") >= F.lit(model.threshold), F.lit(False)))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, all columns as they are: repeated rows each, rows without id too, whole texts of any length.

    Null, empty and blank texts go; an empty table stays empty. Columns may have any names.
    """
    at, llr, least = docs.columns.index(text_col), model.llr, model.threshold

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, data, offs in text_parts(b.column(at)):
                s, size = score_rows(llr, data, offs)
                keep[lo : lo + len(offs) - 1] = (size > 0) & (np.nan_to_num(s) >= least)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
