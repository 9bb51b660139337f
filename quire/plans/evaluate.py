"""Scoring found regions against true ones, at scale.

Matching is greedy within a page and class; many pages are matched in one Arrow call, and everything
after that is ordinary aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CLASSES
from .batches import whole_groups

_BOX = ["left", "bottom", "right", "top"]


#: Rows of whole pages that are matched together, and pairs of regions that are held at once.
ROWS, PAIRS = 100_000, 2_000_000


def matches(found: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, page, class, tp, fp, fn, giou`` of every page: counts and the sum of GIoU over the matches.

    Both tables have ``doc_id, page, region, class, left, bottom, right, top``, ``found`` also ``confidence``. Regions
    rank by confidence, then by ``region``; of equally good partners the first wins.
    """
    kinds = ["doc_id", "page", "region", "class", *_BOX]
    f = found.select(*kinds, F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("true"))
    t = truth.select(*kinds, F.lit(1.0).alias("confidence"), F.lit(True).alias("true"))
    return matched(f.unionByName(t), threshold)


def matched(rows: DataFrame, threshold: float = 0.5, partitions: int | None = None) -> DataFrame:
    """The same over one table, in which ``true`` tells the sides apart."""
    names = ("doc_id", "page", "class", "tp", "fp", "fn", "giou")

    def assign(batches):
        for t, starts in whole_groups(batches, ["doc_id", "page"], ROWS):
            page, kind, tp, fp, fn, giou = match_pages(t, starts, threshold)
            at = pa.array(starts[page])
            cols = [t.column("doc_id").take(at).combine_chunks(), t.column("page").take(at).combine_chunks(), pa.array(np.array(CLASSES)[kind], pa.string()), *map(pa.array, (tp, fp, fn, giou))]
            yield pa.RecordBatch.from_arrays(cols, names=list(names))

    x = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "region", "class", *(F.col(c).cast("double").alias(c) for c in _BOX), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "true")
    # as many partitions as there are tasks for, whatever their bytes, as it is the work on them that counts
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, "doc_id", "page").sortWithinPartitions("doc_id", "page", "true", "region").mapInArrow(assign, "doc_id string, page int, class string, tp bigint, fp bigint, fn bigint, giou double")


def match_pages(t: pa.Table, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """:func:`.metrics.match_regions` of all pages at once: page, class, counts and the sum of GIoU.

    Only pairs of at least the threshold matter to the greedy choice, and few regions have more than one.
    """
    kinds = t.column("class").combine_chunks().dictionary_encode()
    of = np.array([CLASSES.index(k) if k in CLASSES else -1 for k in kinds.dictionary.to_pylist()] + [-1], np.int64)
    kind = of[np.asarray(kinds.indices.fill_null(len(of) - 1))]
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows))) * len(CLASSES) + kind
    true, box = np.asarray(t.column("true")), [np.asarray(t.column(c)) for c in _BOX]
    mine, theirs = (np.flatnonzero((true == side) & (kind >= 0)) for side in (False, True))
    mine = mine[np.lexsort((-np.asarray(t.column("confidence"))[mine], group[mine]))]
    theirs = theirs[np.argsort(group[theirs], kind="stable")]
    own = np.unique(group[kind >= 0])
    first, end = (np.searchsorted(group[theirs], group[mine], side) for side in ("left", "right"))
    upto = np.append(0, np.cumsum(end - first))
    pairs, free, a = [], np.ones(t.num_rows, bool), 0
    while a < len(mine):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        size = end[a:z] - first[a:z]
        i = np.repeat(np.arange(a, z), size)
        j = theirs[np.arange(len(i)) - np.repeat(upto[a:z] - upto[a] - first[a:z], size)]
        score = _overlaps([c[mine[i]] for c in box], [c[j] for c in box])[0]
        good = np.flatnonzero(score >= threshold)
        good = good[np.lexsort((j[good], -score[good], i[good]))]
        last = -1
        for x, y in zip(i[good].tolist(), j[good].tolist()):
            if x != last and free[y]:
                free[y] = False
                pairs.append((mine[x], y))
                last = x
        a = z
    x, y = np.array(pairs, np.int64).reshape(-1, 2).T
    count = lambda g, w=None: np.bincount(np.searchsorted(own, g), w, len(own))
    tp, giou = count(group[x]), count(group[x], _overlaps([c[x] for c in box], [c[y] for c in box])[1])
    return own // len(CLASSES), own % len(CLASSES), tp, count(group[mine]) - tp, count(group[theirs]) - tp, giou


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """IoU and GIoU of boxes with boxes, as :func:`.markdown.iou` and :func:`.markdown.giou`."""
    zero = lambda v: np.maximum(v, 0.0)
    area = lambda x: zero(x[2] - x[0]) * zero(x[3] - x[1])
    both = zero(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * zero(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    all_ = area(a) + area(b) - both
    iou = np.divide(both, all_, out=np.zeros_like(both), where=all_ > 0)
    around = area([np.minimum(a[0], b[0]), np.minimum(a[1], b[1]), np.maximum(a[2], b[2]), np.maximum(a[3], b[3])])
    return iou, np.where(around > 0, iou - np.divide(around - all_, around, out=np.zeros_like(both), where=around > 0), 0.0)


def report(pages: DataFrame) -> DataFrame:
    """Per class pooled counts, F1, mean GIoU over matches (0 without) and support."""
    g = pages.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "giou")))
    tp, all_ = F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.select("class", "tp", "fp", "fn", F.coalesce(2 * tp / F.nullif(all_, F.lit(0)), F.lit(0.0)).alias("f1"), F.coalesce(F.col("giou") / F.nullif(tp, F.lit(0)), F.lit(0.0)).alias("mean_giou"), (tp + F.col("fn")).alias("support"))


def summary(per_class: DataFrame) -> DataFrame:
    """Macro F1 and the mean GIoU of all matches, in one row."""
    return per_class.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.sum(F.col("mean_giou") * F.col("tp")) / F.nullif(F.sum("tp"), F.lit(0)), F.lit(0.0)).alias("mean_giou"))
