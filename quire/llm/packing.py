"""Bulk-synchronous best-fit packing of documents into sequences of one capacity.

Texts longer than the capacity are cut into full pieces, which fill a sequence each, and a
rest; rests and shorter texts are packed. All pieces are range-sorted by size, which gives
each its rank among those of its size without any partition holding one size alone.
Pieces of one size are interchangeable, and so are sequences of one gap: a superstep
therefore works on *runs* (size, first rank, count) and (gap, first sequence, count), of
which there are never more than the capacity allows, however large the corpus. It

1. sweeps runs of pieces and gaps together by falling value; every piece run takes the
   smallest gaps that hold it (its successors in the order), one piece a gap;
2. resolves conflicts by rank: where more pieces ask for a gap value than there are gaps,
   the first ranks win and the rest look at the next larger gap value or wait;
3. updates the gaps and repeats. Pieces larger than every gap open new sequences, largest
   first, as many as their total size calls for.

Each piece then finds its sequence by its size and rank in the table of matches.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

CAPACITY = 2048
#: Rows up to which the tables of ranks and matches are broadcast.
BROADCAST_ROWS = 500_000


def words(text_col: str = "text"):
    """Length in white-space separated words."""
    t = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"^[ \t\n\x0B\f\r]+", "")
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, r"[ \t\n\x0B\f\r]+")) - F.when(t.rlike(r"[ \t\n\x0B\f\r]$"), 1).otherwise(0)).cast("bigint")


def superstep(items: list[tuple[int, int, int]], gaps: dict[int, list[tuple[int, int]]]):
    """One sweep: ``(matches, unmatched items, new gaps)``.

    ``items`` are runs (size, first rank, count) by falling size, ``gaps`` runs (first
    sequence, count) by gap. A match is (size, rank, count, sequence, gap).
    """
    matches, waiting, stack = [], [], []
    values = sorted(gaps, reverse=True)
    k = 0
    for size, rank, count in items:
        while k < len(values) and values[k] >= size:
            stack.extend((values[k], b, n) for b, n in reversed(gaps[values[k]]))
            k += 1
        while count and stack:
            gap, b, n = stack.pop()
            m = min(n, count)
            matches.append((size, rank, m, b, gap))
            rank, count = rank + m, count - m
            if m < n:
                stack.append((gap, b + m, n - m))
        if count:
            waiting.append((size, rank, count))
    after: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for gap, b, n in stack:
        after[gap].append((b, n))
    for v in values[k:]:
        after[v].extend(gaps[v])
    for size, _, m, b, gap in matches:
        if gap > size:
            after[gap - size].append((b, m))
    for runs in after.values():
        runs.sort()
        joined = [runs[0]]
        for b, n in runs[1:]:
            if joined[-1][0] + joined[-1][1] == b:
                joined[-1] = (joined[-1][0], joined[-1][1] + n)
            else:
                joined.append((b, n))
        runs[:] = joined
    return matches, waiting, dict(after)


def plan(counts: dict[int, int], capacity: int, first: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """All matches for ``counts`` pieces by size, the number of sequences, and of supersteps."""
    items = [(s, 0, counts[s]) for s in sorted(counts, reverse=True) if counts[s]]
    gaps: dict[int, list[tuple[int, int]]] = {}
    matches, n, steps = [], first, 0
    while items:
        largest = max(gaps, default=0)
        stuck = [x for x in items if x[0] > largest]
        if stuck:
            # those over half the capacity never share; of the others as many as fill up
            room = -(-sum(s * c for s, _, c in stuck) // capacity)
            room = max(room, sum(c for s, _, c in stuck if 2 * s > capacity))
            left = [x for x in items if x[0] <= largest]
            for i, (s, rank, c) in enumerate(stuck):
                m = min(c, room)
                if m:
                    matches.append((s, rank, m, n, capacity))
                    if s < capacity:
                        gaps.setdefault(capacity - s, []).append((n, m))
                    n, room = n + m, room - m
                stuck[i] = (s, rank + m, c - m)
            items = [x for x in stuck if x[2]] + left
        got, items, gaps = superstep(items, gaps)
        matches += got
        steps += 1
    return matches, n - first, steps


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length=None) -> DataFrame:
    """``doc_id, piece, start, n, seq, at``: where every piece of every text goes.

    ``piece`` numbers a text's pieces, ``start`` and ``n`` are its place in the text, ``seq`` and
    ``at`` the sequence and the place in it, in units of ``length`` (a column; words of ``text`` by
    default). Null and empty texts give one row of ``n = 0`` without a sequence. Repeated
    rows and rows without id are packed each. Equal sizes rank by id. Very long texts are cut into pieces, none is left out. Other
    columns are ignored. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce((words() if length is None else length).cast("bigint"), F.lit(0)).alias("_n"))
    # lengths are counted once; the range sort reads its input twice, to sample it and to sort it
    lengths = d = materialize(d, "pack-lengths")
    cap = F.lit(capacity).cast("bigint")
    pieces = d.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("_n") / cap) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * cap).alias("start"), F.least(F.col("_n") - F.col("piece") * cap, cap).alias("n"))
    order = [F.col("n").desc(), F.col("doc_id"), F.col("piece")]
    # the place in its partition of the sorted table, which is written before anything depends on it
    sorted_ = materialize(pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id()), "pack-sorted")
    part = F.shiftright("_k", 33)
    runs = sorted_.groupBy(part.alias("_p"), F.col("n").alias("_s")).agg(F.min("_k").alias("_first"), F.count("*").alias("_c"))
    got = sorted((r["_p"], -r["_s"], r["_first"], r["_c"]) for r in runs.collect())
    seen: dict[int, int] = defaultdict(int)
    before = []
    for p, s, k, c in got:
        before.append((p, -s, k - seen[-s]))
        seen[-s] += c
    spark = docs.sparkSession
    full = seen.get(capacity, 0)
    matches, _, _ = plan({s: c for s, c in seen.items() if 0 < s < capacity}, capacity, full)
    matches = ([(capacity, 0, full, 0, capacity)] if full else []) + matches
    base = _small(spark, [(p, s, b) for p, s, b in before], "_q bigint, _s bigint, _base bigint")
    rank = sorted_.withColumn("_p", part).join(base, (F.col("_p") == F.col("_q")) & (F.col("n") == F.col("_s")), "left").select("doc_id", "piece", "start", "n", (F.col("_k") - F.col("_base")).alias("_rank"))
    # matches are looked up by size and block of ranks; a size has as many blocks as matches, so that a block meets about two of them
    wide = {s: -(-c // n) for s, c, n in _totals(matches)}
    rows = [(s, k, r, r + c, b - r, capacity - g) for s, r, c, b, g in matches for k in range(r // wide[s], (r + c - 1) // wide[s] + 1)]
    found = _small(spark, rows, "_s bigint, _k bigint, _lo bigint, _hi bigint, _shift bigint, at bigint")
    blocks = _small(spark, sorted(wide.items()), "_t bigint, _wide bigint")
    rank = rank.join(blocks, F.col("n") == F.col("_t"), "left").withColumn("_block", F.floor(F.col("_rank") / F.col("_wide")))
    out = rank.join(found, (F.col("n") == F.col("_s")) & (F.col("_block") == F.col("_k")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")), "left")
    discard(lengths)
    return out.select("doc_id", "piece", "start", "n", (F.col("_rank") + F.col("_shift")).alias("seq"), "at")


def _totals(matches: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """``(size, pieces, matches)`` of every size."""
    out: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for s, _, c, _, _ in matches:
        out[s][0] += c
        out[s][1] += 1
    return [(s, c, n) for s, (c, n) in out.items()]


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table, to be broadcast unless it has over ``BROADCAST_ROWS`` rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    df = spark.createDataFrame(pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, cols)}), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
