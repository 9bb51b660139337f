"""N-gram Jaccard join by parity sketches.

A text is the set of its word ``N``-grams. Every n-gram flips one bit of a long, sparse
parity vector, so the Hamming distance of two vectors never exceeds the symmetric
difference of the sets, and sets of Jaccard similarity >= ``t`` differ by at most
``(1 - t) / (1 + t) * (|A| + |B|)`` n-grams. The vector is cut into parts; the pigeonhole
principle leaves parts without a difference, which are equal in both. A part is named
by the XOR of its n-grams' hashes (a linear fingerprint of its parity bits), and sets are
joined on equal part names. Sizes fall into bands, each half as large again, that share a number
of parts; a set small enough to have a partner in a lower band is entered there too.

Strict pigeonhole takes one part more than there may be differences. Fewer are used: as many as leave ``EQUAL`` parts
equal on average in a pair at the threshold, of whatever sizes the band brings together. One equal part
makes a candidate, for sets of all sizes alike. The parts that differences fall in are independent, so that
such a pair has no equal part with probability ``exp(-EQUAL)`` at most, 1 in 3,000 (none of 60,000 when tried), and a closer one far more rarely.

A group of near copies would send each of its pairs once for every part that they share, so
groups go a shorter way. Every set looks for a *root*: the least set with which it shares most of a fixed
eighth of the part names, and that one's own. Sets of one root are compared all with all, in blocks, without any pair
of them being sent; pairs of different roots are sent as candidates, screened by the distance of short
sketches. Roots only route: each pair of sets with an equal part is verified exactly, by one of the two ways.

Texts with the same set share one node, so that copies cost one row per part name in all.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scan import mix, ngrams, tokens
from .shared import discard, list_array, materialize, text_parts

N = 2
THRESHOLD = 0.7
#: Parts left equal, on average, in a pair at the threshold.
EQUAL = 8.0
#: Width of a size band.
RATIO = 1.5
#: Bits of an n-gram's hash.
HASH_BITS = 46
#: Bits of the screening sketch that travels with every part name: 48 beside the size's 16, and a word more.
SKETCH_BITS, LOW_BITS = 112, 48
#: Bits of the sketch that screens candidates before they are verified.
WIDE_BITS = 2048
#: One part name in so many (a power of two) is used to find roots.
ROOT_SHARE = 8
#: Nodes, and n-grams, of a root that are verified together; larger groups are cut into pairs of blocks.
BLOCK = 2048
BLOCK_GRAMS = 2_000_000
#: Sets of one root from which on common n-grams are counted by a matrix product.
DENSE = 24
#: Nodes of a part name that are compared in one task; names of more are cut into pairs of blocks.
HOT = 50_000
#: Names of so many nodes are found from one node in this many.
HOT_SAMPLE = 64
#: Rows up to which tables of nodes are broadcast (some 16 bytes each).
BROADCAST_ROWS = 1_000_000
_LOW = np.uint64((1 << HASH_BITS) - 1)


def most_differences(t: float, a, b):
    """Largest symmetric difference of sets of ``a`` and ``b`` elements with similarity ``t``."""
    return (1 - t) / (1 + t) * (a + b)


def untouched(b: int, d: float, t: float, least: int) -> float:
    """Parts of ``b`` that ``d`` differences leave equal and that hold ``least`` n-grams, on average, in a pair of similarity ``t``."""
    full = d * t / (1 - t) / b
    few = math.exp(-full) * sum(full**k / math.factorial(k) for k in range(least))
    return b * math.exp(-d / b) * (1 - few)


@lru_cache(maxsize=None)
def bands(t: float, equal: float, largest: int) -> list[tuple[int, int, int]]:
    """``(upper end, parts, least n-grams of a part)`` of the size bands up to ``largest`` n-grams.

    A band has the fewest parts of which ``equal`` are left equal on average by its smallest pair and by its largest, of which
    one set is just below the band's upper end and the other larger by ``1 / t``. Parts that hold fewer than three n-grams are equal by chance
    more often than others and are left out, the number of parts making up for it; bands of small sets, where it
    can't, leave out fewer or none. The smallest sets get four parts an n-gram, so that a common n-gram is a common part.
    """
    out, low, high = [], 1, 2
    while not out or out[-1][0] <= largest:
        ends = (most_differences(t, high, high / t), most_differences(t, low, low))
        found = next(((b, m) for m in (3, 2, 1) for b in range(4, 4 * high) if min(untouched(b, d, t, m) for d in ends) >= equal), (4 * high, 1))
        out.append((high, *found))
        low, high = high, math.ceil(high * RATIO)
    return out


def sets(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of every row, ascending, and their numbers per row."""
    rows = len(offs) - 1
    h, row = ngrams(*tokens(data, offs), n)
    k = (row.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    k.sort()
    if len(k):
        k = k[np.concatenate([[True], k[1:] != k[:-1]])]
    return k & _LOW, np.bincount((k >> np.uint64(HASH_BITS)).astype(np.int64), minlength=rows)


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def nodes_of(g: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each non-empty row's set, in two halves (0 for empty ones)."""
    out = np.zeros((2, len(size)), np.uint64)
    has = size > 0
    if has.any():
        at, n = _starts(size)[has], mix(size[has].astype(np.uint64))
        for half, seed in zip(out, (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
            half[has] = mix(np.add.reduceat(mix(g + np.uint64(seed)), at) ^ n)
    return out[0], out[1]


def part_names(g: np.ndarray, size: np.ndarray, t: float, equal: float = EQUAL) -> tuple[np.ndarray, np.ndarray]:
    """Names of the parts of every row in the bands it belongs to, and their rows."""
    names, rows = [], []
    row = np.repeat(np.arange(len(size)), size)
    table = bands(t, equal, 1 << int(size.max(initial=1)).bit_length())
    own = np.searchsorted([x[0] for x in table], size, "right")
    spread = mix(g + np.uint64(0x14057B7EF767814F))
    for j, (high, b, least) in enumerate(table):
        use = np.flatnonzero(((own == j) | ((own > j) & (size * t < high)))[row])
        if not len(use):
            continue
        part = (g[use] >> np.uint64(HASH_BITS - 24)) * np.uint64(b) >> np.uint64(24)
        r = row[use]
        at = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (r[1:] != r[:-1])]))
        x = np.bitwise_xor.reduceat(spread[use], at)
        at = at[keep := np.diff(np.append(at, len(use))) >= least]
        names.append(mix(x[keep] ^ mix(part[at] * np.uint64(256) + np.uint64(j + 1))))
        rows.append(r[at])
    if not names:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(names), np.concatenate(rows)


def short_sketch(g: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size (16 bits, saturating) and a parity sketch of ``SKETCH_BITS`` of each row's set, in two words."""
    low, high = np.minimum(size, 65535).astype(np.uint64) << np.uint64(LOW_BITS), np.zeros(len(size), np.uint64)
    has = size > 0
    if has.any():
        at, bit = _starts(size)[has], mix(g) % np.uint64(SKETCH_BITS)
        one, first = np.uint64(1), bit < LOW_BITS
        low[has] |= np.bitwise_xor.reduceat(np.where(first, one << np.minimum(bit, np.uint64(63)), np.uint64(0)), at)
        high[has] = np.bitwise_xor.reduceat(np.where(first, np.uint64(0), one << (np.maximum(bit, np.uint64(LOW_BITS)) - np.uint64(LOW_BITS))), at)
    return low, high


def _possible(a: np.ndarray, a2: np.ndarray, b: np.ndarray, b2: np.ndarray, t: float) -> np.ndarray:
    """Whether sets with these short sketches can reach ``t``."""
    low = np.uint64((1 << LOW_BITS) - 1)
    na, nb = (a >> np.uint64(LOW_BITS)).astype(np.float64), (b >> np.uint64(LOW_BITS)).astype(np.float64)
    open_ = np.maximum(na, nb) >= 65535
    apart = np.bitwise_count((a ^ b) & low) + np.bitwise_count(a2 ^ b2)
    return open_ | ((apart <= most_differences(t, na, nb) + 1e-6) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-6))


def _index(docs: DataFrame, id_col: str, text_col: str, n: int, t: float, equal: float) -> DataFrame:
    """``doc_id, name, more, size, meta, meta2, names`` of every text with an n-gram."""

    def run(batches):
        for b in batches:
            for lo, data, offs in text_parts(b.column(1)):
                g, size = sets(data, offs, n)
                keep = np.flatnonzero(size > 0)
                name, row = part_names(g, size, t, equal)
                order = np.argsort(row, kind="stable")
                count = np.bincount(row, minlength=len(size))[keep]
                halves = [pa.array(x[keep].view(np.int64)) for x in nodes_of(g, size)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(size)).take(pa.array(keep)), *halves, pa.array(size[keep]), *(pa.array(x[keep].view(np.int64)) for x in short_sketch(g, size)), list_array(name[order].view(np.int64), count)],
                    names=["doc_id", "name", "more", "size", "meta", "meta2", "names"],
                )

    d = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    return d.mapInArrow(run, "doc_id bigint, name bigint, more bigint, size bigint, meta bigint, meta2 bigint, names array<bigint>")


def _groups(batches, columns: int):
    """The columns of rows sorted by the first, in runs that end where a group of it does."""
    kept: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(columns))
        key = cols[0]
        last = int(np.searchsorted(key, key[-1], "left"))
        if last == 0 and kept and kept[-1][0][-1] == key[0]:
            kept.append(cols)
            continue
        if last:
            kept.append(tuple(c[:last] for c in cols))
        if kept:
            yield tuple(np.concatenate(c) for c in zip(*kept))
        kept = [tuple(c[last:] for c in cols)]
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept))


def _stars(batches):
    """``node, lead, k`` from rows ``part, node, k`` sorted by part and node: each group's least node for the others."""
    part, lead = None, None
    for b in batches:
        if not b.num_rows:
            continue
        key, node, k = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = node[edge]
        if part is not None and part == key[0]:
            least[0] = lead
        part, lead = key[-1], least[-1]
        least = np.repeat(least, np.diff(np.append(edge, len(key))))
        more = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[more]), pa.array(least[more]), pa.array(k[more])], names=["node", "lead", "k"])


def _roots(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``node, root`` of the nodes that share a root with others, written to the shared folder."""
    own = F.filter("names", lambda x: x.bitwiseAND(F.lit(ROOT_SHARE - 1)) == 0)
    some = rows.select("node", own.alias("own")).select("node", F.size("own").alias("k"), F.explode("own").alias("part"))
    cold = some if hot is None else some.join(F.broadcast(hot.select("part")), "part", "left_anti")
    stars = cold.select("part", "node", "k").repartition("part").sortWithinPartitions("part", "node").mapInArrow(_stars, "node bigint, lead bigint, k int")
    if hot is not None:  # any node of a hot name will do, so that its nodes needn't meet
        stars = stars.unionAll(some.join(F.broadcast(hot), "part").where("node > lead").select("node", "lead", "k"))
    best = stars.groupBy("node", "lead").agg(F.count("*").alias("c"), F.max("k").alias("k")).where("c >= 2 and 4 * c >= k")
    parents = materialize(best.groupBy("node").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead")), "parity-parents")
    up = parents.join(parents.select(F.col("node").alias("lead"), F.col("lead").alias("above")), "lead", "left").select("node", F.coalesce("above", "lead").alias("root"))
    # a root without a root of its own is its own root
    alone = up.select(F.col("root").alias("node")).distinct().join(up.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    out = materialize(up.unionAll(alone), "parity-roots")
    discard(parents)
    return out


def _hot_names(rows: DataFrame) -> DataFrame | None:
    """``part, lead, cuts`` of the names of very many nodes, from a fixed sample of nodes; None if there are none.

    Routing only: a name that the sample misses is compared in one task, with the same result.
    """
    least = max(1, HOT // (2 * HOT_SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(HOT_SAMPLE)) == 0).select("node", F.explode("names").alias("part"))
    hot = some.groupBy("part").agg(F.count("*").alias("c"), F.min("node").alias("lead")).where(F.col("c") >= least)
    hot = materialize(hot.select("part", "lead", F.ceil(F.col("c") * HOT_SAMPLE / F.lit(HOT)).alias("cuts")), "parity-hot")
    if hot.isEmpty():
        discard(hot)
        return None
    return hot


def _cells(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``cell, side, node, meta, meta2, root``: the rows to compare by part name; hot names are cut into pairs of blocks of nodes.

    ``side`` is 0 in a block by itself; of a pair of blocks, 1 and 2 are compared with each other only.
    """
    each = rows.select(F.explode("names").alias("part"), "node", "meta", "meta2", "root")
    cold = (each if hot is None else each.join(F.broadcast(hot.select("part")), "part", "left_anti")).select(F.col("part").alias("cell"), F.lit(0).cast("tinyint").alias("side"), "node", "meta", "meta2", "root")
    if hot is None:
        return cold
    cut = each.join(F.broadcast(hot.select("part", "cuts")), "part").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts")))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("tinyint")
    return cold.unionAll(cut.select(F.xxhash64("part", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), side.alias("side"), "node", "meta", "meta2", "root"))


def _candidates(t: float):
    """Candidate pairs ``a, b`` of different roots from rows ``cell, side, node, meta, meta2, root`` sorted by cell and root."""

    def cross(side, node, meta, meta2, root):
        edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        for lo, hi in zip(edge[1:], np.append(edge[2:], len(root))):
            # each row of the smaller side with all rows of the other
            one, others = (range(lo, hi), slice(0, lo)) if hi - lo <= lo else (range(lo), slice(lo, hi))
            for i in one:
                ok = _possible(meta[others], meta2[others], meta[i], meta2[i], t) & ((side[others] == 0) | (side[others] != side[i]))
                if ok.any():
                    y = node[others][ok]
                    yield np.minimum(y, node[i]), np.maximum(y, node[i])

    def pairs(key, side, node, meta, meta2, root):
        meta, meta2 = meta.view(np.uint64), meta2.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        # sorted by root: a group is of one root if its ends are
        mixed = root[edge] != root[edge + size - 1]
        two = edge[mixed & (size == 2)]
        if len(two):
            ok = two[_possible(meta[two], meta2[two], meta[two + 1], meta2[two + 1], t) & ((side[two] == 0) | (side[two] != side[two + 1]))]
            yield np.minimum(node[ok], node[ok + 1]), np.maximum(node[ok], node[ok + 1])
        for e, n in zip(edge[mixed & (size > 2)], size[mixed & (size > 2)]):
            s = slice(e, e + n)
            yield from cross(side[s], node[s], meta[s], meta2[s], root[s])

    def batch(parts):
        ab = np.unique(np.stack([np.concatenate(c) for c in zip(*parts)], 1), axis=0) if len(parts) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    def run(batches):
        kept, n = [], 0
        for rows in _groups(batches, 6):
            for x in pairs(*rows):
                kept.append(x)
                n += len(x[0])
                if n >= 1 << 18:
                    yield batch(kept)
                    kept, n = [], 0
        if n:
            yield batch(kept)

    return run


def _wide(g: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity sketches of ``WIDE_BITS`` bits, one row each."""
    bits = np.zeros((len(size), WIDE_BITS), np.uint8)
    pos = (mix(g + np.uint64(77)) % np.uint64(WIDE_BITS)).astype(np.int64) + np.repeat(np.arange(len(size)) * WIDE_BITS, size)
    flat = bits.ravel()
    where, n = np.unique(pos, return_counts=True)
    flat[where] = n & 1
    return np.packbits(bits, axis=1).view(np.uint64)


def verify_pairs(g: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows reach ``t``, and their common n-grams; sets as :func:`sets` gives them."""
    begin = _starts(size)
    wide = _wide(g, size)
    keep = np.empty(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        keep[s] = np.bitwise_count(wide[a[s]] ^ wide[b[s]]).sum(1) <= most_differences(t, size[a[s]], size[b[s]]) + 1e-6
    common = np.zeros(len(a), np.int64)
    left = np.flatnonzero(keep)
    left = left[np.argsort(a[left], kind="stable")]
    vocab, local = np.unique(g, return_inverse=True)
    mark = np.zeros(len(vocab), bool)
    for chunk in np.split(left, np.flatnonzero(np.diff(a[left])) + 1) if len(left) else []:
        i = a[chunk[0]]
        own = local[begin[i] : begin[i] + size[i]]
        mark[own] = True
        for lo in range(0, len(chunk), 512):
            part = chunk[lo : lo + 512]
            n = size[b[part]]
            span = np.repeat(begin[b[part]] - _starts(n), n) + np.arange(n.sum())
            common[part] = np.add.reduceat(mark[local[span]].astype(np.int64), _starts(n))
        mark[own] = False
    union = size[a] + size[b] - common
    return keep & (common >= t * union - 1e-9 * union), common


def common_dense(g: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of common n-grams of all pairs of rows, by products of incidence matrices."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(g, kind="stable")
    edge = np.concatenate([[True], g[order][1:] != g[order][:-1]]) if len(g) else np.empty(0, bool)
    column = np.cumsum(edge) - 1
    times = np.bincount(column)
    # what is in one row only is common to none
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    row, column, width = row[order][use], number[column[use]], int(shared.sum())
    out = np.zeros((n, n), np.float32)
    step = max(256, (1 << 23) // max(n, 1))
    for lo in range(0, width, step):
        s = slice(*np.searchsorted(column, (lo, lo + step)))
        x = np.zeros((n, min(step, width - lo)), np.float32)
        x[row[s], column[s] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label of each component of the pairs ``a, b`` of places."""
    while True:
        least = np.minimum(label[a], label[b])
        if (least == label[a]).all() and (least == label[b]).all():
            return label
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]


def _similar_in(root: np.ndarray, side: np.ndarray, g: np.ndarray, size: np.ndarray, t: float):
    """Places ``a, b`` and common n-grams of the similar pairs within each root; rows sorted by root, sides as in :func:`_cells`."""
    begin = _starts(size)
    edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])) if len(root) else np.empty(0, np.int64)
    small = []
    for e, n in zip(edge, np.diff(np.append(edge, len(root)))):
        if n < 2:
            continue
        if n < DENSE:
            i, j = np.triu_indices(n, 1)
            ok = (side[e + i] == 0) | (side[e + i] != side[e + j])
            small.append((e + i[ok], e + j[ok]))
            continue
        s = slice(e, e + n)
        common = common_dense(g[begin[e] : begin[e + n - 1] + size[e + n - 1]], size[s])
        union = size[s][:, None] + size[s][None, :] - common
        ok = np.triu(common >= t * union - 1e-9 * union, 1) & ((side[s][:, None] == 0) | (side[s][:, None] != side[s][None, :]))
        i, j = np.nonzero(ok)
        yield e + i, e + j, common[i, j]
    if small:
        a, b = (np.concatenate(c) for c in zip(*small))
        ok, common = verify_pairs(g, size, a, b, t)
        yield a[ok], b[ok], common[ok]


PAIRS = "a bigint, b bigint, n_a bigint, n_b bigint, common bigint"
LINKS = "node bigint, least bigint, links bigint"


def _verify(pairs: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, t: float, listed: bool) -> DataFrame:
    """The similar pairs of nodes among the candidate ``pairs`` and among the nodes of each root, written to the shared folder.

    As ``PAIRS`` if ``listed``, else as ``LINKS``: per node and task the number of similar texts found, copies counted each, and the least
    node that the task's pairs connect it to. The nodes of a root go to a cell (pairs of blocks of them where they are many). For candidate
    pairs a node's leader is the least node it is paired with, and the pairs of one pair of leaders are
    verified together (blocks by hash where a leader has more). So the sets of a
    group are sent once or a few times, not once per pair.
    """
    both = pairs.select(F.col("a").alias("node"), F.least("a", "b").alias("o")).unionAll(pairs.select(F.col("b").alias("node"), F.least("a", "b").alias("o")))
    leaders = both.groupBy("node").agg(F.min("o").alias("leader"))
    leaders = materialize(leaders.join(nodes.select("node", "size"), "node"), "parity-leaders")
    n_nodes = leaders.count()
    buckets, few = max(1, n_nodes * 4 // BLOCK), n_nodes <= BROADCAST_ROWS
    cuts = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_GRAMS)))
    blocks = leaders.groupBy("leader").agg(cuts.alias("cuts"))
    # leaders of few nodes share a bucket, as a group of its own for each would cost a call each
    cell = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("leader"), F.lit(buckets))).otherwise(F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("cuts"))))
    place = materialize(leaders.join(blocks, "leader").select("node", cell.alias("cell")), "parity-place")
    where = F.broadcast(place) if few else place
    at = pairs.join(where.select(F.col("node").alias("a"), F.col("cell").alias("ca")), "a").join(where.select(F.col("node").alias("b"), F.col("cell").alias("cb")), "b")
    at = materialize(at.select(F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("cell"), "a", "b"), "parity-at")
    # the cells of roots; small ones share a bucket here too
    sized = roots.join(nodes.select("node", "size"), "node")
    n_rooted = sized.count()
    of = sized.groupBy("root").agg(cuts.alias("cuts"))
    r = sized.join(of, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("cuts")))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    bucket = F.when(F.col("cuts") == 1, F.xxhash64(F.lit("roots"), F.pmod(F.xxhash64("root"), F.lit(max(1, n_rooted * 4 // BLOCK))))).otherwise(F.xxhash64(F.lit("root"), "root", F.least("i", "j"), F.greatest("i", "j")))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("int")
    none = F.lit(None)
    need = at.select(F.col("cell").alias("to"), F.col("a").alias("node")).unionAll(at.select(F.col("cell").alias("to"), F.col("b").alias("node"))).distinct()
    need = need.select("to", "node", none.cast("bigint").alias("root"), none.cast("int").alias("side")).unionAll(r.select(bucket.alias("to"), "node", "root", side.alias("side")))
    # one text per node, tokenised again: cheaper than keeping every set
    first = nodes.join(place.select("node").unionAll(roots.select("node")).distinct(), "node", "left_semi").select("node", "name", "more", "i", "members")
    texts = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    texts = texts.join(F.broadcast(first) if n_nodes + n_rooted <= BROADCAST_ROWS else first, "i").select("node", "t", "name", "more", "members")

    def tokenise(batches):
        for b in batches:
            for lo, data, offs in text_parts(b.column(1)):
                g, size = sets(data, offs, n)
                # of repeated ids with different texts only the text that makes up the node counts
                name, more = (x.view(np.int64) for x in nodes_of(g, size))
                own = (name == b.column(2).slice(lo, len(size)).to_numpy()) & (more == b.column(3).slice(lo, len(size)).to_numpy())
                rows = pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(size)), b.column(4).slice(lo, len(size)), list_array(g.view(np.int64), size)], names=["node", "members", "grams"])
                yield rows if own.all() else rows.filter(pa.array(own))

    found = texts.mapInArrow(tokenise, "node bigint, members bigint, grams array<bigint>")
    sent = need.join(found, "node").select("to", "node", "root", "side", "members", "grams")
    kinds = {name: pa.int64() for name in (x.split()[0] for x in (PAIRS if listed else LINKS).split(", "))}

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], k) for c, k in kinds.items()})
        if not right.num_rows:
            return empty
        node, members = right.column("node").to_numpy(), right.column("members").to_numpy()
        root, side = (right.column(c).fill_null(0).to_numpy() for c in ("root", "side"))
        rooted = np.asarray(right.column("root").is_valid())
        order = np.lexsort((node, root, rooted))
        node, members, root, side, rooted = (x[order] for x in (node, members, root, side, rooted))
        # a repeated row, of an id that repeats, counts once
        fresh = np.concatenate([[True], (node[1:] != node[:-1]) | (root[1:] != root[:-1]) | (rooted[1:] != rooted[:-1])])
        node, members, root, side, rooted = (x[fresh] for x in (node, members, root, side, rooted))
        grams = right.column("grams").combine_chunks()
        if isinstance(grams, pa.ChunkedArray):
            grams = grams.chunk(0)
        grams = grams.take(pa.array(order[fresh]))
        size = np.diff(grams.offsets.to_numpy()).astype(np.int64)
        g = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        # first the rows that candidate pairs ask for, then those of roots
        cut = int(np.searchsorted(rooted, True))
        got = []
        if left.num_rows:
            a, b = (np.searchsorted(node[:cut], left.column(c).to_numpy()) for c in "ab")
            ok, common = verify_pairs(g[: size[:cut].sum()], size[:cut], a, b, t)
            got.append((a[ok], b[ok], common[ok]))
        if cut < len(node):
            got += [(a + cut, b + cut, common) for a, b, common in _similar_in(root[cut:], side[cut:], g[size[:cut].sum() :], size[cut:], t)]
        if not got:
            return empty
        a, b, common = (np.concatenate(c) for c in zip(*got))
        if listed:
            return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "n_a": size[np.where(node[a] < node[b], a, b)], "n_b": size[np.where(node[a] < node[b], b, a)], "common": common})
        links = np.bincount(a, members[b], len(node)) + np.bincount(b, members[a], len(node))
        least = _spread(np.arange(len(node)), a, b)
        k = np.flatnonzero(links)
        return pa.table({"node": node[k], "least": node[least[k]], "links": links[k].astype(np.int64)})

    out = at.groupBy("cell").cogroup(sent.groupBy("to")).applyInArrow(check, PAIRS if listed else LINKS)
    out = materialize(out, "parity-found")
    discard(leaders, place, at)
    return out


def similar_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD, equal: float = EQUAL, listed: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """``(doc_id, node, name, more, members)`` of every text with an n-gram, what :func:`_verify` finds of the nodes, and whether ids repeat.

    A node goes by the least id that has its set (ids are short, which halves what is
    shuffled), or by the hash of the set if all its ids have several sets; ``members`` are the ids that have it. Both tables are
    written to the shared folder; pass them to :func:`.shared.discard` when done.
    """
    index = materialize(_index(docs, id_col, text_col, n, t, equal), "parity-index")
    ids = index.select("doc_id", "name", "more", "size").distinct()
    several = materialize(ids.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")), "parity-several")
    repeated = not several.isEmpty()
    own = ids.join(several, "doc_id", "left").withColumn("own", F.when(F.col("several").isNull(), F.col("doc_id"))) if repeated else ids.withColumn("own", F.col("doc_id"))
    names = own.groupBy("name", "more").agg(F.coalesce(F.min("own"), F.col("name")).alias("node"), F.min("doc_id").alias("i"), F.first("size").alias("size"), F.count("*").alias("members"))
    names = materialize(names, "parity-names")
    nodes = materialize(ids.select("doc_id", "name", "more").join(names.select("name", "more", "node", "members"), ["name", "more"]).select("doc_id", "node", "name", "more", "members"), "parity-nodes")
    if repeated:
        rows = index.withColumnRenamed("doc_id", "i").drop("size").join(names, ["name", "more", "i"])
        rows = rows.groupBy("node").agg(F.first("meta").alias("meta"), F.first("meta2").alias("meta2"), F.first("names").alias("names"))
        rows = materialize(rows, "parity-rows")
        discard(index)
    else:
        # copies are few beside the index, whose long rows then needn't be shuffled
        copies = materialize(nodes.where("doc_id <> node").select("doc_id"), "parity-copies")
        rows = index.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti").withColumnRenamed("doc_id", "node").select("node", "meta", "meta2", "names")
    hot = _hot_names(rows)
    roots = _roots(rows, hot)
    known = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    rooted = rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = _cells(rooted, hot).repartition("cell").sortWithinPartitions("cell", "root")
    pairs = materialize(cells.mapInArrow(_candidates(t), "a bigint, b bigint").distinct(), "parity-candidates")
    if repeated:
        discard(rows)
    else:
        discard(index, copies)
    found = _verify(pairs, roots, names, docs, id_col, text_col, n, t, listed)
    discard(pairs, names, several, roots, hot)
    return nodes, found, repeated


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD, equal: float = EQUAL) -> DataFrame:
    """``doc_a, doc_b, jaccard``: all pairs of texts (``doc_a < doc_b``) of similarity ``t`` at least.

    A text of fewer than ``n`` words is one n-gram. Null and wordless texts and rows without id
    are similar to nothing. Rows of one id count as one text each; a pair of ids
    is listed once, with its largest similarity. An empty table gives no pair. The result has every pair of a group of copies;
    :func:`links` has one row per document instead.
    """
    nodes, found, repeated = similar_nodes(docs, id_col, text_col, n, t, equal, listed=True)
    members = nodes.groupBy("node").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    # most nodes are one text that goes by its own id; only the others are looked up
    several = materialize(members.where((F.size("ids") > 1) | (F.col("ids")[0] != F.col("node"))), "parity-members")
    copies = several.where(F.size("ids") > 1).select(F.posexplode("ids").alias("k", "x"), "ids").select("x", F.explode(F.slice("ids", F.col("k") + 2, F.greatest(F.size("ids") - F.col("k") - 1, F.lit(0)))).alias("y"), F.lit(1.0).alias("jaccard"))
    look = F.broadcast(several) if several.count() <= BROADCAST_ROWS and nodes.count() <= 10 * BROADCAST_ROWS else several
    j = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    near = found.select("a", "b", j.alias("jaccard")).join(look.select(F.col("node").alias("a"), F.col("ids").alias("ids_a")), "a", "left").join(look.select(F.col("node").alias("b"), F.col("ids").alias("ids_b")), "b", "left")
    near = near.select(F.explode(F.coalesce("ids_a", F.array("a"))).alias("x"), F.coalesce("ids_b", F.array("b")).alias("ids_b"), "jaccard").select("x", F.explode("ids_b").alias("y"), "jaccard").where("x <> y")
    out = copies.unionAll(near).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    # an id that occurs with several texts can reach another id twice
    return out.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")) if repeated else out


def _grouped(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with the component ``at`` of each and its ``class_id``, the least id of what links connect.

    Two components can have the same least id, if it has several texts.
    """
    groups = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    out = nodes.join(groups.withColumnRenamed("item", "node"), "node", "left").withColumn("at", F.coalesce("group", "node"))
    # a node that goes by a hash isn't its group's least id
    least = out.groupBy("at").agg(F.min("doc_id").alias("class_id"))
    done = materialize(out.join(least, "at").select("doc_id", "node", "name", "more", "members", "at", "class_id"), "parity-groups")
    discard(groups)
    return done


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD, equal: float = EQUAL) -> DataFrame:
    """``doc_id, class_id, copies, links``: what the join finds, one row per document.

    ``links`` is the number of other documents of similarity ``t`` at least, of which ``copies`` have the same set of n-grams;
    ``class_id`` is the least id of all that links connect, the document's own where it has none. All similar pairs are
    counted, none is listed. Null and wordless texts have no links. Rows without id are left out; of rows that repeat an id and a set of n-grams one is kept,
    and an id that has several sets has a row for each, the texts of one id being different documents. An empty table gives no rows.
    """
    nodes, found, repeated = similar_nodes(docs, id_col, text_col, n, t, equal)
    sums = materialize(found.groupBy("node").agg(F.sum("links").alias("near")), "parity-links")
    groups = _grouped(nodes, found)
    copies = F.col("members") - 1
    out = groups.join(sums, "node", "left").select("doc_id", "class_id", copies.alias("copies"), (copies + F.coalesce("near", F.lit(0))).alias("links"))
    # what has no n-gram has no node
    all_ = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null")
    rest = all_.join(nodes.select("doc_id"), "doc_id", "left_anti").distinct()
    zero = F.lit(0).cast("bigint")
    out = out.unionAll(rest.select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("copies"), zero.alias("links")))
    done = materialize(out, "parity-documents")
    discard(nodes, found, sums, groups)
    return done


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD, equal: float = EQUAL) -> DataFrame:
    """The rows of ``docs``, of each group of similar texts only the one of least id.

    Groups are the connected components of the join. Texts without a word and rows without
    id belong to none and stay. An id that occurs with several texts is judged text by text; of rows
    that repeat both id and text one stays, as of texts of one id that have the same set (the least).
    """
    nodes, found, _ = similar_nodes(docs, id_col, text_col, n, t, equal)
    of = _grouped(nodes, found)
    best = of.groupBy("at").agg(F.min(F.struct("doc_id", "name", "more")).alias("best"))
    lost = of.join(best, "at").where(F.struct("doc_id", "name", "more") != F.col("best")).select(F.col("doc_id").alias("_lost"), F.col("name").alias("_set")).distinct()
    lost = materialize(lost, "parity-lost")
    discard(nodes, found, of)
    few = F.broadcast if lost.count() <= BROADCAST_ROWS else lambda x: x
    key = docs[id_col].cast("bigint")
    twice = materialize(docs.select(key.alias("_twice")).where("_twice is not null").groupBy("_twice").count().where("count > 1").select("_twice"), "parity-twice")
    if twice.isEmpty():
        discard(twice)
        return docs.join(few(lost), key == lost["_lost"], "left_anti")
    # the texts of an id that repeats are judged each, by their sets
    once = docs.join(twice, key == twice["_twice"], "left_anti")
    once = once.join(few(lost), once[id_col].cast("bigint") == lost["_lost"], "left_anti")
    many = _with_sets(docs.join(twice, key == twice["_twice"], "left_semi").dropDuplicates([id_col, text_col]), text_col, n)
    name, first = many.columns[-2:]
    at = many[id_col].cast("bigint")
    many = many.join(few(lost), (at == lost["_lost"]) & (many[name] == lost["_set"]), "left_anti")
    many = many.withColumn(first, F.row_number().over(Window.partitionBy(F.col(id_col).cast("bigint"), name).orderBy(text_col)))
    return once.unionAll(many.where((F.col(name) == 0) | (F.col(first) == 1)).drop(name, first))


def _with_sets(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """``docs`` with the name of each text's set (0 without a word) and a column of zeros, both under unused names."""
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            names = np.zeros(b.num_rows, np.uint64)
            for lo, data, offs in text_parts(b.column(at)):
                names[lo : lo + len(offs) - 1] = nodes_of(*sets(data, offs, n))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names.view(np.int64)), pa.array(np.zeros(b.num_rows, np.int32))], names=[*b.schema.names, f"{free}set", f"{free}first"])

    schema = T.StructType([*docs.schema.fields, T.StructField(f"{free}set", T.LongType()), T.StructField(f"{free}first", T.IntegerType())])
    return docs.mapInArrow(run, schema)
