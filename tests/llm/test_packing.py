import random
from collections import Counter, defaultdict

import pytest

from quire.llm import packing

SCHEMA = "doc_id bigint, text string, seq string, n string, extra array<int>"


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


def check(rows, texts, capacity):
    seqs = defaultdict(list)
    for r in rows:
        if r["n"]:
            seqs[r["seq"]].append((r["at"], r["n"]))
        else:
            assert r["seq"] is None and r["at"] is None
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end = at + n
        assert end <= capacity
    assert sorted(seqs) == list(range(len(seqs)))
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n"]
    want = Counter()
    for i, t in texts:
        want[i] += len((t or "").split())
    assert got == want
    return len(seqs)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_sequential_best_fit(seed):
    r = random.Random(seed)
    sizes = [min(99, max(1, int(r.lognormvariate(2.5, 1.0)))) for _ in range(800)]
    _, n, steps = packing.plan(dict(Counter(sizes)), 100)
    assert n <= 1.03 * best_fit_decreasing(sizes, 100) + 1
    assert steps < 400


def test_pack_places_every_word_once(spark):
    r = random.Random(1)
    texts = [(i, " ".join("w" for _ in range(int(r.lognormvariate(2.5, 1.2))))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, " \n\t "), (303, "x " * 1000), (7, texts[7][1]), (None, "a b c"), (304, "  a\nb\t c  ")]
    df = spark.createDataFrame([(i, t, "s", "n", [1]) for i, t in texts], SCHEMA)
    rows = packing.pack(df, 50).collect()
    n = check(rows, texts, 50)
    pieces = [len((t or "").split()) for _, t in texts]
    rests = [p % 50 for p in pieces if p % 50]
    assert n <= sum(p // 50 for p in pieces) + 1.05 * best_fit_decreasing(rests, 50) + 1
    again = packing.pack(df.repartition(3), 50).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_pack_of_nothing_and_of_bad_capacity(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack(df).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def placed(sizes, capacity):
    """The plan, piece by piece: supersteps over single pieces and gaps instead of runs of equal ones.

    Every step opens sequences for the largest pieces that no gap holds, then walks pieces and gaps by falling value with
    a stack, whose top is the smallest gap that holds the piece: each piece's successor, one piece a gap, lower ranks first.
    """
    items = sorted(((-s, k) for k, s in enumerate(sizes)))
    gaps, where, n = [], {}, 0
    while items:
        largest = max((g for g, _ in gaps), default=0)
        stuck = [x for x in items if -x[0] > largest]
        if stuck:
            room = max(-(-sum(-s for s, _ in stuck) // capacity), sum(-2 * s > capacity for s, _ in stuck))
            for s, k in stuck[:room]:
                where[k] = (n, 0)
                if -s < capacity:
                    gaps.append((capacity + s, n))
                n += 1
            items = stuck[room:] + [x for x in items if -x[0] <= largest]
        gaps.sort(key=lambda x: (-x[0], -x[1]))
        stack, k, waiting, left = [], 0, [], []
        for s, i in items:
            while k < len(gaps) and gaps[k][0] >= -s:
                stack.append(gaps[k])
                k += 1
            if not stack:
                waiting.append((s, i))
                continue
            g, b = stack.pop()
            where[i] = (b, capacity - g)
            if g + s > 0:
                left.append((g + s, b))
        items, gaps = waiting, stack + gaps[k:] + left
    return where


@pytest.mark.parametrize("seed", range(3))
def test_pack_against_single_pieces(spark, seed):
    """Each piece in the sequence and place that supersteps over single pieces give it."""
    r = random.Random(40 + seed)
    sizes = [min(60, max(1, int(r.lognormvariate(2.5, 1.0)))) for _ in range(400)]
    df = spark.createDataFrame([(i, "w " * s, "s", "n", [1]) for i, s in enumerate(sizes)], SCHEMA)
    got = {r["doc_id"]: (r["seq"], r["at"]) for r in packing.pack(df, 60).collect()}
    assert got == placed(sizes, 60)


def test_the_query_places_every_word_of_the_table(spark):
    from quire.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op1_best_fit_packing"](spark, sf).collect()
    n = check(rows, texts, packing.CAPACITY)
    order = sorted(((-r["n"], r["doc_id"], r["piece"]) for r in rows if r["n"]))
    full = sum(-s == packing.CAPACITY for s, _, _ in order)
    rests = [-s for s, _, _ in order[full:]]
    where = placed(rests, packing.CAPACITY)
    by = {(r["doc_id"], r["piece"]): (r["seq"], r["at"]) for r in rows}
    assert [by[i, p] for _, i, p in order[full:]] == [(where[k][0] + full, where[k][1]) for k in range(len(rests))]
    assert n <= full + 1.03 * best_fit_decreasing(rests, packing.CAPACITY) + 1
