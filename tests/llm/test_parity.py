import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import parity as P
from quire.llm.components import components
from quire.llm.shared import text_parts

SCHEMA = "doc_id bigint, text string, node string, jaccard string, a int, names string, part string, _lost string, _twice string, count bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "j", 1, "x", "p", "en", "s", 1) for i, t in rows], SCHEMA)


def sets_of(texts):
    out = []
    for _, data, offs in text_parts(pa.array(texts, pa.string())):
        g, n = P.sets(data, offs)
        out += np.split(g, np.cumsum(n)[:-1])
    return [set(x.tolist()) for x in out]


def brute(rows, t=P.THRESHOLD):
    rows = [(i, x) for i, x in rows if i is not None]
    s = sets_of([x for _, x in rows])
    out = {}
    for k in range(len(rows)):
        for j in range(k):
            a, b = sorted((rows[j][0], rows[k][0]))
            if a != b and s[j] and s[k]:
                v = len(s[j] & s[k]) / len(s[j] | s[k])
                if v >= t:
                    out[a, b] = max(v, out.get((a, b), 0))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        text = [r.choice(words) for _ in range(int(r.lognormvariate(4, 1.2)) + 1)]
        rows.append((len(rows), " ".join(text)))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(int(len(text) * r.choice([0, 0.02, 0.06, 0.1, 0.2]))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_join_against_brute_force(spark):
    want, got = {}, {}
    for seed in range(4):
        rows = corpus(seed)
        want |= {(seed, *k): v for k, v in brute(rows).items()}
        got |= {(seed, r["doc_a"], r["doc_b"]): r["jaccard"] for r in P.jaccard_join(frame(spark, rows)).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.98 * len(want) and len(want) > 80


def test_edge_cases(spark):
    long = " ".join(f"v{i % 5000}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "Word"), (6, "two words"), (7, "TWO words!"), (8, long), (9, long + " more"), (10, "..."), (None, "two words"), (11, "a b c d"), (11, "two words"), (12, "a b c d"), (12, "a b c d")]
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in P.jaccard_join(frame(spark, rows)).collect()}
    want = brute(rows)
    assert set(got) == set(want) == {(4, 5), (6, 7), (6, 11), (7, 11), (8, 9), (11, 12)}
    assert P.jaccard_join(frame(spark, rows).limit(0)).collect() == []


def test_keep_one_of_each_group(spark):
    rows = corpus(9) + [(9000, None), (9001, ""), (None, "x y"), (9002, "same thing here"), (9002, "same thing here")]
    df = frame(spark, rows)
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in brute(rows):
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = sorted({root(i) for i in up})
    out = P.keep_one(df)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns
    assert sorted(i for i in kept if i is not None) == want and kept.count(None) == 1
    assert P.keep_one(df.limit(0)).collect() == []


def test_a_table_of_one_part_name(spark):
    for rows in ([(1, "word")], [(1, "word"), (2, "Word"), (2, "word")]):
        df = frame(spark, rows)
        assert {(r["doc_a"], r["doc_b"]) for r in P.jaccard_join(df).collect()} == set(brute(rows))
        assert [r["doc_id"] for r in P.keep_one(df).collect()] == [1]


def batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)


def test_groups_of_part_names_over_batches():
    """A batch of one name, first or later, and one that goes on with the name before it."""
    rows = lambda *r: batch([(k, 0, n, 1 << P.LOW_BITS, 0, n) for k, n in r], ["cell", "side", "node", "meta", "meta2", "root"])
    batches = [rows((1, 1)), rows((1, 2)), rows((2, 3)), rows((2, 4), (3, 5)), rows((3, 6))]
    got = [tuple(r.values()) for b in P._candidates(0.7)(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 2), (3, 4), (5, 6)]


def test_candidates_are_of_different_roots_and_sides():
    meta = 1 << P.LOW_BITS
    rows = [(c, s, n, meta, 0, r) for c, s, n, r in ((1, 0, 5, 5), (1, 0, 6, 5), (1, 0, 7, 7), (2, 1, 1, 1), (2, 1, 2, 2), (2, 2, 3, 3), (3, 0, 8, 8), (3, 0, 9, 8))]
    got = {tuple(r.values()) for b in P._candidates(0.7)(iter([batch(rows, ["cell", "side", "node", "meta", "meta2", "root"])])) for r in b.to_pylist()}
    assert got == {(5, 7), (6, 7), (1, 3), (2, 3)}


def test_stars_over_batches():
    rows = [batch(r, ["part", "node", "k"]) for r in ([(1, 4, 9)], [(1, 6, 9), (2, 1, 9)], [(2, 8, 9), (3, 3, 9)])]
    assert [tuple(r.values()) for b in P._stars(iter(rows)) for r in b.to_pylist()] == [(6, 4, 9), (8, 1, 9)]


def test_common_ngrams_by_matrix_product():
    r = np.random.default_rng(5)
    sets_ = [np.unique(r.integers(0, 300, r.integers(1, 200))).astype(np.uint64) for _ in range(40)]
    got = P.common_dense(np.concatenate(sets_), np.array([len(x) for x in sets_]))
    assert (got == [[len(np.intersect1d(a, b)) for b in sets_] for a in sets_]).sum() >= 40 * 39
    assert all(got[i, j] == len(np.intersect1d(sets_[i], sets_[j])) for i in range(40) for j in range(i))


def expected_links(rows):
    """Per id the least id of its component and the numbers of copies and links; ids are distinct."""
    ids = [i for i, _ in rows]
    s = dict(zip(ids, sets_of([x for _, x in rows])))
    up, n, same = {i: i for i in ids}, dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute(rows):
        x, y = sorted((root(a), root(b)))
        up[y] = x
        for i in (a, b):
            n[i] += 1
            same[i] += s[a] == s[b]
    return sorted((i, root(i), same[i], n[i]) for i in ids)


def test_links_against_brute_force(spark, monkeypatch):
    """One row per document; also with blocks of a few nodes and every name cut into blocks of two."""
    rows = corpus(21) + [(9000, None), (9001, ""), (9002, "..."), (9003, "word"), (9004, "Word")]
    want = expected_links(rows)
    assert sum(x[3] for x in want) > 60 and any(0 < x[2] < x[3] for x in want)
    df = frame(spark, rows)
    assert sorted(map(tuple, P.links(df).collect())) == want
    assert P.links(df).columns == ["doc_id", "class_id", "copies", "links"]
    assert P.links(df.limit(0)).collect() == []
    for name, value in (("BLOCK", 4), ("HOT", 2), ("HOT_SAMPLE", 1), ("DENSE", 3)):
        monkeypatch.setattr(P, name, value)
    assert sorted(map(tuple, P.links(df).collect())) == want


def test_links_of_ids_that_repeat(spark):
    x, y = "some words of a text", "quite another one instead"
    rows = [(5, x), (5, y), (3, y), (7, x), (7, x), (8, None), (None, x)]
    got = sorted(map(tuple, P.links(frame(spark, rows)).collect()))
    assert got == [(3, 3, 1, 1), (5, 3, 1, 1), (5, 5, 1, 1), (7, 5, 1, 1), (8, 8, 0, 0)]


def test_the_least_similar_pairs_share_a_part():
    """10,000 pairs of similarity 0.70 to 0.72, of 8 to 4,096 n-grams; one set in the other, or half of the differences in each, or any share."""
    r = np.random.default_rng(1)
    missed = tried = 0
    while tried < 10_000:
        c, j = int(np.exp(r.uniform(np.log(8), np.log(4096)))), r.uniform(0.7, 0.72)
        d = int(c * (1 - j) / j)
        x = (0, d // 2, int(r.integers(0, d + 1)))[tried % 3]
        if not 0.7 <= c / (c + d) <= 0.72:
            continue
        v = r.integers(0, 2**P.HASH_BITS, c + d, dtype=np.uint64)
        a, b = np.sort(v[: c + x]), np.sort(np.concatenate([v[:c], v[c + x :]]))
        names, rows = P.part_names(np.concatenate([a, b]), np.array([len(a), len(b)]), P.THRESHOLD)
        missed += not len(np.intersect1d(names[rows == 0], names[rows == 1]))
        tried += 1
    assert missed == 0


def test_whole_tables_against_sql_of_the_registry(spark):
    import duckdb

    from quire.llm import queries

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op8_ngram_jaccard_join"]).fetchall()
    got = queries.QUERIES["op8_ngram_jaccard_join"](spark, sf)
    assert got.columns == ["doc_id", "class_id", "copies", "links"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ids_of_several_texts_keep_one_of_each_group(spark):
    x, y = "some words of a text", "quite another one instead"
    rows = [(5, x), (5, y), (3, y), (7, x), (8, "first of eight"), (8, "second, not alike"), (9, None), (9, "nine"), (9, None), (10, "two words"), (10, "two words!"), (11, "NINE")]
    got = [(r["doc_id"], r["text"]) for r in P.keep_one(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(3, y), (5, x), (8, "first of eight"), (8, "second, not alike"), (9, None), (9, "nine"), (10, "two words")], key=repr)


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(50):
        text = list(base)
        text[r.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(text)))
    assert P.jaccard_join(frame(spark, rows)).count() == 50 * 49 // 2 == len(brute(rows))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**46 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**46 - 1), min_size=1, max_size=300))
def test_sketch_distance_is_a_lower_bound(a, b):
    g, size = np.array(sorted(a) + sorted(b), np.uint64), np.array([len(a), len(b)])
    (low, high), wide = P.short_sketch(g, size), P._wide(g, size)
    mask = np.uint64((1 << P.LOW_BITS) - 1)
    assert np.bitwise_count((low[0] ^ low[1]) & mask) + np.bitwise_count(high[0] ^ high[1]) <= len(a ^ b)
    assert np.bitwise_count(wide[0] ^ wide[1]).sum() <= len(a ^ b)


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(1, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(30)] + [(7, 7), (3, 4)]
    up = list(range(200))

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {i: root(i) for i in {x for a, b in edges if a != b for x in (a, b)}}
    got = {r["item"]: r["group"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
