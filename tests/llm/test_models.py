import math
import random

import numpy as np
import pytest

from quire.llm import langid as L
from quire.llm import llr as Q

SCHEMA = "doc_id bigint, text string, lang string, prob string, score string, labels string"
VOCABULARY = {"aa": "kala mata tuli sano vene", "bb": "strung xylth grympt schwach bild", "cc": "été naïve où ça forêt"}


def text(lang, r, n=30):
    return " ".join(r.choice(VOCABULARY[lang].split()) for _ in range(n))


def docs(spark, seed=0, n=120, extra=()):
    r = random.Random(seed)
    rows = [(i, text(lang, r), lang) for i in range(n) for lang in [sorted(VOCABULARY)[i % 3]]]
    return spark.createDataFrame([(*x, "p", "s", "l") for x in [*rows, *extra]], SCHEMA)


def test_gradients_are_those_of_finite_differences():
    m = L.start(["a", "b", "c"], 4, 1)
    for w in m.arrays():
        w[...] = w.astype(np.float64)
    m = L.Model(m.langs, *(w.astype(np.float64) for w in m.arrays()))
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (9, 5)), r.integers(0, 3, 5)
    _, grads = L.loss_and_grads(m, x, y)
    for w, g in zip(m.arrays(), grads):
        flat, gf = w.ravel(), g.ravel()
        for k in np.argsort(-abs(gf))[:5]:
            old, e = flat[k], 1e-3
            flat[k] = old + e
            up = L.loss_and_grads(m, x, y)[0]
            flat[k] = old - e
            down = L.loss_and_grads(m, x, y)[0]
            flat[k] = old
            assert gf[k] == pytest.approx((up - down) / (2 * e), rel=0.08, abs=2e-4)


def states_one_by_one(m, data):
    h, out = m.u.shape[2], np.zeros((2, len(data), m.u.shape[2]))
    for d in (0, 1):
        prev = np.zeros(h)
        for t in range(len(data)) if d == 0 else range(len(data) - 1, -1, -1):
            g = m.emb[d][:, data[t]].astype(float)
            zr = np.clip(0.25 * (g[: 2 * h] + m.u[d] @ prev) + 0.5, 0, 1)
            c = g[2 * h :] + m.un[d] @ (zr[h:] * prev)
            c /= 1 + abs(c)
            prev = prev + zr[:h] * (c - prev)
            out[d, t] = prev
    p = np.exp(np.concatenate([out[0], out[1]], 1) @ m.out.T + m.bias[:, 0])
    return p / p.sum(1, keepdims=True)


def test_labels_and_pooling_against_one_byte_at_a_time():
    m = L.start(["a", "b", "c"], 5, 3)
    r = np.random.default_rng(1)
    rows = [r.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 40, 16, 17, 200, 3)]
    data, offs = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    labels, pooled, votes = L.label_rows(m, data, offs, window=16, width=4)
    for i, x in enumerate(rows):
        if not len(x):
            assert np.isnan(pooled[i]).all() and votes[i].sum() == 0
            continue
        p = np.concatenate([states_one_by_one(m, x[k : k + 16]) for k in range(0, len(x), 16)])
        assert np.allclose(pooled[i], p.mean(0), atol=1e-5)
        assert (labels[offs[i] : offs[i + 1]] == p.argmax(1)).mean() > 0.98 and votes[i].sum() == len(x)


def test_held_out_accuracy_and_edge_cases(spark):
    odd = [(900, None, "aa"), (901, "", "aa"), (None, "kala mata", "aa"), (902, "kala " * 30_000, None), (3, "kala", "aa"), (3, "kala", "aa")]
    df = docs(spark, extra=odd)
    m = L.fit(df, steps=60, batch=48)
    assert m.langs == sorted(VOCABULARY)
    fresh = docs(spark, seed=5)
    got = L.identify(fresh, m).collect()
    truth = {r["doc_id"]: r["lang"] for r in fresh.collect()}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) >= 0.95
    rows = L.identify(df, m).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[900]["lang_pred"] is None and by[901]["prob"] is None and by[902]["lang_pred"] == "aa"
    assert all(len(r["labels"]) == r["n_bytes"] == sum(r["counts"]) for r in rows)
    kept = L.keep_identified(df, m)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.schema == df.schema and 900 not in ids and 901 not in ids and ids.count(None) == 1 and set(range(120)) <= set(ids)
    empty = df.limit(0)
    none = L.fit(empty)
    assert none.langs == [] and L.identify(empty, none).collect() == [] and L.keep_identified(empty, m).collect() == []
    assert L.identify(df, none).where("lang_pred is null").count() == df.count() and L.keep_identified(df, none).count() == df.count() - 2


def words(t):
    return t.lower().split()


def test_ratio_against_counting(spark):
    rows = [(0, "good words here good"), (1, "bad bad bad bad"), (2, "good words"), (3, None), (4, ""), (5, "  "), (None, "good bad"), (2, "good words")]
    df = spark.createDataFrame([(i, t, "en", "p", "s", "l") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0, "z"), (1, 0, 0, "z"), (2, 1, 1, "z"), (None, 1, 0, "z"), (9, None, 0, "z")], "doc_id bigint, quality int, toxic int, text string")
    m = Q.fit(df, labels)

    def features(t):
        w = words(t or "")
        return [(x,) for x in w] + [("same",) * 2 if a == b else (a, b) for a, b in zip(w, w[1:])]

    raw, target = {}, {}
    for i, t in rows:
        for f in features(t):
            raw[f] = raw.get(f, 0) + 1
            if i == 0:
                target[f] = target.get(f, 0) + 1
    nr, nt = sum(raw.values()), sum(target.values())
    p = lambda c, n: math.log((c + Q.ALPHA) / (n + Q.ALPHA * Q.BUCKETS))
    want = lambda t: np.mean([p(target.get(f, 0), nt) - p(raw[f], nr) for f in features(t)])
    out = Q.score(df, m)
    for r in out.collect():
        t = next(t for i, t in rows if i == r["doc_id"] and (r["doc_id"] is not None or t))
        if r["n_features"]:
            assert r["score"] == pytest.approx(want(t)) and r["keep"] == (r["score"] >= m.threshold)
        else:
            assert r["score"] is None and r["keep"] is False
    assert out.count() == len(rows) and not [r for r in out.collect() if r["doc_id"] == 1][0]["keep"]
    kept = Q.keep_good(df, m)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 2, 2]


def test_without_labels_or_rows_nothing_is_cut(spark):
    df = docs(spark, n=6)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    m = Q.fit(df, none)
    assert m.threshold == float("-inf") and Q.keep_good(df, m).count() == 6
    assert Q.score(df.limit(0), Q.fit(df.limit(0), none)).collect() == []


def test_threshold_is_the_cheapest_cut():
    r = np.random.default_rng(2)
    good, bad = np.round(r.normal(1, 1, 60), 1), np.round(r.normal(-1, 1, 40), 1)
    t = Q.choose_threshold(good, bad)
    cost = lambda c: Q.GOOD_WEIGHT * (good < c).mean() + (bad >= c).mean()
    assert cost(t) == pytest.approx(min(cost(c) for c in np.arange(-6, 6, 0.01)))


def test_the_training_sample_is_bounded_and_covers_rare_languages(spark):
    """An id of very many rows counts once, a language of one text is learned, a long text gives its middle."""
    long = "a" * 30_000 + "b" * L.SAMPLE_CHARS + "c" * 30_000
    extra = [(7, f"row {k}", "aa") for k in range(3000)] + [(5000, "jedno slovo", "zz"), (5001, long, "yy"), (5002, "no language", None)]
    got, langs = L.training_rows(docs(spark, n=1500, extra=extra), per_language=20)
    assert {k: langs.count(k) for k in set(langs)} == {"aa": 20, "bb": 20, "cc": 20, "yy": 1, "zz": 1}
    assert got[langs.index("yy")] == "b" * L.SAMPLE_CHARS and got[langs.index("zz")] == "jedno slovo"
    many = spark.createDataFrame([(k, "x", f"l{k}", "p", "s", "l") for k in range(L.MOST_LANGUAGES + 1)], SCHEMA)
    with pytest.raises(ValueError):
        L.training_rows(many, per_language=2)


def test_scores_of_very_long_texts_and_clashing_columns(spark):
    rows = [(k, "fine words of prose here", 1) for k in range(6)] + [(10 + k, "spam spam spam spam", 0) for k in range(4)]
    df = spark.createDataFrame([(i, t, 1.0, 2, 3, True, -1) for i, t, _ in [*rows, (50, "fine words " * 200_000, 1), (50, "fine words " * 200_000, 1)]], "doc_id bigint, text string, score double, bucket int, raw int, keep boolean, target int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    m = Q.fit(df, labels)
    kept = Q.keep_good(df, m)
    out = Q.score(df, m)
    scores = out.collect()
    assert out.columns == ["doc_id", "n_features", "score", "keep"] and len(scores) == 12
    assert [r["n_features"] for r in scores if r["doc_id"] == 50] == [799_999] * 2
    f, _ = Q.features(np.frombuffer(("fine words " * 200_000).encode(), np.uint8), np.array([0, 2_200_000]))
    assert all(r["score"] == pytest.approx(m.llr[f].mean()) for r in scores if r["doc_id"] == 50)
    assert all(r["keep"] == (r["score"] >= m.threshold) for r in scores)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in scores if r["keep"])
    assert Q.fit(df, labels.limit(0)).threshold == float("-inf")


@pytest.mark.parametrize("name", ["op5_language_id", "op9_quality_llr"])
def test_queries_cover_every_row(spark, name):
    """The query is the operator over all documents: same ids, and what a second computation of each text gives."""
    from quire.llm import queries
    from quire.llm.shared import text_parts
    import pyarrow as pa

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    if name == "op5_language_id":
        m = L.fit(table)
        truth = {r["doc_id"]: r["lang"] for r in table.collect()}
        for i in sorted(texts)[:12]:
            x = np.frombuffer(texts[i].encode()[: 4 * L.WINDOW], np.uint8)
            p = np.concatenate([states_one_by_one(m, x[k : k + L.WINDOW]) for k in range(0, len(x), L.WINDOW)])
            assert (np.frombuffer(got[i]["labels"], np.uint8)[: len(x)] == p.argmax(1)).mean() > 0.98
        assert sum(got[i]["lang_pred"] == truth[i] for i in got if len(texts[i]) > 40) >= 0.97 * sum(len(t) > 40 for t in texts.values())
        return
    m = Q.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    for i, t in texts.items():
        for _, data, offs in text_parts(pa.array([t])):
            f, _ = Q.features(data, offs)
        assert got[i]["n_features"] == len(f)
        if len(f):
            assert got[i]["score"] == pytest.approx(m.llr[f].mean()) and got[i]["keep"] == bool(got[i]["score"] >= m.threshold)


@pytest.mark.parametrize("near", [1_000_000, 0])
def test_target_and_threshold_take_every_label(spark, monkeypatch, near):
    """Of more labelled ids than were once sampled, each counts, whether labels are broadcast or not and however many ranges the scores have."""
    monkeypatch.setattr(Q, "BROADCAST_ROWS", near, raising=False)
    monkeypatch.setattr(Q, "CUT_ROWS", 40, raising=False)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(("fine prose here", "spam junk offer")[(r.random() < 0.3) ^ (i % 3 == 0)].split()) for _ in range(r.randint(1, 30)))) for i in range(0, 120_000, 400)]
    rows += [rows[5], (None, "fine prose"), (130_000, "spam"), (400, ""), (800, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.range(120_000).selectExpr("id AS doc_id", "CAST(id % 3 != 0 AS INT) AS quality", "CAST(id % 7 = 0 AS INT) AS toxic")
    m = Q.fit(df, labels)

    def counts(texts):
        data = [(t or "").encode() for t in texts]
        f, _ = Q.features(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        return np.bincount(f, minlength=Q.BUCKETS)

    inside = lambda i: i is not None and i < 120_000
    want = Q.ratios(counts([t for _, t in rows]), counts([t for i, t in rows if inside(i) and i % 3 and i % 7]))
    assert np.array_equal(m.llr, want)
    scores = [(x["doc_id"], x["score"]) for x in Q.score(df, m).collect() if inside(x["doc_id"]) and x["score"] is not None]
    assert len({s for _, s in scores}) > 80
    assert m.threshold == Q.choose_threshold(np.array([s for i, s in scores if i % 3]), np.array([s for i, s in scores if i % 3 == 0]))


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_threshold_over_ranges_is_that_of_all_scores(spark, monkeypatch, rows):
    monkeypatch.setattr(Q, "CUT_ROWS", rows)
    r = np.random.default_rng(6)
    good, bad = np.round(r.normal(1, 1, 60), 1), np.round(r.normal(-1, 1, 40), 1)
    t = lambda g, b: spark.createDataFrame([(float(x), k) for xs, k in ((g, True), (b, False)) for x in xs], "score double, good boolean")
    assert Q.find_threshold(t(good, bad)) == Q.choose_threshold(good, bad)
    assert Q.find_threshold(t(good, [])) == Q.find_threshold(t([], bad)) == Q.find_threshold(t([], [])) == float("-inf")
    assert Q.find_threshold(t([0.5], [0.5])) == -0.5
