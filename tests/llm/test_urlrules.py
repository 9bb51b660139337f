from itertools import combinations

from pyspark.sql import functions as F

from quire.llm import urlrules as U

SCHEMA = "page_id bigint, url string, tokens string, confidence string"


def urls(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def fixture():
    pages, labels = [], []
    for i in range(240):
        kind = i % 4
        host = ["good.example.org", "shop.example.com", "blog.example.net", "shop.example.com"][kind]
        path = ["news", "pills", "pills", "news"][kind]
        pages.append((i, f"https://{host}/{path}/{i}?ref={i}"))
        labels.append((i, kind == 1 or i == 2))
    return pages, labels


def test_tokens(spark):
    df = urls(spark, [(1, "HTTPS://u@WWW.a.Example.com:80/x/12/Foo-bar.html?q=1&r=2#z"), (2, None), (3, ""), (4, "no scheme")])
    got = {r["page_id"]: r["t"] for r in df.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    assert got[1] == sorted(["scheme:https", "host:www.a.example.com", "host:a.example.com", "host:example.com", "host:com", "path:x", "path:#", "path:foo", "path:bar", "path:html", "key:q", "key:r"])
    assert got[2] == got[3] == [] and got[4] == ["host:no scheme"]


def test_rules_against_counting(spark):
    pages, labels = fixture()
    df, lab = urls(spark, pages), spark.createDataFrame(labels, "id bigint, bad boolean")
    sets = {r["page_id"]: set(r["t"]) for r in df.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    bad = {i for i, b in labels if b}
    want = {}
    for n in (1, 2, 3):
        for c in combinations(sorted(set().union(*sets.values())), n):
            hit = [i for i, s in sets.items() if s >= set(c)]
            good = sum(i in bad for i in hit)
            if good >= U.MIN_COUNT and good / len(hit) >= 0.8:
                want[c] = good / len(hit)
    want = {c: v for c, v in want.items() if not any(set(d) < set(c) and w >= v for d, w in want.items())}
    rules = U.mine(df, lab)
    assert {tuple(r["tokens"]): round(r["confidence"], 9) for r in rules.collect()} == {c: round(v, 9) for c, v in want.items()}
    got = {r["page_id"]: r for r in U.apply_rules(df, rules).collect()}
    for i, s in sets.items():
        n = sum(s >= set(c) for c in want)
        assert got[i]["n_rules"] == n and got[i]["keep"] == (n == 0)
    assert not got[1]["keep"] and got[2]["keep"] and got[3]["keep"]


def test_rules_of_every_size_against_counting(spark):
    """Bad are 20 URLs with all of host, two path words and a key; any three of them occur on 10 good ones too."""
    parts = ["bad.example.com", "pills", "cheap", "ref"]
    others = ["good.example.com", "news", "daily", "page"]
    pages, labels = [], []
    for lack, n in [(None, 20), *((k, 10) for k in range(4))]:
        for _ in range(n):
            host, a, b, key = (others[k] if k == lack else x for k, x in enumerate(parts))
            labels.append((len(pages), lack is None))
            pages.append((len(pages), f"https://{host}/{a}/{b}?{key}=1"))
    df = urls(spark, pages)
    sets = {r["page_id"]: set(r["t"]) for r in df.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    bad = {i for i, b in labels if b}
    every = sorted(set().union(*sets.values()))
    want = {}
    for n in range(1, len(every) + 1):
        for c in combinations(every, n):
            hit = [i for i, s in sets.items() if s >= set(c)]
            if (hits := sum(i in bad for i in hit)) >= U.MIN_COUNT and hits / len(hit) >= 0.8:
                want[c] = hits / len(hit)
    want = {c: v for c, v in want.items() if not any(set(d) < set(c) and w >= v for d, w in want.items())}
    assert list(want) == [tuple(sorted(["host:bad.example.com", "path:pills", "path:cheap", "key:ref"]))]
    rules = U.mine(df, spark.createDataFrame(labels, "id bigint, bad boolean"))
    assert {tuple(r["tokens"]): r["confidence"] for r in rules.collect()} == want
    assert {r["page_id"] for r in U.apply_rules(df, rules).where("not keep").collect()} == bad


def test_pruning_against_counting(spark):
    """A rule may be implied by one two tokens shorter although the one between is less sure, or absent."""
    rules = [("a", 0.9), ("ab", 0.85), ("abc", 0.88), ("abcd", 0.95), ("bd", 0.95), ("bcde", 0.96), ("cf", 1.0), ("cdef", 1.0), ("abcdef", 1.0)]
    df = spark.createDataFrame([(list(t), c, 0.1) for t, c in rules], "tokens array<string>, confidence double, support double")
    want = {t for t, c in rules if not any(set(u) < set(t) and d >= c for u, d in rules)}
    assert sorted("".join(r["tokens"]) for r in U.prune(df).collect()) == sorted(want)
    assert U.prune(df.limit(0)).collect() == []


def test_edge_cases(spark):
    pages, labels = fixture()
    odd = [(500, None), (501, ""), (None, pages[1][1]), (1, pages[1][1]), (502, "http://x/" + "a/" * 30_000)]
    df = urls(spark, pages + odd)
    rules = U.mine(df, spark.createDataFrame(labels + [(None, True), (5, None), (9999, True)], "id bigint, bad boolean"))
    out = U.apply_rules(df, rules)
    rows = out.collect()
    assert len(rows) == len(pages) + len(odd) and out.columns == ["page_id", "n_rules", "confidence", "rule", "keep"]
    assert {r["page_id"]: r["keep"] for r in rows if r["page_id"] in (500, 501, 502)} == {500: True, 501: True, 502: True}
    assert [r["keep"] for r in rows if r["page_id"] is None] == [False]
    none = U.mine(df, spark.createDataFrame([], "id bigint, bad boolean"))
    assert none.count() == 0 and U.apply_rules(df, none).where("not keep").count() == 0
    assert U.apply_rules(df.limit(0), rules).collect() == []


def test_the_query_against_counting(spark):
    """All token combinations of bad pages of the table, counted one by one; and what they say of every page."""
    from quire.llm import queries

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sets = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    bad = {r["id"] for r in U.weak_labels(pages).where("bad").collect()}
    urls_ = {r["page_id"]: r["url"] for r in pages.collect()}
    assert bad == {i for i, u in urls_.items() if any(w in u.split("/")[2].replace("-", ".").split(".") for w in U.SEEDS)}
    least = max(U.MIN_COUNT, U.MIN_SUPPORT * len(sets))
    found = set()
    for i in bad:
        for n in range(1, len(sets[i]) + 1):
            found.update(combinations(sorted(sets[i]), n))
    want = {}
    for c in found:
        hit = [i for i, s in sets.items() if s >= set(c)]
        n = sum(i in bad for i in hit)
        if n >= least and n / len(hit) >= U.MIN_CONFIDENCE:
            want[c] = n / len(hit)
    want = {c: v for c, v in want.items() if not any(set(d) < set(c) and w >= v for d, w in want.items())}
    assert want
    got = queries.QUERIES["op6_url_rules"](spark, sf).collect()
    assert len(got) == len(sets) and any(not r["keep"] for r in got)
    for r in got:
        mine = sorted((-v, c) for c, v in want.items() if sets[r["page_id"]] >= set(c))
        assert r["n_rules"] == len(mine) and r["keep"] == (not mine)
        assert r["rule"] == (" & ".join(mine[0][1]) if mine else None)


def test_labels_from_seeds(spark):
    df = urls(spark, [(1, "http://www.free-bets.example.com/x"), (2, "https://bets"), (3, "https://alphabets.example.com/bets"), (4, None), (5, ""), (None, "http://spam.example.com")])
    assert {r["id"]: r["bad"] for r in U.weak_labels(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
