import random

from quire.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string"


def brute_windows(costs, system, budget, history):
    out, new = [], system
    fixed = sum(costs[:system])
    while new < len(costs):
        start = new
        while start > system and sum(costs[start - 1 : new]) <= history and fixed + sum(costs[start - 1 : new + 1]) <= budget:
            start -= 1
        end = new + 1
        while end < len(costs) and fixed + sum(costs[start : end + 1]) <= budget:
            end += 1
        out.append((start, new, end))
        new = end
    return out or ([(system, system, system)] if system else [])


def test_windows_against_sums():
    r = random.Random(3)
    for _ in range(2000):
        costs = [r.randrange(0, 30) for _ in range(r.randrange(0, 15))]
        system = r.randrange(0, min(2, len(costs)) + 1) if costs else 0
        args = (costs, system, r.randrange(5, 80), r.randrange(0, 30))
        assert chat.windows(*args) == brute_windows(*args), args


def test_every_assistant_turn_is_a_target_once(spark):
    r = random.Random(5)
    rows = []
    for conv in range(40):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be kind"))
        rows += [(conv, k, "user" if k % 2 else "assistant", " ".join("w" * r.randrange(0, 80))) for k in range(1, r.randrange(2, 12))]
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA)
    out = chat.format_windows(df, 100, 30).collect()
    targets = [(w["conv_id"], t) for w in out for t, k in zip(w["turns"], w["targets"]) if k]
    assert sorted(targets) == sorted((c, t) for c, t, role, _ in rows if role == "assistant")
    for w in out:
        assert (w["turns"][0] == 0) == (w["conv_id"] % 3 == 0)
        fresh = [t for t in w["turns"] if t >= w["first_new"]]
        assert w["n_tokens"] <= 100 or len(fresh) == 1
        assert w["text"].count("<|end|>") == len(w["turns"])


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (2, 0, "system", "only"), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 1, "Assistant", "word " * 50_000), (4, 1, "Assistant", "word " * 50_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA)
    out = sorted(chat.format_windows(df).collect(), key=lambda r: (r["conv_id"], r["window"]))
    assert [(r["conv_id"], r["turns"], r["targets"]) for r in out] == [(1, [0, 0], [0, 0]), (2, [0], [0]), (4, [1], [1]), (4, [1], [1])]
    assert out[1]["first_new"] is None and out[2]["n_target_tokens"] == 50_002
    assert chat.format_windows(df.limit(0)).collect() == []


def test_the_query_against_brute_force(spark):
    """Windows of every conversation of the table, with tokens counted turn by turn."""
    from collections import defaultdict

    import numpy as np

    from quire.llm import queries, unigram

    sf, m = "/root/testdata/sf0.001", unigram.load(queries.MODEL)
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs[r["conv_id"]].append((r["turn"], r["role"].lower(), r["text"]))
    want = {}
    for c, ts in convs.items():
        ts.sort()
        texts = [chat.OPEN.format(role) + text + chat.CLOSE for _, role, text in ts]
        costs = [int(unigram.encode_rows(m, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1][0]) for t in texts]
        system = next((i for i, x in enumerate(ts) if x[1] != "system"), len(ts))
        for w, (start, new, end) in enumerate(brute_windows(costs, system, chat.BUDGET, chat.HISTORY)):
            own = [*range(system), *range(start, end)]
            target = [int(i >= new and ts[i][1] == "assistant") for i in own]
            want[c, w] = (ts[new][0] if new < len(ts) else None, [ts[i][0] for i in own], target, sum(costs[i] for i in own), sum(costs[i] for i, k in zip(own, target) if k), "".join(texts[i] for i in own))
    got = {(r["conv_id"], r["window"]): tuple(r)[2:] for r in queries.QUERIES["op7_chat_windows"](spark, sf).collect()}
    assert got == want and any(sum(x[2]) for x in want.values())
