"""Conversations as token-budgeted training windows.

A conversation's turns are formatted with a template and counted in tokens of a tokenizer (in words without one). Prefix sums of
the counts give the cost of any span of turns. Windows are spans of whole turns: each
holds the leading system turn, then up to ``HISTORY`` tokens of turns that earlier windows
already had, then as many new turns as the budget allows, at least one. Only new assistant turns
are targets: the mask is 0 for system and user turns and for assistant turns repeated as
history, so that every assistant turn is a target exactly once.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unigram
from .shared import text_parts

BUDGET = 512
HISTORY = 128
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
#: Words of the template around every turn: its opening and its closing mark.
OVERHEAD = 2
FIELDS = [("conv_id", pa.int64()), ("window", pa.int64()), ("first_new", pa.int64()), ("turns", pa.list_(pa.int64())), ("targets", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_target_tokens", pa.int64()), ("text", pa.string())]
SCHEMA = "conv_id bigint, window bigint, first_new bigint, turns array<bigint>, targets array<int>, n_tokens bigint, n_target_tokens bigint, text string"


def windows(costs: list[int], system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Spans ``(history start, first new turn, end)`` over the turns after the ``system`` first ones.

    A turn that alone exceeds what the system turns leave gets a window of its own, over
    the budget, without history.
    """
    sums = [0]
    for c in costs:
        sums.append(sums[-1] + c)
    room = budget - sums[system]
    out, new = [], system
    while new < len(costs):
        # as far back as the history allows and the next turn still fits
        back = max(sums[new] - history, sums[new + 1] - room)
        start = new
        while start > system and sums[start - 1] >= back:
            start -= 1
        end = max(new + 1, bisect_right(sums, sums[start] + room) - 1)
        out.append((start, new, end))
        new = end
    if not out and system:
        out.append((system, system, system))
    return out


def costs_of(texts: list[str], model: unigram.Model | None) -> list[int]:
    """Tokens of every formatted turn; words where there is no model (its marks count one each)."""
    if model is None:
        return [len(t.split()) for t in texts]
    return np.concatenate([unigram.encode_rows(model, data, offs)[1] for _, data, offs in text_parts(pa.array(texts, pa.string()))]).tolist() if texts else []


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, model: unigram.Model | None = None) -> DataFrame:
    """All windows of all conversations of ``turns`` (``conv_id, turn, role, text``).

    Turns are counted with their marks, each by itself: in tokens of ``model``, else in words.

    ``turns`` lists the turn numbers of a window in order, ``targets`` has a mask of the same
    length, ``first_new`` is the first turn number that no earlier window had. Null text is
    empty text and null roles are ``user``. Turns are ordered by number, then role and text; repeated rows
    are kept, each as a turn. Rows without conversation id or turn number are dropped. Only
    leading turns of the role ``system`` are retained; later ones are turns like any other. A
    conversation of system turns alone gives one window without targets. Other columns are
    ignored; no rows give no windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.lower(F.coalesce(F.col("role").cast("string"), F.lit("user")))
    t = turns.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                convs_ = b.column(1).slice(lo, 256).to_pylist()
                costs = iter(costs_of([OPEN.format(x["role"]) + x["text"] + CLOSE for ts in convs_ for x in ts], model))
                for conv, ts in zip(b.column(0).slice(lo, 256).to_pylist(), convs_):
                    for x in ts:
                        x["cost"] = next(costs)
                    system = next((i for i, x in enumerate(ts) if x["role"] != "system"), len(ts))
                    for w, (start, new, end) in enumerate(windows([x["cost"] for x in ts], system, budget, history)):
                        own = [*range(system), *range(start, end)]
                        target = [int(i >= new and i >= system and ts[i]["role"] == "assistant") for i in own]
                        rows.append(
                            (conv, w, ts[new]["turn"] if new < len(ts) else None, [ts[i]["turn"] for i in own], target, sum(ts[i]["cost"] for i in own), sum(ts[i]["cost"] for i, k in zip(own, target) if k), "".join(OPEN.format(ts[i]["role"]) + ts[i]["text"] + CLOSE for i in own))
                        )
                cols = list(zip(*rows)) if rows else [[]] * len(FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(cols, FIELDS)], names=[n for n, _ in FIELDS])

    return convs.mapInArrow(run, SCHEMA)
