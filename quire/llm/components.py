"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``item, group`` for every end of ``edges`` (columns ``a, b``, bigint); the group is its least item.

    Alternates large-star and small-star steps, which halve the distance to the least item
    and never hold more rows than there are edges, until nothing changes. Every round is
    written to the shared folder, so a lost executor repeats one round at most. Loops
    and repeated edges do no harm; no edges give no rows.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
    mark = None
    while True:
        # large star: every larger neighbour is hung on the least one
        both = e.unionAll(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        big = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: every smaller neighbour and the item itself too
        low = big.groupBy("v").agg(F.min("u").alias("m"))
        small = big.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u")))
        new = materialize(small.where("v <> u").distinct(), "cc")
        now = new.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
        discard(e)
        e = new
        if mark == now:
            break
        mark = now
    out = e.select(F.col("v").alias("item"), F.col("u").alias("group"))
    out = out.unionAll(e.select(F.col("u").alias("item"), F.col("u").alias("group")).distinct())
    done = materialize(out, "cc-done")
    discard(e)
    return done
