"""URL filtering by association rules.

A URL is a set of tokens: scheme, host, every parent domain, path words, the shape of numbers,
query keys. Spark's FP-growth mines token combinations from labelled URLs; a rule is a
combination of which most labelled URLs are bad. Rules are pruned by support and
confidence, and a rule that a more general one of no less confidence implies is dropped. An
inverted index files every rule under its rarest token; each URL looks up its tokens and
verifies the rules it finds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: A combination must occur among the bad in this share of the labelled URLs, and so often at least.
MIN_SUPPORT = 0.002
MIN_COUNT = 3
MIN_CONFIDENCE = 0.8
BAD = "label:bad"
#: Words of a host's name that make a URL bad where there are no labels.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "xxx")
#: Rules up to which the index is broadcast.
BROADCAST_ROWS = 100_000


def tokens(url):
    """The distinct tokens of a URL column, sorted; none for a null or empty one."""
    u = F.lower(F.trim(F.coalesce(url.cast("string"), F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"(^.*@)|(:\d+$)", "")
    rest = F.substring(bare, F.length(F.regexp_extract(bare, r"^([^/?#]*)", 1)) + 1, 1 << 30)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n - i + 1), ".")))
    words = F.transform(F.split(F.regexp_extract(rest, r"^([^?]*)", 1), r"[^\p{L}\p{N}]+"), lambda w: F.concat(F.lit("path:"), F.when(w.rlike(r"^\d+$"), F.lit("#")).otherwise(w)))
    keys = F.transform(F.split(F.regexp_replace(rest, r"^[^?]*\??", ""), r"[&;]"), lambda q: F.concat(F.lit("key:"), F.regexp_extract(q, r"^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)))
    every = F.array_distinct(F.flatten(F.array(scheme, domains, words, keys)))
    return F.when(u == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.filter(every, lambda x: ~x.isin("host:", "path:", "key:", "scheme:"))))


def weak_labels(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``id, bad`` of every URL with an id: bad if a word of its host's name (as letters and digits part words) is a seed.

    Null and empty URLs are labelled not bad; :func:`mine` leaves them out, as they have no tokens.
    """
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(url_col).cast("string"), F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    words = F.split(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"[^\p{L}\p{N}]+")
    return urls.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.arrays_overlap(words, F.array(*map(F.lit, seeds))).alias("bad"))


def mine(urls: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens, confidence, support`` from ``labels`` (``id, bad``), written to the shared folder.

    Every labelled URL counts; null and empty ones have no tokens and don't. Ids labelled more than once are bad if any label says so;
    rows that repeat an id count each. A rule's tokens and the label occur together in ``min_support`` of the labelled URLs and
    ``min_count`` of them at least; of these, ``min_confidence`` or more are bad (a share equal to a limit is enough). Rules may have any number of tokens.
    Fewer than ``min_count`` bad URLs give no rule. Of rules of equal tokens there is one; other columns are ignored.
    """
    known = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    base = urls.select(F.col(id_col).cast("bigint").alias("id"), tokens(F.col(url_col)).alias("tokens")).join(known, "id").where(F.size("tokens") > 0)
    baskets = materialize(base.select(F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")), "url-baskets")
    total, bad = baskets.agg(F.count("*"), F.coalesce(F.sum(F.array_contains("items", F.lit(BAD)).cast("int")), F.lit(0))).first()
    empty = "tokens array<string>, confidence double, support double"
    if not bad or bad < min_count:
        discard(baskets)
        return baskets.sparkSession.createDataFrame([], empty)
    support = max(min_support, min_count / total)
    # a rule's combination is frequent together with the label, so tokens rare among bad URLs can't take part
    useful = baskets.where(F.array_contains("items", F.lit(BAD))).select(F.explode("items").alias("x")).groupBy("x").count().where(F.col("count") >= support * total).select("x")
    useful = [r["x"] for r in useful.collect()]
    slim = baskets.select(F.array_intersect("items", F.lit(useful)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(slim)
    r = model.associationRules.where(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    r = materialize(r, "url-rules-all")
    kept = prune(r)
    discard(baskets, r)
    return kept


def prune(rules: DataFrame) -> DataFrame:
    """The rules that no rule of fewer tokens, all of them theirs, and of no less confidence implies.

    Goes by the number of tokens: what a dropped rule implies, the one that implied it implies
    too, so each size is compared with the kept rules of smaller sizes only, by an equi-join on their first token.
    """
    sizes = sorted(x[0] for x in rules.select(F.size("tokens")).distinct().collect())
    kept, levels = None, []
    for n in sizes:
        level = rules.where(F.size("tokens") == n)
        if kept is not None:
            general = kept.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("fewer"), F.col("confidence").alias("surer"))
            implied = level.select("tokens", "confidence", F.explode("tokens").alias("token")).join(general, "token")
            implied = implied.where((F.col("surer") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0))
            level = level.join(implied.select("tokens").distinct(), "tokens", "left_anti").select(*rules.columns)
        levels.append(materialize(level, "url-rules-level"))
        kept = levels[-1] if kept is None else kept.unionAll(levels[-1])
    out = materialize(rules if kept is None else kept, "url-rules")
    discard(*levels)
    return out


def apply_rules(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, n_rules, confidence, rule, keep`` of every URL.

    ``rule`` and ``confidence`` are those of the surest matching rule (the first in order of its tokens among
    equals), null without one. A URL that any rule matches isn't kept. Null and empty
    URLs match nothing and are kept; repeated rows and rows without id are judged each.
    """
    parts = urls.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("_url"), tokens(F.col(url_col)).alias("tokens"))
    ranked = rules.select(F.col("tokens").alias("rule"), "confidence", F.monotonically_increasing_id().alias("r"))
    common = ranked.select("r", F.explode("rule").alias("token")).join(ranked.select(F.explode("rule").alias("token")).groupBy("token").count(), "token")
    # filed under the token that fewest rules share, which few URLs have
    filed = common.groupBy("r").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    index = ranked.join(filed, "r").groupBy("token").agg(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "rule", "confidence")).alias("rules"))
    index = materialize(index, "url-index")
    small = index.count() <= BROADCAST_ROWS
    # each distinct URL looks up once; its rows share the answer
    distinct = parts.select("_url", "tokens").where(F.size("tokens") > 0).dropDuplicates(["_url"])
    hits = distinct.select("_url", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if small else index, "token")
    hits = hits.select("_url", F.filter("rules", lambda x: F.size(F.array_except(x["rule"], F.col("tokens"))) == 0).alias("rules")).where(F.size("rules") > 0)
    found = hits.groupBy("_url").agg(F.array_sort(F.flatten(F.collect_list("rules"))).alias("rules"))
    best = found.select("_url", F.size("rules").cast("bigint").alias("n_rules"), F.col("rules")[0]["confidence"].alias("confidence"), F.array_join(F.col("rules")[0]["rule"], " & ").alias("rule"))
    out = parts.join(best, "_url", "left")
    return out.select("page_id", F.coalesce("n_rules", F.lit(0).cast("bigint")).alias("n_rules"), "confidence", "rule", F.col("n_rules").isNull().alias("keep"))
