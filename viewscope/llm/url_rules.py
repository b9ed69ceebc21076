"""URL filters: stated host/path rules first, mined association rules for the rest.

URLs become token sets (host suffixes, path segments with digits folded, query
keys). Spark's FP-growth mines token combinations together with the label of
URLs whose label is known; rules `tokens -> label` are pruned by support and
confidence, and dropped when a subset of their tokens already says the same at
least as surely. Combinations that this would drop anyway are not generated: tokens of one
label are rules already, and tokens that always occur together are mined as one. An inverted
index keeps each rule under its rarest token, so a URL meets only rules that share that token with it.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewscope.session import materialize

# (verdict, host, path prefix): fixed values of the registered query
STATED_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
DEFAULT_VERDICT = "allow"
_LABEL = "="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest stated rule that fits, else nulls.

    A rule fits its host and all subdomains when the path starts with its own.
    """
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules or STATED_RULES, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes, path segments (digits folded to 0), query keys."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""),
                           lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, r"\d+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""),
                       lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, segments, keys)))


def _token_roles(rows: DataFrame, least: int) -> DataFrame:
    """(t, rep, n, verdict) of every token in ``least`` of ``rows`` (tokens, label) or more.

    ``rep`` is the least of the tokens that lie in exactly the same rows: a rule says the same with any of them, and two
    of them in one rule say no more than one, so only ``rep`` is mined. ``verdict`` is set when all rows of the token have that label: no
    combination with such a token can be surer than the token alone. Tokens share rows when the counts and sums of
    the hashes of their token sets agree; the tokens of a class lie in one URL, so a class is no longer than a URL.
    """
    sets = rows.groupBy("tokens", "label").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64("tokens", "label"))
    low = F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))
    per_token = (sets.select(F.explode("tokens").alias("t"), "label", "_n", "_h", low.alias("_l"),
                             F.shiftrightunsigned("_h", 32).alias("_u"))
                 .groupBy("t").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_sets"), F.sum("_l").alias("_l"),
                                   F.sum("_u").alias("_u"), F.bit_xor("_h").alias("_x"), F.min("label").alias("_lo"),
                                   F.max("label").alias("_hi")).where(F.col("n") >= least))
    classes = per_token.groupBy("n", "_sets", "_l", "_u", "_x").agg(
        F.min("t").alias("rep"), F.collect_list("t").alias("_members"),
        F.first(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).alias("verdict"))
    return materialize(classes.select(F.explode("_members").alias("t"), "rep", "n", "verdict"), "url-token-roles")


def class_tokens(sets: DataFrame, roles: DataFrame) -> DataFrame:
    """(tokens, classes) of each distinct token set: the tokens that rules can hold, by their ``rep``."""
    met = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("t")).join(
        roles.select("t", "rep"), "t")
    return met.groupBy("tokens").agg(F.collect_set("rep").alias("classes"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, roles): rules are (tokens, verdict, confidence, support) mined from ``labelled`` (tokens, label).

    Rows without tokens or label take no part; an empty table gives no rules.
    A rule needs ``min_support`` of the rows and ``MIN_COUNT`` rows at least; its tokens are any number, or
    ``max_tokens`` at most where given, each standing for its class (see ``_token_roles``). Tokens of one
    label are rules by themselves and leave the baskets before FP-growth sees them, as do rare tokens and all but one of
    a class, so a long path that many URLs share is one token there, not every subset of its segments.
    """
    rows = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select("tokens", "label")
    least = max(math.ceil(min_support * rows.count() - 1e-9), MIN_COUNT)
    roles = _token_roles(rows, least)
    alone = roles.where(F.col("verdict").isNotNull() & (F.col("t") == F.col("rep"))).select(
        F.array("rep").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), F.col("n").alias("support"))
    mixed = class_tokens(rows, roles.where("verdict IS NULL"))
    baskets = materialize(rows.join(mixed, "tokens").select(
        F.concat("classes", F.array(F.concat(F.lit(_LABEL), "label"))).alias("items")), "url-baskets")
    n = baskets.count()
    if not n:
        return materialize(alone, "url-rules"), roles
    # half a row below the count, so that rounding can't raise it
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    sets = materialize(model.freqItemsets, "itemsets")
    is_label = lambda t: t.startswith(_LABEL)
    if max_tokens is not None:
        sets = sets.where(F.size(F.filter("items", lambda t: ~is_label(t))) <= max_tokens)
    plain = sets.where(~F.exists("items", is_label)).select(
        F.array_sort("items").alias("tokens"), F.col("freq").alias("_all"))
    joint = sets.where(F.exists("items", is_label)).select(
        F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("tokens"),
        F.substring(F.element_at(F.filter("items", is_label), 1), 2, 10_000).alias("verdict"),
        F.col("freq").alias("support")).where(F.size("tokens") > 0)
    rules = joint.join(plain, "tokens").select(
        "tokens", "verdict", (F.col("support") / F.col("_all")).alias("confidence"), "support").where(
        F.col("confidence") >= min_confidence)
    # a rule says nothing new when dropping one token leaves a rule at least as sure
    shorter = rules.select("tokens", "verdict", "confidence", F.explode(
        F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("_less"))
    same = rules.select(F.col("tokens").alias("_less"), "verdict", F.col("confidence").alias("_sure"))
    idle = shorter.join(same, ["_less", "verdict"]).where(F.col("_sure") >= F.col("confidence")).select(
        "tokens", "verdict").distinct()
    return materialize(rules.join(idle, ["tokens", "verdict"], "left_anti").unionByName(alone), "url-rules"), roles


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of each distinct token set: tokens, verdict, confidence, matched rule.

    Surest first, then larger support, then more tokens, then token order.
    """
    weight = tokens.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    placed = rules.withColumn("_id", F.monotonically_increasing_id())
    rarest = (placed.select("_id", F.explode("tokens").alias("t")).join(weight, "t", "left")
              .groupBy("_id").agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t")))
    index = placed.join(rarest, "_id").select("t", F.col("tokens").alias("rule_tokens"), "verdict", "confidence",
                                              "support")
    met = tokens.select("tokens", F.explode("tokens").alias("t")).join(index, "t")
    fits = met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.max_by(F.struct("verdict", "confidence", "rule_tokens"),
                    F.struct("confidence", "support", F.size("rule_tokens"), "rule_tokens", "verdict"))
    return fits.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.*")


def judge_urls(pages: DataFrame, rules=None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, with the mined rule that decided (or null).

    Stated rules label the URLs they fit; combinations mined from those labels
    judge the others, and a URL that no rule meets gets ``default``. A null
    url or one without ``://`` has empty host and path. Repeated rows repeat.
    """
    url = pages.select("page_id", "url")
    parsed = url.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    parsed = materialize(parsed.select(
        "page_id", "host", "path", text.alias("rule"), verdict.alias("_stated"),
        url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    mined, roles = mine_rules(parsed.select("tokens", F.col("_stated").alias("label")))
    open_sets = parsed.where(F.col("rule").isNull() & (F.size("tokens") > 0)).select("tokens")
    by_class = materialize(class_tokens(open_sets, roles), "url-tokens")
    best = match_rules(by_class.select(F.array_sort("classes").alias("tokens")).distinct(), mined)
    found = by_class.withColumn("_key", F.array_sort("classes")).join(
        best.withColumnRenamed("tokens", "_key"), "_key").select(
        "tokens", F.col("verdict").alias("_mined"), "confidence", "rule_tokens")
    free, ruled = parsed.where(F.col("rule").isNull()), parsed.where(F.col("rule").isNotNull())
    judged = free.join(found, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_mined", F.lit(default)).alias("verdict"), "confidence",
        "rule_tokens")
    return ruled.select("page_id", "host", "path", "rule", F.col("_stated").alias("verdict"),
                        F.lit(None).cast("double").alias("confidence"),
                        F.lit(None).cast("array<string>").alias("rule_tokens")).unionByName(judged)
