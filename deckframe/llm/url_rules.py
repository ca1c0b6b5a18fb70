"""URL filters: rules by hand, then association rules mined from labels.

A URL's tokens are the labels of its host and the segments of its path, numbers as
one token. Tokens that stand in exactly the same labelled URLs are one class, so that
a deep path which many URLs share is one item and not a power set; a URL has a class
if it has any token of it, which is what rules of the single tokens would say.
FP-growth over the labelled URLs, each with an item more if its label is bad, finds
combinations that go with it. Rules with enough hits, and of a confidence above
both ``MIN_CONFIDENCE`` and the share of bad URLs, that no shorter rule makes
redundant are kept in an inverted index, each under its rarest class; a URL looks up
its classes and a rule fires if it has all the others too. The work is per distinct
(host, path), so a hot URL is judged once.

Defined results: a null URL or one without ``://`` has an empty host and path, fits
no rule and is allowed unless a mined rule says otherwise; null ids are judged like
others; repeated rows come back as often; a very long URL is read whole; labels that
are null are not learned from; without labels no rule is mined; an empty table gives
an empty result; columns other than page_id and url play no part.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.plans import sized, stored

#: Rules by hand: verdict, host and path; a rule fits the host, its subdomains and what the path begins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Share, and number, of the labelled URLs that a rule must catch.
MIN_SUPPORT = 0.005
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
BAD = "label=bad"


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a host and path, in order."""
    labels = F.transform(F.filter(F.split(host, "[.]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_sort(F.array_distinct(F.concat(labels, segments)))


def by_hand(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, h, p in rules:
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return best


def classes(examples: DataFrame) -> DataFrame:
    """Of examples (row, tokens): token, item; tokens of exactly the same rows have one item, the first of them."""
    each = examples.select("row", F.explode("tokens").alias("token"))
    low, high = F.xxhash64("row").cast("decimal(38,0)"), F.xxhash64(F.lit(1), "row").cast("decimal(38,0)")
    where = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(low).alias("a"), F.sum(high).alias("b"))
    firsts = where.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return stored(where.join(firsts, ["n", "a", "b"]).select("token", "item"), "token-classes")


def mine(examples: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Of examples (tokens, bad): the classes of tokens (token, item), and rules (items, key, confidence); key is the rarest item of the rule."""
    spark = examples.sparkSession
    rows = stored(examples.where((F.size("tokens") > 0) | F.col("bad")).withColumn("row", F.monotonically_increasing_id()), "examples")
    items = classes(rows)
    none = spark.createDataFrame([], "items array<string>, key string, confidence double")
    n, hits = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not hits:
        return items, none
    owned = rows.select("row", "bad", F.explode_outer("tokens").alias("token")).join(sized(items), "token", "left")
    bad = F.when(F.first("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = stored(owned.groupBy("row").agg(F.concat(F.collect_set("item"), bad).alias("items")).select("items"), "baskets")
    least = max(min_count, math.ceil(min_support * n))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq").where(F.col("freq") >= least), "item-sets")
    bad = F.array_contains("items", BAD)
    whole = sets.where(bad & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    rest = sets.where(~bad)
    rules = whole.join(rest, "items").withColumn("confidence", F.col("hits") / F.col("freq"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > hits / n)).select("items", "confidence")
    ones = rest.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    spread = rules.select("items", "confidence", F.explode("items").alias("item")).join(ones, "item")
    index = stored(spread.groupBy("items", "confidence").agg(F.min(F.struct("freq", "item"))["item"].alias("key")), "rules")
    short = index.select(F.col("key").alias("item"), F.col("items").alias("part"), F.col("confidence").alias("least"))
    within = (F.size("part") < F.size("items")) & (F.col("least") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0)
    redundant = index.withColumn("item", F.explode("items")).join(short, "item").where(within).select("items").distinct()
    return items, stored(index.join(redundant, "items", "left_anti").select("items", "key", "confidence"), "rule-index")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the mined rule that fires) for each row of ``pages``.

    ``labels`` (doc_id, quality, toxic) speak of the page of that id; bad is quality 0 or toxic 1.
    """
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).dropna().groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    items, index = mine(urls.join(marks, "page_id").select(tokens(F.col("host"), F.col("path")).alias("tokens"), "bad"), **limits)
    used = stored(items.join(index.select(F.explode("items").alias("item")).distinct(), "item").select("token", "item"), "used-tokens")
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token")).join(sized(used), "token")
    distinct = each.groupBy("host", "path").agg(F.collect_set("item").alias("own"))
    looked = distinct.withColumn("key", F.explode("own")).join(sized(index), "key").where(F.size(F.array_except("items", "own")) == 0)
    fired = stored(looked.groupBy("host", "path").agg(F.max("confidence").alias("confidence")), "fired")
    hand = by_hand(F.col("host"), F.col("path"), rules)
    out = urls.join(fired, ["host", "path"], "left").withColumn("hand", hand)
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("hand.rule").alias("rule"), F.coalesce("hand.verdict", mined).alias("verdict"), "confidence")
