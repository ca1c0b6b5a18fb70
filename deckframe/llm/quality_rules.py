"""Quality rules: document statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over the
trusted documents, one over the whole corpus. A document's score is the mean over
its n-grams of ``log p_target - log p_raw``; documents below the threshold are
rejected, as are those that fail the plain statistics.

Everything is a DataFrame expression. Counting explodes n-grams into a map-side
combined count over at most ``2 * BUCKETS`` keys, so no key is hot after the
partial aggregate; scoring reads the weights, ``2 * BUCKETS`` numbers whatever the
corpus, as one constant of the plan and never moves a text.

Defined results: null or blank text has no words, fails the base rules and is not
kept; a very long text is one row of hashes and is judged whole; null, repeated or unlabelled ids only decide membership of the trusted set;
repeated rows are scored alike; without trusted documents every ratio is zero; an
empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.llm.words import has_word, lines, words
from deckframe.plans import fresh, sized, stored

#: Hash buckets for each n-gram order.
BUCKETS = 1 << 14
#: Additive smoothing of both multinomials.
ALPHA = 1.0
#: Documents with a lower mean log-likelihood ratio are rejected.
MIN_LLR = -0.15

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
MAX_LEN = 1 << 30


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pairs(h: Column) -> Column:
    """Hashes of neighbouring words, one fewer than the words.

    ``h`` is a column, not an expression: it stands in several places, and only
    then does the optimizer leave it in a projection of its own.
    """
    return F.slice(F.zip_with(h, F.slice(h, 2, MAX_LEN), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))


def _bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def gram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The log ratio of every bucket; ``trusted`` has ids of documents in its first column."""
    ids = stored(trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).dropna().distinct(), "trusted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = texts.join(sized(ids).withColumn("trusted", F.lit(1)), "id", "left")
    counts = (
        marked.select("trusted", _hashes(F.col("text")).alias("h"))
        .select("trusted", F.concat(F.transform("h", _bucket), F.transform(_pairs(F.col("h")), lambda x: _bucket(x) + BUCKETS)).alias("grams"))
        .select("trusted", F.explode_outer("grams").alias("bucket"))  # a plain explode would filter by its size first, and hash twice
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    )
    found = {r["bucket"]: (r["target"], r["raw"]) for r in counts.collect()}  # 2 * BUCKETS rows at most
    target_n, raw_n = (sum(c[i] for c in found.values()) for i in (0, 1))
    if not target_n:
        return [0.0] * (2 * BUCKETS)
    space = ALPHA * 2 * BUCKETS
    base = math.log(raw_n + space) - math.log(target_n + space)
    return [round(base + math.log(t + ALPHA) - math.log(r + ALPHA), 6) for t, r in (found.get(b, (0, 0)) for b in range(2 * BUCKETS))]


def _repeats(s: Column) -> Column:
    """Sorted starts of the windows in the column ``s`` (hash, start; sorted) that occur more than once."""
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))


def judged(docs: DataFrame, weights: list[float], min_llr: float = MIN_LLR, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and its name.

    The struct has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    llr, base_failed and kept.
    """
    w, h, pairs, g5, s, p, out = fresh(docs, "_words", "_hashes", "_pairs", "_windows", "_sorted", "_starts", "_quality")
    text, k, n = F.coalesce(F.col(text_col), F.lit("")), REPEAT_WINDOW, F.size(h)
    df = docs.withColumn(w, words(F.col(text_col)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(pairs, _pairs(F.col(h)))
    four = F.zip_with(pairs, F.slice(pairs, 3, MAX_LEN), lambda x, y: F.xxhash64(x, y))
    five = F.zip_with(four, F.slice(h, k, MAX_LEN), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn(g5, F.slice(five, F.lit(1), F.greatest(n - k + 1, F.lit(0))))
    repeated = F.size(F.array_distinct(g5)) < F.size(g5)
    df = df.withColumn(s, F.when(repeated, F.sort_array(F.transform(g5, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn(p, _repeats(F.col(s)))
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(k)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    real = F.filter(lines(F.col(text_col)), has_word)
    uni, bi = (F.from_json(F.lit(json.dumps(x)), "array<double>") for x in (weights[:BUCKETS], weights[BUCKETS:]))  # folded to constants
    total = F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(uni, _bucket(x))) + F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.get(bi, _bucket(x)))
    grams = F.size(h) + F.size(pairs)
    df = df.withColumn(
        out,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(real) - F.size(F.array_distinct(real))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.round(F.when(grams > 0, total / grams).otherwise(F.lit(0.0)), 6).alias("llr"),
        ),
    ).drop(w, h, pairs, g5, s, p)
    q = F.col(out)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    # never false; keeps a filter on the verdict from being pushed into the lambdas above, which would then hash a text for each word
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumn(out, q.withField("base_failed", failed).withField("kept", ~failed & (q["llr"] >= min_llr) & here))
    return df, out


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """Judge ``docs`` with the rows of ``labels`` of quality 1 as trusted documents."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id")
    return judged(docs, gram_weights(docs, trusted))
