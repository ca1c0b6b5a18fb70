"""Terminology, captions and text density over elements of decks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.plans import sized

#: Fixed value: the pattern of candidate terms, capitalised or camel-case words with an article or without.
TERM = r"\b(?:the\s+)?[A-Z][a-z]{2,}(?:[A-Z][a-z]*)*[A-Za-z]*\b"
MAX_EDIT, MIN_RATIO, MIN_SLIDES, MIN_LENGTH = 2, 0.8, 2, 4


def terms(text: Column, pattern: str = TERM) -> Column:
    """Distinct candidate terms of a text, with single spaces."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))))


def occurrences(slides: DataFrame, pattern: str = TERM) -> DataFrame:
    """Of slides (deck, slide, text): deck, term, slides (how many have it) and first_slide."""
    rows = slides.select("deck", "slide", F.explode(terms(F.col("text"), pattern)).alias("term"))
    return rows.groupBy("deck", "term").agg(F.countDistinct("slide").alias("slides"), F.min("slide").alias("first_slide"))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["ratio"] = [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(pdf["a"], pdf["b"], strict=True)]
        yield pdf


def variants(found: DataFrame, glossary: DataFrame | None = None, min_slides: int = MIN_SLIDES) -> DataFrame:
    """Of ``occurrences``: deck, canonical, variant and ratio of pairs that look like one term spelt twice.

    Pairs meet by deck and length; only those at most MAX_EDIT edits apart reach the
    Python ratio. The canonical term is that of the glossary if only one is in it, else
    the one on more slides, of which it needs ``min_slides``; equals are skipped.
    """
    stem = F.regexp_replace(F.lower("term"), "[^a-z]+$", "")
    t = found.where(F.length("term") >= MIN_LENGTH).withColumn("stem", stem).withColumn("len", F.length("stem"))
    near = t.withColumn("len_b", F.explode(F.sequence(F.col("len") - MAX_EDIT, F.col("len") + MAX_EDIT)))
    a, b = near.alias("a"), t.alias("b")
    meet = (F.col("a.deck") == F.col("b.deck")) & (F.col("a.len_b") == F.col("b.len")) & (F.col("a.term") < F.col("b.term"))
    edits = F.levenshtein(F.lower("a.term"), F.lower("b.term"), MAX_EDIT)
    pairs = a.join(b, meet & ((F.col("a.stem") == F.col("b.stem")) | (edits >= 0)))
    pairs = pairs.select("a.deck", F.col("a.term").alias("a"), F.col("b.term").alias("b"), F.col("a.slides").alias("sa"), F.col("b.slides").alias("sb"), (F.col("a.stem") == F.col("b.stem")).alias("same"))
    scored = pairs.mapInPandas(_similar, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pairs.schema)}, ratio double")
    scored = scored.where(F.col("same") | (F.col("ratio") >= MIN_RATIO))
    known = lambda c: F.lit(False)
    if glossary is not None:
        g = sized(glossary.select("term").distinct())
        scored = scored.join(g.withColumnRenamed("term", "a").withColumn("ga", F.lit(True)), "a", "left").join(g.withColumnRenamed("term", "b").withColumn("gb", F.lit(True)), "b", "left")
        known = lambda c: F.coalesce(F.col(f"g{c}"), F.lit(False))
    wide = F.when((F.col("sa") > F.col("sb")) & (F.col("sa") >= min_slides), "a").when((F.col("sb") > F.col("sa")) & (F.col("sb") >= min_slides), "b")
    side = F.when(known("a") & ~known("b"), "a").when(known("b") & ~known("a"), "b").otherwise(wide)
    out = scored.withColumn("side", side).where("side is not null")
    pick = lambda this, other: F.when(F.col("side") == "a", F.col(this)).otherwise(F.col(other))
    return out.select("deck", pick("a", "b").alias("canonical"), pick("b", "a").alias("variant"), "ratio")


def captions(elements: DataFrame) -> DataFrame:
    """One line for each slide: ``type id at (x,y,w,h): text`` of its elements, in order, joined by bars."""
    whole = lambda c: F.col(c).cast("long").cast("string")
    box = F.concat(F.lit("("), F.concat_ws(",", whole("x"), whole("y"), whole("w"), whole("h")), F.lit(")"))
    line = F.concat(F.col("etype"), F.lit(" e"), F.col("pos").cast("string"), F.lit(" at "), box, F.lit(": "), F.substring("text", 1, 120))
    rows = elements.groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("slide_id", F.array_join(F.transform("l", lambda x: x["line"]), " | ").alias("caption"))


def density(slides: DataFrame, max_words: int = 300) -> DataFrame:
    """Words of a text over a limit, by the level of excess: up to a fifth minor, up to a half moderate, else severe."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    over = (F.col("words") - max_words) / F.lit(float(max_words))
    level = F.when(over <= 0, "none").when(over <= 0.2, "minor").when(over <= 0.5, "moderate").otherwise("severe")
    return slides.withColumn("words", words).select("deck", "slide", "words", level.alias("level"))
