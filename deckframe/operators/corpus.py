"""Decks as a corpus: what is rejected and why, deck quality, replayed answers, validity of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckframe.operators import layout
from deckframe.plans import sized, stored

#: Weights of the parts of a deck's quality, for proxies and for the stricter audit.
WEIGHTS = {"coverage": 0.40, "geometry": 0.20, "terms": 0.15, "conciseness": 0.25}
GOLD_WEIGHTS = {"coverage": 0.45, "geometry": 0.15, "terms": 0.15, "conciseness": 0.25}
MAX_BULLETS, TITLE_WORDS, EACH_TERM = 6, 12, 0.25
#: What evidence must not name, what makes a fact visible, and verbs of a fix.
FORBIDDEN = r"\b(expected_[a-z0-9_]*|defect_type|severity|repair_hint)\b"
VISIBLE = (
    r"\bpage\s+\d+\b|\bpage order\b|\bsequence\b|\belement\s+[\w.-]+\b|\btitle/body\b|\bdiagram/text\b|\bvisible\s+(text|color|slide|deck|sequence)\b"
    r"|\b(term|terms|terminology)\b|\b(conflict|contradict|overlap|margin|font|color|text|bounding box)\b|\b\d+(?:\.\d+)?\s*(px|pt|words?)\b|\biou\s+\d|'[^']+'|\"[^\"]+\""
)
ACTIONS = r"\b(add|adjust|align|change|correct|move|normalize|realign|reduce|remove|replace|resize|restore|revise|reorder|shorten|split|update)\b"


def reject_reasons(decks: DataFrame, slides: DataFrame, elements: DataFrame, min_slides: int = 2, max_findings: int = 0) -> DataFrame:
    """deck_id and the first of empty_deck, too_few_slides, empty_slide, linter_defect that holds, or null.

    A slide is empty without an element that has more text than spaces, or area. All detectors lint.
    """
    useful = elements.where(F.col("text").rlike(r"\S") | (F.col("w") * F.col("h") > 0)).groupBy("slide_id").agg(F.count("*").alias("n_elements"))
    found = layout.lint(elements).groupBy("slide_id").agg(F.count("*").alias("n_findings"))
    df = slides.join(useful, "slide_id", "left").join(found, "slide_id", "left")
    own = df.groupBy("deck_id").agg(F.count("*").alias("slides"), F.count_if(F.col("n_elements").isNull()).alias("empty"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"))
    all_ = decks.select("deck_id").join(own, "deck_id", "left").withColumn("slides", F.coalesce("slides", F.lit(0)))
    reason = F.when(F.col("slides") == 0, "empty_deck").when(F.col("slides") < min_slides, "too_few_slides").when(F.col("empty") > 0, "empty_slide").when(F.col("findings") > max_findings, "linter_defect")
    return all_.select("deck_id", "slides", reason.alias("reason"))


def corpus_summary(reasons: DataFrame) -> DataFrame:
    """Decks by reason, accepted ones as "accepted"."""
    return reasons.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("decks"), F.sum("slides").alias("slides"))


def quality_parts(decks: DataFrame, slides: DataFrame, elements: DataFrame, required: DataFrame, term_findings: DataFrame | None = None) -> DataFrame:
    """By deck (deck_id, target_slides): coverage, count, geometry, terms and conciseness, each from 0 to 1, and degenerate.

    ``required`` has (deck_id, section); a section is covered if a slide has it as its
    own or in a title. A slide is concise with few texts and a short first title. The
    count is how near the number of slides is to the target, 1 without one. A deck
    without slides is degenerate and has 0 throughout.
    """
    titles = elements.where("etype = 'title'").groupBy("slide_id").agg(F.min_by("text", "pos").alias("title"))
    bodies = elements.where("etype = 'text'").groupBy("slide_id").agg(F.count("*").alias("bullets"))
    scores = layout.lint_scores(elements).select("slide_id", F.col("score").alias("geometry"))
    words = F.size(F.filter(F.split(F.coalesce("title", F.lit("")), r"\s+"), lambda w: w != ""))
    df = slides.join(titles, "slide_id", "left").join(bodies, "slide_id", "left").join(scores, "slide_id", "left")
    concise = (F.coalesce("bullets", F.lit(0)) <= MAX_BULLETS) & (words <= TITLE_WORDS)
    parts = df.groupBy("deck_id").agg(F.count("*").alias("n_slides"), F.avg(F.coalesce("geometry", F.lit(1.0))).alias("geometry"), F.avg(concise.cast("double")).alias("conciseness"))
    texts = df.select("deck_id", F.explode(F.array_compact(F.array(F.lower("section"), F.lower("title")))).alias("hay"))
    need = required.select("deck_id", F.lower(F.trim("section")).alias("need")).where("need <> ''").distinct()
    hit = need.join(texts, "deck_id", "left").groupBy("deck_id", "need").agg(F.coalesce(F.bool_or(F.col("hay").contains(F.col("need")) | F.col("hay").contains(F.replace("need", F.lit("_"), F.lit(" ")))), F.lit(False)).alias("hit"))
    covered = hit.groupBy("deck_id").agg(F.avg(F.col("hit").cast("double")).alias("coverage"))
    out = decks.join(parts, "deck_id", "left").join(covered, "deck_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))
    n, target = F.col("n_slides"), F.col("target_slides")
    out = out.withColumn("count", F.when(F.coalesce(target, F.lit(0)) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - target) / F.greatest(F.lit(1), target))))
    if term_findings is None:
        out = out.withColumn("terms", F.lit(1.0))
    else:
        found = term_findings.groupBy("deck_id").agg(F.count("*").alias("found"))
        out = out.join(found, "deck_id", "left").withColumn("terms", F.greatest(F.lit(0.0), 1 - EACH_TERM * F.coalesce("found", F.lit(0)))).drop("found")
    none = F.col("n_slides").isNull()
    rounded = {c: F.when(none, 0.0).otherwise(F.round(c, 6)) for c in ("coverage", "count", "geometry", "terms", "conciseness")}
    return out.withColumns({**rounded, "degenerate": none}).select("deck_id", "degenerate", *rounded)


def deck_quality(parts: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return parts.withColumn("quality", F.round(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 6))


def replay(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with the last answer of its key, ``answered`` false where there is none."""
    last = answers.groupBy(*keys).agg(F.max_by("output", "ord").alias("output"), F.lit(True).alias("answered"))
    return requests.join(last, keys, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def probe_grid(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """Every sample under every cell of a plan that names its modality and task; the plan is broadcast if it is small."""
    return samples.crossJoin(sized(stored(cells, "plan")))


def evidence_ok(text: Column, kind: Column, place: Column) -> Column:
    """Does evidence name no bookkeeping, say more than its type, and cite a place or a visible fact?"""
    lower = F.lower(F.trim(text))
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    says_more = F.size(F.array_except(tokens(text), tokens(kind))) > 0
    visible = lower.rlike(VISIBLE) | F.coalesce((F.length(place) > 0) & lower.contains(F.lower(place)), F.lit(False))
    return F.coalesce((F.length(lower) > 0) & ~lower.rlike(FORBIDDEN) & says_more & visible, F.lit(False))


def fix_ok(text: Column) -> Column:
    """Does a suggestion hold a verb of action?"""
    return F.coalesce(F.lower(text).rlike(ACTIONS), F.lit(False))


def sample_size(base: float, target: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Samples in each group that tell two proportions apart."""
    from math import ceil, sqrt
    from statistics import NormalDist

    if base == target:
        raise ValueError("the rates must differ")
    mean = (base + target) / 2
    spread = NormalDist().inv_cdf(1 - alpha / 2) * sqrt(2 * mean * (1 - mean)) + NormalDist().inv_cdf(power) * sqrt(base * (1 - base) + target * (1 - target))
    return ceil((spread / abs(target - base)) ** 2)


def hybrid_score(linter: Column, examiner: Column, linter_weight: float = 0.5) -> Column:
    """Weighted mean of two scores, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), linter * linter_weight + examiner * (1 - linter_weight)))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Of (item, issues array): items that are fine or failed, and issues by what stands before the colon."""
    kinds = issues.select(F.explode_outer("issues").alias("i")).where("i is not null").groupBy(F.substring_index("i", ":", 1).alias("kind")).agg(F.count("*").alias("n"))
    ok = issues.groupBy(F.when(F.size("issues") > 0, "failed").otherwise("ok").alias("kind")).agg(F.count("*").alias("n"))
    return ok.unionByName(kinds)


def proxy_against_gold(parts: DataFrame, slides: DataFrame, flags: DataFrame) -> DataFrame:
    """By group of decks (grp): mean proxy and gold quality, their gap, whether the proxy is ahead, and cheats."""
    both = deck_quality(deck_quality(parts).withColumnRenamed("quality", "proxy"), GOLD_WEIGHTS).withColumnRenamed("quality", "gold")
    cheats = flags.join(slides.select("slide_id", "deck_id"), "slide_id").groupBy("deck_id").agg(F.count("*").alias("cheats"))
    df = both.join(cheats, "deck_id", "left").groupBy("grp").agg(F.avg("proxy").alias("proxy"), F.avg("gold").alias("gold"), F.coalesce(F.sum("cheats"), F.lit(0)).alias("cheats"))
    return df.withColumn("gap", F.col("proxy") - F.col("gold")).withColumn("over_optimised", F.col("gap") > 0.0)


def next_in_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with the last earlier value of its key: an as-of look-back."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(value, ignorenulls=True).over(w))
