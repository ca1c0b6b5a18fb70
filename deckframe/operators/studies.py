"""Study tables: scores by level, forced choice, rescues, channels, coverage by engine, fidelity, trajectories and feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckframe.functions.stats import balanced_accuracy, exact_mcnemar, pearson, ratio, two_sided_p, wilson
from deckframe.operators.exams import DECK_TYPES
from deckframe.plans import sized, stored

SEMANTIC = ("S1", "S2", "S4", "S5")


def _scored(df: DataFrame) -> DataFrame:
    """Counts tp, n_pos, fp, n_neg with recall, specificity, bal_acc, precision, f1 and fpr, rounded."""
    c = F.col
    recall, spec = ratio(c("tp"), c("n_pos")), ratio(c("n_neg") - c("fp"), c("n_neg"))
    precision = ratio(c("tp"), c("tp") + c("fp"))
    parts = {"recall": recall, "specificity": spec, "bal_acc": (recall + spec) / 2, "precision": precision, "f1": ratio(2 * precision * recall, precision + recall), "fpr": 1 - spec}
    return df.withColumns({k: F.round(v, 6) for k, v in parts.items()})


def level_scores(rows: DataFrame, keys: tuple[str, ...] = ("model", "modality")) -> DataFrame:
    """By ``keys`` and type: positives that name the type against clean rows of the type's level (page or deck), where both exist.

    Rows have level, expected_types and predicted_types; clean rows expect nothing.
    """
    clean = F.size("expected_types") == 0
    level = F.when(F.col("type").isin(*DECK_TYPES), "deck").otherwise("page")
    pos = rows.where(~clean).select(*keys, "predicted_types", F.explode(F.array_distinct("expected_types")).alias("type"))
    pos = pos.groupBy(*keys, "type").agg(F.count("*").alias("n_pos"), F.count_if(F.array_contains("predicted_types", F.col("type"))).alias("tp")).withColumn("level", level)
    neg = rows.where(clean).groupBy(*keys, "level").agg(F.count("*").alias("n_neg"))
    wrong = rows.where(clean).select(*keys, "level", F.explode(F.array_distinct("predicted_types")).alias("type")).groupBy(*keys, "level", "type").agg(F.count("*").alias("fp"))
    df = pos.join(neg, [*keys, "level"]).join(wrong, [*keys, "level", "type"], "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    return _scored(df)


def group_means(scores: DataFrame, keys: tuple[str, ...] = ("model", "modality")) -> DataFrame:
    """Mean balanced accuracy of the semantic and of the geometry types, null where there is none."""
    of = lambda ok: F.round(F.avg(F.when(ok, F.col("bal_acc"))), 6)
    return scores.groupBy(*keys).agg(of(F.col("type").isin(*SEMANTIC)).alias("semantic"), of(F.col("type").startswith("G")).alias("geometry"))


def best_of(means: DataFrame, group: str = "semantic") -> DataFrame:
    """The best mean of a model over its modalities."""
    return means.groupBy("model").agg(F.max(group).alias("best"))


def false_alarms(facts: DataFrame) -> DataFrame:
    """By model and modality: clean rows, those with a type named, and how the judge leans: abstains, over-fires or mild over-call."""
    df = facts.where(F.size("expected_types") == 0).groupBy("model", "modality").agg(F.count("*").alias("n_neg"), F.count_if(F.size("predicted_types") > 0).alias("any_fp"))
    lean = F.when(F.col("any_fp") <= 5, "abstains").when(F.col("any_fp") >= 0.4 * F.col("n_neg"), "over-fires").otherwise("mild over-call")
    return df.withColumn("bias", lean)


def fusion_gains(facts: DataFrame) -> DataFrame:
    """Recall of a type by modality, what structure and captions add, and what both add to the best single channel; no rows count as 0."""
    hit = F.array_contains("predicted_types", F.col("type"))
    rows = facts.where("task = 'T1'").select("modality", "predicted_types", F.explode(F.array_distinct("expected_types")).alias("type"))
    share = lambda m: F.coalesce(F.avg(F.when(F.col("modality") == m, hit.cast("double"))), F.lit(0.0))
    df = rows.groupBy("type").agg(*[share(m).alias(f"r_{m}") for m in ("A", "B", "C", "B_prime")])
    c = F.col
    return df.select("type", *[F.round(f"r_{m}", 6).alias(f"r_{m}") for m in ("A", "B", "C", "B_prime")], F.round(c("r_B") - c("r_A"), 6).alias("structure_gap"), F.round(c("r_B") - c("r_B_prime"), 6).alias("caption_gap"), F.round(c("r_C") - F.greatest("r_A", "r_B", "r_B_prime"), 6).alias("fusion_gain"))


def late_value(values: Column, share: float) -> Column:
    """The value at ``share`` of a sorted array by its index, cut down: no interpolation."""
    return F.get(F.array_sort(values), F.floor(share * (F.size(values) - 1)).cast("int"))


def forced_choice(trials: DataFrame, keys: tuple[str, ...] = ("model", "defect")) -> DataFrame:
    """Of trials (pair, turn, pick, expect): parsed ones, accuracy, pairs that are right both ways round, and whether one answer takes over 60 %."""
    each = trials.groupBy(*keys, "pair").agg(
        F.count("*").alias("t"), F.count("pick").alias("p"), F.count_if(F.col("pick") == F.col("expect")).alias("r"), *[F.count_if(F.col("pick") == v).alias(f"pick_{v}") for v in ("a", "b", "tie")]
    )
    both = F.count_if((F.col("t") == 2) & (F.col("r") == 2))
    df = each.groupBy(*keys).agg(F.sum("t").alias("trials"), F.sum("p").alias("parsed"), F.sum("r").alias("right"), F.count("*").alias("pairs"), both.alias("robust"), *[F.sum(f"pick_{v}").alias(f"pick_{v}") for v in ("a", "b", "tie")])
    most = F.greatest("pick_a", "pick_b", "pick_tie", F.col("trials") - F.col("parsed"))
    return df.withColumns({"accuracy": F.round(ratio(F.col("right"), F.col("parsed")), 6), "robust_accuracy": F.round(ratio(F.col("robust"), F.col("pairs")), 6), "one_sided": most > 0.6 * F.col("trials")})


def discordant(rows: DataFrame, base: str, others: tuple[str, ...]) -> DataFrame:
    """By model, type and condition: images that only the condition gets right (gain), only the base (loss), and the exact p."""
    right = F.bool_and(F.col("has_defect") != F.col("is_clean"))
    one = rows.where(~F.col("failure")).groupBy("model", "defect", "cond", "sample_id").agg(right.alias("ok"))
    x = one.where(F.col("cond") == base).select("model", "defect", "sample_id", F.col("ok").alias("x"))
    y = one.where(F.col("cond").isin(*others)).withColumnRenamed("ok", "y")
    df = y.join(x, ["model", "defect", "sample_id"]).groupBy("model", "defect", "cond").agg(F.count_if(~F.col("x") & F.col("y")).alias("gain"), F.count_if(F.col("x") & ~F.col("y")).alias("loss"))
    return df.withColumn("p", F.round(exact_mcnemar(F.col("gain"), F.col("loss")), 6))


def rescued(cells: DataFrame, pairs: DataFrame, base: str = "C0", precision: float = 0.7, lift: float = 0.1) -> DataFrame:
    """Does a condition rescue a type: more balanced accuracy, precise, and more images gained than lost at p below 0.05; or improve it by ``lift``?"""
    b = cells.where(F.col("cond") == base).select("model", "defect", F.col("bal_acc").alias("base_bal"))
    x = cells.where(F.col("cond") != base).select("model", "defect", "cond", "bal_acc", "precision")
    df = x.join(b, ["model", "defect"]).join(pairs, ["model", "defect", "cond"], "left")
    df = df.withColumn("delta", F.round(F.col("bal_acc") - F.col("base_bal"), 6)).withColumns({"gain": F.coalesce("gain", F.lit(0)), "loss": F.coalesce("loss", F.lit(0)), "p": F.coalesce("p", F.lit(1.0))})
    exact = F.col("precision") >= precision
    saved = (F.col("delta") > 0) & (F.col("p") < 0.05) & exact & (F.col("gain") > F.col("loss"))
    return df.select("model", "defect", "cond", "delta", "precision", "gain", "loss", "p", saved.alias("rescued"), (~saved & (F.col("delta") >= lift) & exact).alias("improved"))


#: Words that name what spills, by the kind of a containment defect.
KINDS = {"card_height": ("bullet", "list", "item", "card", "below", "bottom"), "unbreakable_text": ("text", "url", "endpoint", "string", "right", "edge", "link", "address"), "image_objectfit": ("image", "figure", "picture", "frame", "bleed", "overflow", "graphic")}


def localization(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Of true positives (region, element as said) against truth (sample_id, region, kind): shares that name the region and the element."""
    hits = rows.where("has_defect and not is_clean and not failure").select("model", "cond", "sample_id", F.lower(F.coalesce("said_region", F.lit(""))).alias("r"), F.lower(F.coalesce("said_element", F.lit(""))).alias("e"))
    df = hits.join(truth, "sample_id")
    words = F.filter(F.split(F.coalesce("region", F.lit("")), "-"), lambda w: w != "")
    region = F.exists(words, lambda w: F.col("r").contains(w))
    element = F.coalesce(*[F.when(F.col("kind") == k, reduce(lambda a, b: a | b, (F.col("e").contains(w) for w in ws))) for k, ws in KINDS.items()], F.lit(False))
    return df.groupBy("model", "cond").agg(F.count("*").alias("n"), F.round(F.avg(region.cast("double")), 6).alias("region_share"), F.round(F.avg(element.cast("double")), 6).alias("element_share"))


def channels(scores: DataFrame, bar: float = 0.6, keys: tuple[str, ...] = ("model", "type")) -> DataFrame:
    """Where image, structure and both have a balanced accuracy: perception if only structure reaches the bar, capability if nothing does, else image_sufficient."""
    pick = lambda m: F.max(F.when(F.col("modality") == m, F.col("bal_acc")))
    df = scores.groupBy(*keys).agg(*[pick(m).alias(m.lower()) for m in ("A", "B", "C")]).where("a is not null and b is not null and c is not null")
    verdict = F.when((F.col("a") < bar) & (F.greatest("b", "c") >= bar), "perception").when((F.col("a") < bar) & (F.col("c") < bar), "capability").otherwise("image_sufficient")
    return df.select(*keys, "a", "b", "c", F.round(F.col("c") - F.col("a"), 6).alias("c_minus_a"), F.round(F.col("b") - F.col("a"), 6).alias("b_minus_a"), verdict.alias("verdict"))


def mean_channels(scores: DataFrame, bar: float = 0.6) -> DataFrame:
    """The same on means over the models."""
    return channels(scores.groupBy("type", "modality").agg(F.avg("bal_acc").alias("bal_acc")), bar, ("type",))


def above_chance(kind: Column, est: Column, low: Column, decisive: Column) -> Column:
    """True above chance, null without an estimate: a forced choice must be decisive and right, another cell's interval must lie above a half."""
    choice = (F.coalesce(decisive, F.lit(0.0)) >= 0.5) & (est >= 0.65)
    return F.when(est.isNull(), F.lit(None)).when(kind == "AFC", choice).when(low.isNotNull(), low > 0.5).otherwise(est >= 0.65)


def near_chance(kind: Column, est: Column, low: Column, high: Column, decisive: Column) -> Column:
    return F.when(est.isNull(), F.lit(None)).when(kind == "AFC", F.coalesce(decisive, F.lit(0.0)) < 0.5).when(low.isNotNull(), (low <= 0.5) & (high >= 0.5)).otherwise(F.abs(est - 0.5) < 0.12)


def contrast(cells: DataFrame) -> DataFrame:
    """Of cells (defect, variant real or original, cond, kind, est, low, high, decisive): does the realistic variant show what the original's chance hid?"""
    c = F.col
    df = cells.withColumn("above", above_chance(c("kind"), c("est"), c("low"), c("decisive"))).withColumn("near", near_chance(c("kind"), c("est"), c("low"), c("high"), c("decisive")))
    at = lambda v, k, f: F.max(F.when((c("variant") == v) & (c("cond") == k), c(f).cast("int")))
    wide = df.groupBy("defect").agg(*[at(v, k, f).alias(f"{v}_{k}_{f}") for v in ("real", "original") for k in ("C0", "C3", "AFC") for f in ("above", "near")])
    no = lambda x: F.coalesce(c(x), F.lit(0)) > 0
    real_above = no("real_C3_above") | no("real_AFC_above")
    real_near = ~real_above & no("real_C3_near")
    original_chance = reduce(lambda a, b: a & b, (F.coalesce(c(f"original_{k}_near"), F.lit(1)) > 0 for k in ("C0", "C3", "AFC")))
    verdict = F.when(real_above & original_chance, "artifact").when(real_near & no("original_C3_near"), "survives").when(real_above & no("original_C3_above"), "detectable").otherwise("mixed")
    return wide.select("defect", real_above.alias("real_above"), original_chance.alias("original_at_chance"), verdict.alias("verdict"))


def answer_rates(items: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("cls", "stratum")) -> DataFrame:
    """Of items (pair_id, keys) and answers (pair_id, said): answered ones and the share of yes with its interval, by class and stratum, class, and over all."""
    df = items.join(answers, "pair_id", "left").where("said is not null")
    df = df.rollup(*keys).agg(F.count("*").alias("n"), F.count_if("said").alias("k"))
    w = df.withColumn("w", wilson(F.col("k"), F.col("n")))
    return w.select(*keys, "n", "k", F.round("w.estimate", 9).alias("rate"), F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


def three_valued(rows: DataFrame, types: tuple[str, ...], least: int = 5) -> DataFrame:
    """Of rows (labels, confident_absent, predicted): a type is there, surely not, or unknown; unknown rows do not count, and each side needs ``least``."""
    each = rows.withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))
    there, gone = F.array_contains("labels", F.col("type")), F.array_contains("confident_absent", F.col("type"))
    hit = F.array_contains("predicted", F.col("type"))
    df = each.groupBy("type").agg(F.count_if(there).alias("n_pos"), F.count_if(there & hit).alias("tp"), F.count_if(~there & gone).alias("n_neg"), F.count_if(~there & gone & hit).alias("fp"))
    return _scored(df).withColumn("enough", (F.col("n_pos") >= least) & (F.col("n_neg") >= least))


def linter_cells(rows: DataFrame) -> DataFrame:
    """Of rows (type, stratum, hit, clean_hit): cells by type and by type and stratum, and how often clean twins fire."""
    sets = rows.groupingSets([[F.col("type")], [F.col("type"), F.col("stratum")]], "type", "stratum")
    df = sets.agg(F.count("*").alias("n_pos"), F.count_if("hit").alias("tp"), F.count("clean_hit").alias("n_neg"), F.count_if("clean_hit").alias("fp"))
    return _scored(df)


def absorption(rows: DataFrame) -> DataFrame:
    """Of rows (type, template, hit): one less the share of template recall in free recall; null without free hits."""
    share = lambda t: F.avg(F.when(F.col("template") == t, F.col("hit").cast("double")))
    df = rows.groupBy("type").agg(share("freeform").alias("free"), share("template").alias("held"))
    return df.select("type", F.round("free", 6).alias("free"), F.round("held", 6).alias("held"), F.round(1 - F.try_divide("held", "free"), 6).alias("absorbed"))


def later_wins(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all shards; of rows with one key that of the later shard."""
    parts = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in df.columns if c not in (*keys, "_shard")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_shard").alias("_r")).select(*keys, "_r.*")


def routed_coverage(cells: DataFrame, router: dict[str, str], bar: float = 0.7) -> DataFrame:
    """Of cells (type, engine, bal_acc, precision): five ways to choose an engine for a type, and what each covers.

    The hybrid takes the engine of the router, the image judge where that has no cell.
    """
    types = cells.groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("engine", F.struct("bal_acc", "precision")))).alias("c"))
    route = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in router.items()], F.lit("vlm_c0"))
    plus = F.when(route == "linter", "linter").otherwise("vlm_c3")
    cell = lambda e: F.try_element_at("c", e)
    chosen = {"linter_only": cell(F.lit("linter")), "vlm_only": cell(F.lit("vlm_c0")), "vlm_c3": cell(F.lit("vlm_c3")), "linter_plus_vlm_c3": cell(plus), "hybrid": F.coalesce(cell(route), F.when(route.startswith("vlm"), cell(F.lit("vlm_c0"))))}
    rows = types.select("type", F.explode(F.array(*[F.struct(F.lit(k).alias("config"), v.alias("cell")) for k, v in chosen.items()])).alias("x")).select("type", "x.*")
    ok = (F.col("cell.bal_acc") >= bar) & (F.col("cell.precision") >= bar)
    return rows.groupBy("config").agg(F.count("cell").alias("types"), F.round(F.avg("cell.bal_acc"), 6).alias("mean_bal_acc"), F.count_if(ok).alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col("type")))), ",").alias("covered_types"))


def stratum_means(rows: DataFrame, strata: DataFrame, metric: str = "has_defect") -> DataFrame:
    """Of rows and a table (base, type, stratum): rows take the stratum of their base sample, none without one; the mean over models of each model's recall."""
    kept = rows.where("not failure and not is_clean").select("model", "defect", F.col("sample_id").alias("base"), F.col(metric))
    df = kept.join(strata, "base", "left")
    each = df.groupBy("model", "defect", F.coalesce("stratum", F.lit("none")).alias("stratum")).agg(F.avg(F.col(metric).cast("double")).alias("recall"), F.count("*").alias("n"))
    return each.groupBy("defect", "stratum").agg(F.count("*").alias("models"), F.sum("n").alias("n"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def fidelity(rows: DataFrame, least: float) -> DataFrame:
    """Of rows (type, injected, free, held): shares injected and rendered, what the template absorbs, and the size of the changes: median, mean, late and upper middle value.

    A change is rendered if it is more than ``least``; rows without a held value have no template twin.
    """
    free, held = F.col("free"), F.col("held")
    seen = lambda c: F.coalesce(c > least, F.lit(False))
    absorbed = seen(free) & held.isNotNull() & ~seen(held)
    df = rows.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if("injected").alias("injected"), F.count("free").alias("n_free"), F.count_if(seen(free)).alias("rendered"), F.count_if(held.isNotNull() & free.isNotNull()).alias("pairs"), F.count_if(absorbed).alias("absorbed"),
        F.round(F.median("free"), 6).alias("median"), F.round(F.avg("free"), 6).alias("mean"), F.array_sort(F.collect_list("free")).alias("v"),
    )
    c = F.col
    upper = F.get("v", F.floor(F.size("v") / 2).cast("int"))
    return df.select("type", "n", F.round(ratio(c("injected"), c("n")), 6).alias("injected_rate"), F.round(ratio(c("rendered"), c("n_free")), 6).alias("rendered_rate"), "pairs", F.round(ratio(c("absorbed"), c("pairs")), 6).alias("absorbed_rate"), F.round(ratio(c("absorbed"), c("rendered")), 6).alias("absorbed_of_rendered"), "median", "mean", F.round(late_value(c("v"), 0.9), 6).alias("late"), F.round(upper, 6).alias("upper_median"))


def judged_pairs(rows: DataFrame) -> DataFrame:
    """Of rows (defect, clean, defective): scores that both exist, how often the clean side scores higher, ties, gaps, means, and failures."""
    both = rows.where("clean is not null and defective is not null").withColumn("gap", F.round(F.col("clean") - F.col("defective"), 6))
    n = rows.groupBy("defect").agg(F.count("*").alias("all"))
    df = both.groupBy("defect").agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 0).alias("wins"), F.count_if(F.col("gap") == 0).alias("ties"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.array_sort(F.collect_list("gap")).alias("g"), F.round(F.avg("clean"), 6).alias("mean_clean"), F.round(F.avg("defective"), 6).alias("mean_defective"))
    df = df.join(n, "defect").withColumn("w", wilson(F.col("wins"), F.col("n")))
    return df.select("defect", "n", "wins", "ties", F.round("w.estimate", 6).alias("preference"), F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"), "mean_gap", F.get("g", F.floor(F.col("n") / 2).cast("int")).alias("upper_median"), "mean_clean", "mean_defective", (F.col("all") - F.col("n")).alias("failures"))


def one_proportion_z(df: DataFrame, k: str, n: str, p0: float = 0.5) -> DataFrame:
    """z of a share against ``p0`` and its two-sided p; 0 and 1 without rows."""
    share = F.try_divide(F.col(k).cast("double"), F.col(n))
    z = F.coalesce(F.try_divide(share - p0, F.sqrt(F.lit(p0 * (1 - p0)) / F.nullif(F.col(n), F.lit(0)))), F.lit(0.0))
    return df.withColumn("z", z).withColumn("p", two_sided_p("z"))


def carriers(runs: DataFrame) -> DataFrame:
    """Of runs (carrier, cond, ok, reached): runs, those that reached, mean and spread of these, and the mean with the others at the budget, the largest number seen."""
    done = runs.where("ok")
    budget = runs.agg(F.coalesce(F.nullif(F.max("reached"), F.lit(0)), F.lit(1)).alias("budget"))
    df = done.crossJoin(F.broadcast(budget)).withColumn("held", F.coalesce("reached", "budget").cast("double"))
    return df.groupBy("carrier", "cond").agg(F.count("*").alias("runs"), F.count("reached").alias("n_reached"), F.round(F.avg("reached"), 6).alias("mean_reached"), F.round(F.coalesce(F.stddev_pop("reached"), F.lit(0.0)), 6).alias("sd"), F.round(F.avg("held"), 6).alias("mean_censored"))


def transfer(cells: DataFrame, quality: DataFrame, hybrid: str) -> DataFrame:
    """Does better feedback need fewer rollouts, whatever the carrier, and is the hybrid no worse than any other? Of cells (carrier, cond, mean_censored) and quality (cond, q)."""
    df = cells.join(F.broadcast(quality), "cond")
    pooled = df.groupBy("cond", "q").agg(F.avg("mean_censored").alias("r"))
    all_ = pooled.agg(F.round(pearson("q", "r"), 3).alias("corr"), F.max(F.when(F.col("cond") == hybrid, F.col("r"))).alias("h"), F.min(F.when(F.col("cond") != hybrid, F.col("r"))).alias("s"))
    each = df.groupBy("carrier").agg(F.count("*").alias("n"), F.round(pearson("q", "mean_censored"), 3).alias("c")).where("n >= 2")
    agnostic = each.agg(((F.count("*") >= 2) & (F.max("c") <= 0)).alias("agnostic"))
    out = all_.crossJoin(F.broadcast(agnostic))  # one row each
    better = F.col("h") <= F.col("s") + 1e-9
    return out.select("corr", (F.col("corr") < 0).alias("monotonic"), "agnostic", better.alias("hybrid_no_worse"), F.when((F.col("corr") < 0) & F.coalesce(better, F.lit(True)), "supported").otherwise("counterexample").alias("verdict"))


def regime_stats(conditions: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Of conditions (regime, cond, q, initial, gain, best_gain): headroom, correlations, spread and the best condition, of equal ones that which stands later."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("cond"))
    df = conditions.where(F.col("cond").isin(*order) & F.col("q").isNotNull()).withColumn("place", place)
    return df.groupBy("regime").agg(
        F.count("*").alias("conditions"), F.round(F.avg("initial"), 6).alias("mean_initial"), F.round(1 - F.avg("initial"), 6).alias("headroom"), F.round(pearson("q", "gain"), 6).alias("corr_gain"), F.round(pearson("q", "best_gain"), 6).alias("corr_best_gain"),
        F.round(F.max("best_gain") - F.min("best_gain"), 6).alias("spread"), F.round(F.max("best_gain"), 6).alias("max_best_gain"), F.max_by("cond", F.struct("q", "place")).alias("best"), F.round(F.max_by("best_gain", F.struct("q", "place")), 6).alias("best_cond_gain"),
    )


def compare_regimes(stats: DataFrame, strong: str, weak: str, material: float = 0.03) -> DataFrame:
    """The weak regime against the strong one: ratios of headroom and of spread, null over 0, and whether the gain is material."""
    side = lambda r, c: F.max(F.when(F.col("regime") == r, F.col(c)))
    df = stats.agg(*[side(r, c).alias(f"{n}_{c}") for n, r in (("s", strong), ("w", weak)) for c in ("headroom", "spread", "max_best_gain", "best_cond_gain")])
    c = F.col
    good = (c("w_best_cond_gain") >= material) | (c("w_max_best_gain") >= material)
    return df.select(F.round(F.try_divide("w_headroom", F.nullif(c("s_headroom"), F.lit(0.0))), 3).alias("headroom_ratio"), F.round(F.try_divide("w_spread", F.nullif(c("s_spread"), F.lit(0.0))), 3).alias("spread_ratio"), F.when(good, "bounded_positive").otherwise("stronger_negative").alias("verdict"))


def structural_judge(slides: DataFrame, elements: DataFrame, role: str = "text") -> DataFrame:
    """By deck: 1 less 0.2 for each slide without text, 0.1 for each with more than six bodies, 0.1 for each with a long one; within 0 and 1."""
    body = F.col("etype") == role
    each = elements.groupBy("slide_id").agg(F.count_if(F.col("text").rlike(r"\S")).alias("texts"), F.count_if(body).alias("bodies"), F.count_if(body & (F.length("text") > 120)).alias("long"))
    df = slides.join(each, "slide_id", "left")
    off = F.when(F.coalesce("texts", F.lit(0)) == 0, 0.2).otherwise(0.0) + F.when(F.col("bodies") > 6, 0.1).otherwise(0.0) + F.when(F.col("long") > 0, 0.1).otherwise(0.0)
    return df.groupBy("deck_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.sum(off)), 6).alias("score"))


def placeholders(slides: DataFrame, elements: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """By deck: elements that still hold a marker (ASCII ones whatever the case), slides that have one, and slides."""
    has = reduce(lambda a, b: a | b, ((F.lower("text") if m.isascii() else F.col("text")).contains(m) for m in markers))
    each = elements.where(has).groupBy("slide_id").agg(F.count("*").alias("m"))
    df = slides.join(each, "slide_id", "left")
    return df.groupBy("deck_id").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("placeholders"), F.count("m").alias("slides_with"), F.count("*").alias("slides"))


def linter_feedback(slides: DataFrame, scores: DataFrame, findings: DataFrame, terms: DataFrame | None = None, most: int = 20) -> DataFrame:
    """By deck: the mean slide score less a tenth for each term finding, half at most; and the first ``most`` findings as lines."""
    listed = findings.join(slides.select("slide_id", "deck_id", "slide_index"), "slide_id").groupBy("deck_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("slide_index", "detector", "pos", F.round("severity", 1).alias("s")))).alias("f"))
    line = lambda f: F.concat(F.lit("- "), f["detector"], F.lit(" @ "), F.coalesce(f["pos"].cast("string"), F.lit("?")), F.lit(" "), f["s"].cast("string"))
    base = slides.join(scores, "slide_id", "left").groupBy("deck_id").agg(F.avg(F.coalesce("score", F.lit(1.0))).alias("mean"))
    df = base.join(listed, "deck_id", "left")
    lost = F.lit(0.0)
    if terms is not None:
        df = df.join(terms.groupBy("deck_id").agg(F.count("*").alias("t")), "deck_id", "left")
        lost = F.least(F.lit(0.5), 0.1 * F.coalesce("t", F.lit(0)))
    text = F.when(F.col("n").isNull(), "Linter: no verifiable geometry or terminology violations.").otherwise(F.concat(F.lit("Linter verifiable violations:\n"), F.array_join(F.transform(F.slice("f", 1, most), line), "\n")))
    return df.select("deck_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") - lost)), 6).alias("score"), F.coalesce("n", F.lit(0)).alias("findings"), text.alias("reflection"))


def examiner_feedback(answers: DataFrame, most: int = 12) -> DataFrame:
    """Of answers (deck_id, slide, score, type, element, evidence, fix; a row a defect, or one without a type): mean slide score, and the first ``most`` defects as lines."""
    each = answers.groupBy("deck_id", "slide").agg(F.first("score").alias("score"))
    scores = each.groupBy("deck_id").agg(F.round(F.avg("score"), 6).alias("score"))
    said = F.concat(F.lit("- "), F.col("type"), F.lit(" @ "), F.coalesce("element", F.lit("unknown element")), F.lit(": "), F.trim(F.coalesce("evidence", F.lit(""))), F.lit(" -> "), F.trim(F.coalesce(F.nullif("fix", F.lit("")), F.lit("revise the affected region"))))
    lines = answers.where("type is not null").groupBy("deck_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("slide", "type", said.alias("line")))), 1, most).alias("l"))
    text = F.when(F.col("l").isNull(), "Examiner: no visual or semantic defects detected; deck reads clean.").otherwise(F.concat(F.lit("Examiner critique:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")))
    return scores.join(lines, "deck_id", "left").select("deck_id", "score", text.alias("reflection"))


def hybrid_feedback(linter: DataFrame, examiner: DataFrame) -> DataFrame:
    """The linter's score selects, both texts explain."""
    e = examiner.select("deck_id", F.col("reflection").alias("more"))
    return linter.join(e, "deck_id", "left").select("deck_id", "score", F.concat_ws("\n\n", "reflection", "more").alias("reflection"))


def hybrid_critique(linter: DataFrame, answers: DataFrame, router: dict[str, str]) -> DataFrame:
    """Of linter types (slide_id, types) and answers (slide_id, type, engine, present): for each slide and routed type, who decides and what is found."""
    plan = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(e).alias("engine")) for t, e in router.items()])).alias("p")
    df = linter.select("slide_id", "types", plan).select("slide_id", "types", "p.*")
    told = answers.groupBy("slide_id", "type", "engine").agg(F.bool_or("present").alias("said"))
    df = df.join(told, ["slide_id", "type", "engine"], "left")
    return df.select("slide_id", "type", "engine", F.when(F.col("engine") == "linter", F.array_contains("types", F.col("type"))).otherwise(F.coalesce("said", F.lit(False))).alias("present"))


def both_ways(rows: DataFrame) -> DataFrame:
    """Of pairwise answers (sample_id, turn 0 or 1, worse, a or b): present only if both turns call the sample worse, which is a in turn 0 and b in turn 1."""
    right = F.when(F.col("turn") == 0, F.col("worse") == "a").otherwise(F.col("worse") == "b")
    return rows.groupBy("sample_id").agg((F.countDistinct(F.when(F.coalesce(right, F.lit(False)), F.col("turn"))) == 2).alias("present"), F.count("worse").alias("answers"))


def with_evidence(rows: DataFrame) -> DataFrame:
    """Yes-or-no answers that count only with an element and a place named: ``has_defect`` of the others is false, and they are marked."""
    told = (F.length(F.trim(F.coalesce("said_element", F.lit("")))) > 0) & (F.length(F.trim(F.coalesce("said_region", F.lit("")))) > 0)
    return rows.withColumn("unfounded", F.col("has_defect") & ~told).withColumn("has_defect", F.col("has_defect") & told)


def echoed(samples: DataFrame, misses: tuple[str, ...] = ()) -> DataFrame:
    """What a mock judge says of samples (modality, expected): the expected type with full confidence, nothing in the modalities that it misses."""
    told = F.when(~F.col("modality").isin(*misses) if misses else F.lit(True), F.col("expected"))
    return samples.withColumn("predicted", told).withColumn("score", F.when(told.isNull(), 1.0).otherwise(0.0))


def jobs(samples: DataFrame, modalities: tuple[str, ...], cap: int, order: str = "ord") -> DataFrame:
    """Of samples (type, ord): the first ``cap`` of each type, each with its clean twin, in every modality."""
    w = Window.partitionBy("type").orderBy(order)
    kept = samples.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= cap).drop("_i")
    twin = F.explode(F.array(F.lit(False), F.lit(True)))
    return kept.withColumn("is_clean", twin).withColumn("modality", F.explode(F.array(*[F.lit(m) for m in modalities])))


def render_jobs(manifest: DataFrame, folder: str, clean: bool = True) -> DataFrame:
    """Of a manifest (sample_id, clean_path, pages): a row for each picture to render: defective, clean, and each page of a deck."""
    role = F.array(F.lit("defective"), F.when(F.lit(clean) & F.col("clean_path").isNotNull(), "clean"))
    pages = F.when(F.col("pages") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("pages") - 1)), lambda i: F.concat(F.lit("page:"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    df = manifest.select("sample_id", F.explode(F.array_compact(F.concat(role, pages))).alias("role"))
    return df.withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("sample_id").cast("string"), F.lit("/"), F.replace("role", F.lit(":"), F.lit("_")), F.lit(".png")))


#: Where a deck's content is placed.
TITLE_BOX, BODY_X, BODY_W, BODY_Y, BODY_STEP, BODY_H = (96.0, 72.0, 1728.0, 72.0), 144.0, 1512.0, 180.0, 92.0, 72.0
CONTENT = "struct<deck_id:string,slides:array<struct<title:string,section:string,bullets:array<string>,figures:array<struct<kind:string,claim:string>>>>>"


def laid_out(contents: DataFrame, content: str = "content") -> DataFrame:
    """Decks as JSON to elements: a title, bullets below each other, figures with a claim below these: deck_id, page, element_id, etype, text, x, y, w, h."""
    df = contents.select(F.from_json(content, CONTENT).alias("d")).select(F.coalesce("d.deck_id", F.lit("generated_deck")).alias("deck_id"), F.posexplode("d.slides").alias("i", "s"))
    df = df.select("deck_id", (F.col("i") + 1).alias("page"), "s.*")
    none = F.array().cast("array<string>")
    bullets, figures = F.coalesce("bullets", none), F.transform(F.coalesce("figures", F.array().cast("array<struct<kind:string,claim:string>>")), lambda f: F.trim(F.coalesce(f["claim"], F.lit(""))))
    box = lambda kind, name, text, x, y, w, h: F.struct(F.lit(kind).alias("etype"), name.alias("element_id"), text.alias("text"), F.lit(x).alias("x"), y.cast("double").alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    named = lambda suffix, i=None: F.concat(F.lit("s"), F.col("page").cast("string"), F.lit(suffix), *([] if i is None else [i.cast("string")]))
    title = F.array(box("title", named("_title"), F.coalesce("title", F.concat(F.lit("Slide "), F.col("page").cast("string"))), TITLE_BOX[0], F.lit(TITLE_BOX[1]), TITLE_BOX[2], TITLE_BOX[3]))
    body = F.transform(bullets, lambda t, i: box("text", named("_body", i), t, BODY_X, BODY_Y + i * BODY_STEP, BODY_W, BODY_H))
    low = F.when(F.size(bullets) > 0, BODY_Y + F.size(bullets) * BODY_STEP).otherwise(BODY_Y)
    figure = F.filter(F.transform(figures, lambda t, i: box("figure", named("_fig", i), t, BODY_X, low + 24 + i * 96, BODY_W, 80.0)), lambda e: e["text"] != "")
    return df.select("deck_id", "page", "section", F.explode(F.concat(title, body, figure)).alias("e")).select("deck_id", "page", "section", "e.*")


def task_plan(topics: DataFrame, scenarios: tuple[str, ...], seed: int) -> DataFrame:
    """Topics (topic, audience) in a seeded order with rotating scenarios and two sizes of deck."""
    order = Window.orderBy(F.md5(F.concat_ws("#", F.lit(str(seed)), "topic", "audience")), "topic", "audience")
    df = topics.withColumn("i", F.row_number().over(order) - 1)
    scenario = F.element_at(F.array(*[F.lit(s) for s in scenarios]), (F.col("i") % len(scenarios) + 1).cast("int"))
    target = F.when(F.col("i") % 2 == 0, 8).otherwise(12)
    df = df.withColumn("scenario", scenario).withColumn("target_slides", target)
    brief = F.concat(F.lit("Create a "), F.replace("scenario", F.lit("_"), F.lit(" ")), F.lit(" deck for "), "audience", F.lit(" about "), "topic", F.lit("."))
    return df.select(F.concat(F.lit("p3_"), F.lpad(F.col("i").cast("string"), F.greatest(F.lit(2), F.length(F.col("i").cast("string"))), F.lit("0")), F.lit("_"), "scenario").alias("task_id"), "scenario", "audience", "topic", brief.alias("brief"), "target_slides", F.greatest(F.lit(5), F.col("target_slides") - 3).alias("min_slides"))


def row_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of rows in either, in both, and in the first beyond the second, as sets and as bags."""
    left, right = stored(left, "left"), stored(right, "right")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("set"), "n")
    return reduce(DataFrame.unionByName, [n(left.union(right).distinct(), "union"), n(left.intersect(right), "intersect"), n(left.subtract(right), "except"), n(left.intersectAll(right), "intersect_all"), n(left.exceptAll(right), "except_all")])


def cell_text(cells: DataFrame, small: int = 20) -> DataFrame:
    """Cells (tp, n_pos, tn, n_neg) as text: estimate, interval, sizes and a mark for small ones; a dash without rows on a side."""
    w = cells.withColumn("b", balanced_accuracy(F.col("tp"), F.col("n_pos"), F.col("tn"), F.col("n_neg")))
    text = F.concat(F.format_string("%.3f [%.2f–%.2f] n=%d/%d", F.bround("b.estimate", 3), F.bround("b.low", 2), F.bround("b.high", 2), F.col("n_pos"), F.col("n_neg")), F.when(F.least("n_pos", "n_neg") < small, " †").otherwise(""))
    return w.withColumn("cell", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), text).otherwise("—")).drop("b")


def mean_recall(cells: DataFrame, default: float = 1.0) -> float | None:
    """The mean recall of cells, a default without any."""
    value = sized(cells).agg(F.avg("recall")).first()[0]
    return default if value is None else round(value, 3)
