"""Analytics of judge records: classification, confusion, attribution, gaps, thresholds.

Probe records have ord, sample_id, model, raw_modality, task, expected (a type, null
for clean rows), predicted (a type or null), severity, template, resolution, repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckframe.functions.stats import balanced_accuracy, exact_mcnemar, ratio, wilson

CLEAN = "NO_DEFECT"


def last_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_last")).select(*keys, "_last.*")


def classify(probe: DataFrame) -> DataFrame:
    """Typed facts: modality normalised, expected and predicted type sets, and whether the row is right.

    A clean row is right if nothing is predicted; another if all expected types are, more may be.
    """
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    df = probe.withColumn("modality", F.when(F.col("raw_modality") == "Bprime", "B_prime").otherwise(F.col("raw_modality")))
    df = df.withColumn("expected_types", one("expected")).withColumn("predicted_types", one("predicted"))
    right = F.when(F.size("expected_types") == 0, F.size("predicted_types") == 0).otherwise(F.size(F.array_except("expected_types", "predicted_types")) == 0)
    return df.withColumn("correct", right)


def aggregate_metrics(facts: DataFrame) -> DataFrame:
    """Accuracy, recall, precision and F1 by model, modality, task, type, template and resolution.

    False positives are counted over the wider slice of model, modality and task.
    """
    wide = ["model", "modality", "task"]
    kinds = F.when(F.size("expected_types") == 0, F.array(F.lit(CLEAN))).otherwise(F.array_distinct("expected_types"))
    rows = facts.withColumn("type", F.explode(kinds)).withColumn("hit", F.array_contains("predicted_types", F.col("type")))
    cells = rows.groupBy(*wide, "type", "template", "resolution").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("hit").alias("tp"))
    wrong = facts.withColumn("type", F.explode(F.array_except("predicted_types", "expected_types"))).groupBy(*wide, "type").agg(F.count("*").alias("fp"))
    df = cells.join(wrong, [*wide, "type"], "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    clean = F.col("type") == CLEAN
    recall = F.when(clean, 0.0).otherwise(ratio(F.col("tp"), F.col("n")))
    precision = F.when(clean, 0.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return df.select(*wide, "type", "template", "resolution", "n", ratio(F.col("n_correct"), F.col("n")).alias("accuracy"), recall.alias("recall"), precision.alias("precision"), ratio(2 * precision * recall, precision + recall).alias("f1"), "fp")


def attribute_failures(facts: DataFrame) -> DataFrame:
    """Of T1 rows judged in A and B: perception (A wrong, B right), reasoning (both wrong) and execution (A right, repair failed), as shares of all."""
    key = ["model", "sample_id"]
    t1 = facts.where("task = 'T1'")
    a = last_wins(t1.where("modality = 'A'").select(*key, "ord", F.coalesce("expected", F.lit(CLEAN)).alias("type"), "template", F.col("correct").alias("a")), key).drop("ord")
    b = last_wins(t1.where("modality = 'B'").select(*key, "ord", F.col("correct").alias("b")), key).drop("ord")
    repair = last_wins(facts.where("task = 'T3' and modality = 'A' and repaired is not null").select(*key, "ord", "repaired"), key).drop("ord")
    df = a.join(b, key).join(repair, key, "left")
    n = F.count("*")
    out = df.groupBy("model", "type", "template").agg(
        n.alias("n"),
        F.count_if(~F.col("a") & F.col("b")).alias("perception"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("reasoning"),
        F.count_if("a").alias("image_success"),
        F.count_if(F.col("a") & ~F.coalesce("repaired", F.lit(True))).alias("execution"),
    )
    rates = {"perception_rate": "perception", "reasoning_rate": "reasoning", "execution_rate": "execution", "image_success_rate": "image_success"}
    return out.withColumns({name: ratio(F.col(c), F.col("n")) for name, c in rates.items()})


def modality_gaps(facts: DataFrame, left: str = "A", right: str = "B") -> DataFrame:
    """Accuracy of two modalities and their difference, where both have rows."""
    t1 = facts.where((F.col("task") == "T1") & F.col("modality").isin(left, right))
    side = lambda m, f: f(F.when(F.col("modality") == m, F.col("correct")))
    hits = lambda m: F.count_if((F.col("modality") == m) & F.col("correct"))
    df = t1.groupBy("model", F.coalesce("expected", F.lit(CLEAN)).alias("type"), "template").agg(
        side(left, F.count).alias("n_left"), side(right, F.count).alias("n_right"), hits(left).alias("h_left"), hits(right).alias("h_right")
    )
    df = df.where("n_left > 0 and n_right > 0")
    l, r = ratio(F.col("h_left"), F.col("n_left")), ratio(F.col("h_right"), F.col("n_right"))
    return df.select("model", "type", "template", "n_left", "n_right", l.alias("left_accuracy"), r.alias("right_accuracy"), (r - l).alias("gap"))


def template_collapse(facts: DataFrame) -> DataFrame:
    """Error in free form and in template, and what the template takes away."""
    kind = F.coalesce("expected", F.lit(CLEAN))
    wrong = lambda t: (F.count_if((F.col("template") == t) & ~F.col("correct")), F.count_if(F.col("template") == t))
    (fw, fn), (tw, tn) = wrong("freeform"), wrong("template")
    df = facts.groupBy("model", "modality", "task", kind.alias("type")).agg(fw.alias("fw"), fn.alias("fn"), tw.alias("tw"), tn.alias("tn")).where("fn > 0 and tn > 0")
    free, held = ratio(F.col("fw"), F.col("fn")), ratio(F.col("tw"), F.col("tn"))
    return df.select("model", "modality", "task", "type", F.col("fn").alias("n_free"), F.col("tn").alias("n_held"), free.alias("freeform_error"), held.alias("template_error"), (free - held).alias("reduction"), F.coalesce(F.try_divide(free - held, free), F.lit(0.0)).alias("relative_reduction"))


def variance_gates(facts: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Effect of B over A against ``multiplier`` pooled standard errors of populations."""
    right = F.col("correct").cast("double")
    side = lambda m: F.when(F.col("modality") == m, right)
    df = facts.groupBy("model", "task", F.coalesce("expected", F.lit(CLEAN)).alias("type"), "template").agg(
        *[f(side(m)).alias(f"{name}_{m}") for m in ("A", "B") for name, f in (("n", F.count), ("mean", F.avg))]
    )
    var = lambda m: F.col(f"mean_{m}") * (1 - F.col(f"mean_{m}")) / F.col(f"n_{m}")  # noqa: E731  of zeros and ones
    df = df.where("n_A > 0 and n_B > 0").withColumn("effect", F.col("mean_B") - F.col("mean_A")).withColumn("sigma", F.sqrt(var("A") + var("B")))
    ok = F.when(F.col("sigma") == 0, F.col("effect") != 0).otherwise(F.abs("effect") >= multiplier * F.col("sigma"))
    return df.select("model", "task", "type", "template", "n_A", "n_B", "effect", "sigma", F.when(ok, "conclusive").otherwise("inconclusive").alias("verdict"))


def psychometric_points(facts: DataFrame) -> DataFrame:
    """Detection rate and mean realised severity in each bin: the nominal severity (grid) where there is one, else the severity."""
    hit = F.array_contains("predicted_types", F.col("expected"))
    bins = facts.withColumn("bin", F.coalesce("grid", "severity")).where("expected is not null and bin is not null")
    df = bins.groupBy("model", "modality", "task", F.col("expected").alias("type"), "bin").agg(F.avg("severity").alias("realized"), F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return df.withColumn("rate", ratio(F.col("hits"), F.col("n"))).drop("hits")


def psychometric(facts: DataFrame, target: float = 0.5) -> DataFrame:
    """The smallest bin of severity whose detection rate reaches ``target``, null if none does."""
    rate = F.col("rate")
    return psychometric_points(facts).groupBy("model", "modality", "task", "type").agg(F.min(F.when(rate >= target, F.col("bin"))).alias("threshold"), F.count("*").alias("n_bins"), F.max(rate).alias("best_rate"))


def repair_rates(facts: DataFrame) -> DataFrame:
    return facts.where("task = 'T3' and repaired is not null").groupBy("model", F.coalesce("expected", F.lit(CLEAN)).alias("type"), "template").agg(F.count("*").alias("n"), ratio(F.count_if("repaired"), F.count("*")).alias("pass_rate"))


def distribution(facts: DataFrame) -> DataFrame:
    """Counts by type, by task, by template and of all, with the range of severity: one pass of grouping sets."""
    kind = F.coalesce("expected", F.lit(CLEAN))
    df = facts.select(kind.alias("type"), "task", "template", "severity")
    sets = df.groupingSets([[F.col("type")], [F.col("task")], [F.col("template")], []], "type", "task", "template")
    return sets.agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), F.min("severity").alias("min_severity"), F.max("severity").alias("max_severity"))


def hypotheses(gaps: DataFrame, collapse: DataFrame, gap: float = 0.2, semantic: float = 0.1, reduction: float = 0.5) -> DataFrame:
    """Verdicts: every gap of a geometry type at least ``gap`` and of a semantic one at most ``semantic``; every relative reduction at least ``reduction``."""
    of = lambda letter: F.col("type").startswith(letter)
    one = gaps.agg(F.min(F.when(of("G"), F.col("gap"))).alias("least"), F.coalesce(F.max(F.when(of("S"), F.abs("gap"))), F.lit(0.0)).alias("semantic"))
    passed = (F.col("least") >= gap) & (F.col("semantic") <= semantic)
    say = lambda ok: F.when(F.col("least").isNull(), "inconclusive").when(ok, "pass").otherwise("fail")
    one = one.select(F.lit("H1").alias("hypothesis"), say(passed).alias("verdict"), "least", "semantic")
    two = collapse.where("type in ('G3', 'G4', 'G5', 'G6')").agg(F.min("relative_reduction").alias("least"))
    two = two.select(F.lit("H1_tpl").alias("hypothesis"), say(F.col("least") >= reduction).alias("verdict"), "least", F.lit(None).cast("double").alias("semantic"))
    return one.unionByName(two)


def _cell(df: DataFrame, keys: list[Column | str], hit: str) -> DataFrame:
    dirty, h = ~F.col("is_clean"), F.col(hit)
    return df.groupBy(*keys).agg(F.count_if(dirty & h).alias("tp"), F.count_if(dirty).alias("n_pos"), F.count_if(~dirty & ~h).alias("tn"), F.count_if(~dirty).alias("n_neg"))


def _rates(cells: DataFrame) -> DataFrame:
    tp, n_pos, tn, n_neg = (F.col(c) for c in ("tp", "n_pos", "tn", "n_neg"))
    fp = n_neg - tn
    recall, precision = ratio(tp, n_pos), ratio(tp, tp + fp)
    ba = balanced_accuracy(tp, n_pos, tn, n_neg)
    return cells.withColumn("recall", recall).withColumn("fpr", ratio(fp, n_neg)).withColumn("precision", precision).withColumn("f1", ratio(2 * precision * recall, precision + recall)).withColumn("ba", ba).select("*", F.col("ba.estimate").alias("bal_acc"), F.round("ba.low", 9).alias("ba_low"), F.round("ba.high", 9).alias("ba_high")).drop("ba")


def confusion_cells(rows: DataFrame, failures: str = "drop", hit: str = "has_defect") -> DataFrame:
    """Cells by model, condition and type; failed rows are dropped or count as nothing seen ("miss")."""
    df = rows.where(~F.col("failure")) if failures == "drop" else rows.withColumn(hit, F.col(hit) & ~F.col("failure"))
    return _rates(_cell(df, ["model", "cond", "defect"], hit))


def stratum_cells(rows: DataFrame) -> DataFrame:
    """Cells by type and stratum, and over all strata of a type: a rollup; the stratum is then "all"."""
    df = rows.where(~F.col("failure"))
    dirty, h = ~F.col("is_clean"), F.col("has_defect")
    cells = df.rollup("defect", "stratum").agg(F.grouping_id().alias("g"), F.count_if(dirty & h).alias("tp"), F.count_if(dirty).alias("n_pos"), F.count_if(~dirty & ~h).alias("tn"), F.count_if(~dirty).alias("n_neg"))
    return _rates(cells.where("g < 3").withColumn("stratum", F.when(F.col("g") == 1, "all").otherwise(F.col("stratum"))).drop("g"))


def micro_macro(cells: DataFrame) -> DataFrame:
    """By model and condition: the mean balanced accuracy of the types, and that of their summed counts."""
    df = cells.groupBy("model", "cond").agg(F.avg("bal_acc").alias("macro"), *[F.sum(c).alias(c) for c in ("tp", "n_pos", "tn", "n_neg")])
    return df.select("model", "cond", "macro", balanced_accuracy(F.col("tp"), F.col("n_pos"), F.col("tn"), F.col("n_neg"))["estimate"].alias("micro"))


def best_cells(cells: DataFrame) -> DataFrame:
    """The condition of highest balanced accuracy for each model and type; of equal ones the first by name."""
    w = Window.partitionBy("model", "defect").orderBy(F.col("bal_acc").desc(), "cond")
    return cells.withColumn("r", F.row_number().over(w)).where("r = 1").select("model", "defect", "cond", "bal_acc")


def coverage(cells: DataFrame, least: float = 0.7) -> DataFrame:
    """By model and condition: types covered, with balanced accuracy and precision of at least ``least``."""
    ok = (F.col("bal_acc") >= least) & (F.col("precision") >= least)
    return cells.groupBy("model", "cond").agg(F.count_if(ok).alias("covered"), F.count("*").alias("types"), F.avg("bal_acc").alias("mean_bal_acc"), F.array_sort(F.collect_list(F.when(ok, F.col("defect")))).alias("covered_types"))


def afc_metrics(rows: DataFrame) -> DataFrame:
    """Forced choice of two images in both orders, by type and mode.

    A pick names the first (a) or second (b) image; the probe is a in order 0 and b in
    order 1. Strict accuracy is over the pairs decided in both orders, loose over all
    judgements; ``invention`` is the share of clean pairs judged alike in both orders.
    """
    first, second = F.col("pick0"), F.col("pick1")
    judged = F.array_compact(F.array(F.when(first.isNotNull(), F.struct(F.lit(0).alias("o"), first.alias("p"))), F.when(second.isNotNull(), F.struct(F.lit(1).alias("o"), second.alias("p")))))
    each = lambda cond: F.sum(F.size(F.filter(judged, cond)))
    probe = lambda x: ((x["o"] == 0) & (x["p"] == "a")) | ((x["o"] == 1) & (x["p"] == "b"))
    partner = lambda x: ((x["o"] == 0) & (x["p"] == "b")) | ((x["o"] == 1) & (x["p"] == "a"))
    decisive = F.coalesce(first.isin("a", "b") & second.isin("a", "b"), F.lit(False))
    agree = decisive & (first == "a") & (second == "b")
    df = rows.groupBy("defect", "mode").agg(
        F.count("*").alias("n_pairs"),
        each(lambda x: F.lit(True)).alias("judgements"),
        each(probe).alias("probe"),
        each(partner).alias("partner"),
        each(lambda x: x["p"] == "tie").alias("ties"),
        each(lambda x: x["p"] == "a").alias("first_picks"),
        F.count_if(decisive).alias("decisive"),
        F.count_if(agree).alias("strict_hits"),
        F.count_if(decisive & (first != second)).alias("alike"),
    )
    df = df.withColumn("strict", ratio(F.col("strict_hits"), F.col("decisive"))).withColumn("loose", ratio(F.col("probe"), F.col("judgements")))
    df = df.withColumn("pick_first", ratio(F.col("first_picks"), F.col("probe") + F.col("partner"))).withColumn("tie_rate", ratio(F.col("ties"), F.col("judgements")))
    return df.withColumn("invention", F.when(F.col("mode") == "clean", ratio(F.col("alike"), F.col("n_pairs"))))


def afc_balanced(rows: DataFrame) -> DataFrame:
    """Recall over all paired rows, specificity over all clean ones, and their mean with its interval.

    A type without a clean control counts as fully specific; one without paired rows is left out.
    """
    right = F.coalesce((F.col("pick0") == "a") & (F.col("pick1") == "b"), F.lit(False))
    consistent = F.coalesce(F.col("pick0").isin("a", "b") & F.col("pick1").isin("a", "b") & (F.col("pick0") != F.col("pick1")), F.lit(False))
    paired = F.col("mode") == "paired"
    df = rows.groupBy("defect").agg(F.count_if(paired & right).alias("tp"), F.count_if(paired).alias("n_pos"), F.count_if(~paired & ~consistent).alias("quiet"), F.count_if(~paired).alias("n_clean")).where("n_pos > 0")
    clean = lambda c: F.when(F.col("n_clean") > 0, F.col(c)).otherwise(F.col("n_pos"))
    df = df.withColumn("tn", clean("quiet")).withColumn("n_neg", clean("n_clean")).drop("quiet", "n_clean")
    return _rates(df).select("defect", "tp", "n_pos", "tn", "n_neg", "recall", "bal_acc", "ba_low", "ba_high")


def decompose(cells: DataFrame, afc: DataFrame) -> DataFrame:
    """What naming the type adds to the open question, and what pairing adds to that: by type, counts summed over models."""
    sums = cells.groupBy("defect", "cond").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pos", "tn", "n_neg")])
    ba = balanced_accuracy(F.col("tp"), F.col("n_pos"), F.col("tn"), F.col("n_neg"))["estimate"]
    pick = lambda c: F.max(F.when(F.col("cond") == c, F.col("ba")))
    wide = sums.withColumn("ba", ba).groupBy("defect").agg(pick("C0").alias("c0"), pick("NAMED").alias("named"))
    df = wide.join(afc.select("defect", F.col("bal_acc").alias("afc")), "defect")
    naming, pairing = F.col("named") - F.col("c0"), F.col("afc") - F.col("named")
    gate = F.when(F.greatest(naming, pairing) <= 0, "none").when(naming >= pairing, "naming").otherwise("pairing")
    return df.select("defect", "c0", "named", "afc", naming.alias("naming"), pairing.alias("pairing"), gate.alias("gate"))


def paired_mcnemar(rows: DataFrame, base: str = "C0", other: str = "C3") -> DataFrame:
    """Discordant pairs of two conditions on the samples both have, and the exact two-sided p, by type."""
    right = F.col("has_defect") != F.col("is_clean")
    one = rows.where(~F.col("failure")).groupBy("defect", F.col("sample_id").alias("sample"), "cond").agg(F.bool_and(right).alias("ok"))
    x = one.where(F.col("cond") == base).select("defect", "sample", F.col("ok").alias("x"))
    y = one.where(F.col("cond") == other).select("defect", "sample", F.col("ok").alias("y"))
    df = x.join(y, ["defect", "sample"]).groupBy("defect").agg(F.count_if(~F.col("x") & F.col("y")).alias("b"), F.count_if(F.col("x") & ~F.col("y")).alias("c"))
    return df.withColumn("p", F.round(exact_mcnemar(F.col("b"), F.col("c")), 6))


def shares(rows: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """Share of ``hit`` with its Wilson interval."""
    df = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    w = df.withColumn("w", wilson(F.col("k"), F.col("n")))
    return w.select(*keys, "n", "k", F.col("w.estimate").alias("share"), F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))
