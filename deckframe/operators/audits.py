"""Audits: panels of raters, reward preference, multiplicity, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckframe.functions.stats import kappa, pearson, ratio, two_sided_p, wilson


def panel_summary(ratings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By sample: ratings, mean, population deviation, passes; at least half passing is a pass."""
    ok = F.count_if(F.col("score") >= threshold)
    df = ratings.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd"), ok.alias("passes"), F.array_sort(F.collect_set("source")).alias("sources"))
    return df.withColumn("mean_score", F.round("mean_score", 9)).withColumn("sd", F.round("sd", 9)).withColumn("majority", 2 * F.col("passes") >= F.col("n"))


def agreement(ratings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of pairs of human votes on a sample that agree, and kappa over samples with exactly two, in input order."""
    votes = ratings.where("source = 'human'").groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "score"))), lambda r: r["score"] >= threshold).alias("v"))
    n, yes = F.size("v").cast("long"), F.size(F.filter("v", lambda x: x)).cast("long")
    pairs = (n * (n - 1) / 2).cast("long")
    alike = ((yes * (yes - 1) + (n - yes) * (n - yes - 1)) / 2).cast("long")
    two = F.when(n == 2, F.col("v"))
    a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    df = votes.agg(F.sum(pairs).alias("pairs"), F.sum(alike).alias("alike"), F.count(two).alias("m"), F.count_if(a & b).alias("yy"), F.count_if(~a & ~b).alias("nn"), F.count_if(a).alias("fy"), F.count_if(b).alias("sy"))
    c = F.col
    return df.select("pairs", ratio(c("alike"), c("pairs")).alias("agreement"), c("m").alias("two_rater_samples"), F.round(kappa(c("yy"), c("nn"), c("fy"), c("sy"), c("m")), 9).alias("kappa"))


def reward_preference(pairs: DataFrame) -> DataFrame:
    """By scorer and type: how often the clean side scores higher, ties, the mean and the upper median gap."""
    key = ["scorer", "category", "defect"]
    rows = pairs.withColumn("gap", F.round(F.col("clean") - F.col("defective"), 6))
    each = Window.partitionBy(*key)
    rows = rows.withColumn("place", F.row_number().over(each.orderBy("gap"))).withColumn("of", F.count("*").over(each))
    middle = F.max(F.when(F.col("place") == F.floor(F.col("of") / 2) + 1, F.col("gap")))
    df = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 0).alias("wins"), F.count_if(F.col("gap") == 0).alias("ties"), F.round(F.avg("gap"), 6).alias("mean_gap"), middle.alias("upper_median"))
    w = df.withColumn("w", wilson(F.col("wins"), F.col("n")))
    return w.select("scorer", "category", "defect", "n", "wins", "ties", "mean_gap", "upper_median", F.col("w.estimate").alias("preference"), F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


def reward_categories(preference: DataFrame) -> DataFrame:
    """By type and category with two scorers or more: do all prefer clean, does none, or are they split."""
    above, below = F.col("low") > 0.5, F.col("high") < 0.5
    df = preference.groupBy("category", "defect").agg(F.count("*").alias("scorers"), F.count_if(above).alias("above"), F.count_if(below).alias("below")).where("scorers >= 2")
    verdict = F.when(F.col("above") == F.col("scorers"), "all_detect").when(F.col("above") == 0, "all_blind").otherwise("split")
    return df.withColumn("verdict", verdict)


def holm(tests: DataFrame, p: str = "p", by: tuple[str, ...] = ("ord",), alpha: float = 0.05) -> DataFrame:
    """Holm's adjusted p-values of all rows, and whether they are rejected."""
    order = Window.orderBy(p, *by)
    m = F.count("*").over(Window.partitionBy())
    raw = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    df = tests.withColumn("raw", raw)
    df = df.withColumn("holm", F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")
    return df.withColumn("holm_reject", F.col("holm") <= alpha)


def benjamini_hochberg(tests: DataFrame, p: str = "p", by: tuple[str, ...] = ("ord",), alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values that control the false discovery rate of all rows."""
    up = Window.orderBy(p, *by)
    down = Window.orderBy(F.col(p).desc(), *[F.col(c).desc() for c in by])
    df = tests.withColumn("raw", F.least(F.lit(1.0), F.col(p) * F.count("*").over(Window.partitionBy()) / F.row_number().over(up)))
    df = df.withColumn("bh", F.min("raw").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")
    return df.withColumn("bh_reject", F.col("bh") <= alpha)


def two_proportion_z(df: DataFrame, k1: str, n1: str, k2: str, n2: str) -> DataFrame:
    """Pooled z and its two-sided p; 0 and 1 where the pool has no variance."""
    c = F.col
    pool = F.try_divide((c(k1) + c(k2)).cast("double"), (c(n1) + c(n2)).cast("double"))
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), c(n1)) + F.try_divide(F.lit(1.0), c(n2))))
    z = F.coalesce(F.try_divide(c(k1) / F.nullif(c(n1), F.lit(0)) - c(k2) / F.nullif(c(n2), F.lit(0)), se), F.lit(0.0))
    return df.withColumn("z", z).withColumn("p", two_sided_p("z"))


def stratified_mcnemar(strata: DataFrame) -> DataFrame:
    """One test over strata (b, c): (sum b - sum c) squared over their sum, and the largest reversal."""
    df = strata.agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.max("c").alias("max_reversal"))
    chi = F.coalesce(F.try_divide(((F.col("b") - F.col("c")) * (F.col("b") - F.col("c"))).cast("double"), F.col("b") + F.col("c")), F.lit(0.0))
    return df.withColumn("chi2", chi).withColumn("z", F.sqrt("chi2")).withColumn("p", two_sided_p("z")).drop("z")


def rollouts_to_threshold(rollouts: DataFrame, q: float = 0.8) -> DataFrame:
    """By run: rollouts until the running best, from 0, reaches ``q``; null if it never does; with first, last and best."""
    w = Window.partitionBy("cond", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest(F.lit(0.0), F.max("score").over(w))
    df = rollouts.withColumn("best", best)
    return df.groupBy("cond", "run").agg(
        F.count("*").alias("rollouts"), F.min(F.when(F.col("best") >= q, F.col("n"))).alias("reached"), F.min_by("score", "n").alias("first"), F.max_by("score", "n").alias("last"), F.max("score").alias("best")
    ).withColumn("gain", F.col("last") - F.col("first")).withColumn("best_gain", F.col("best") - F.col("first"))


def censored_means(runs: DataFrame) -> DataFrame:
    """By condition: mean rollouts of the runs that reached, and with the others at the largest number seen; gains and their correlation."""
    budget = runs.agg(F.max("rollouts").alias("budget"))  # one row
    df = runs.crossJoin(F.broadcast(budget)).withColumn("held", F.coalesce("reached", "budget").cast("double"))
    return df.groupBy("cond").agg(F.count("*").alias("runs"), F.count("reached").alias("n_reached"), F.avg("reached").alias("mean_reached"), F.avg("held").alias("mean_censored"), F.round(F.avg("gain"), 9).alias("mean_gain"), F.round(F.avg("best_gain"), 9).alias("mean_best_gain"), F.round(pearson("first", "best_gain"), 6).alias("r_first_gain"))


def regime(means: DataFrame) -> DataFrame:
    """Spread of the conditions' best gains and the best of them; of equal ones the last by name."""
    return means.agg(F.max("mean_best_gain").alias("top"), (F.max("mean_best_gain") - F.min("mean_best_gain")).alias("spread"), F.max_by("cond", F.struct("mean_best_gain", "cond")).alias("best_cond"))
