from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from deckframe.functions import stats
from deckframe.operators import audits


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(*columns).first()


@pytest.mark.parametrize(("p", "adjusted"), [([0.01, 0.02, 0.03, 0.04, 0.05], [0.05, 0.08, 0.09, 0.09, 0.09]), ([0.04, 0.01, 0.05, 0.02, 0.03], [0.09, 0.05, 0.09, 0.08, 0.09])])
def test_holm(spark, p, adjusted):
    rows = audits.holm(spark.createDataFrame(list(enumerate(p)), "ord int, p double")).orderBy("ord").collect()
    assert [r.holm for r in rows] == pytest.approx(adjusted)
    assert all(r.holm >= r.p and r.holm_reject == (r.holm <= 0.05) for r in rows)


def test_benjamini_hochberg(spark):
    rows = audits.benjamini_hochberg(spark.createDataFrame(list(enumerate([0.01, 0.02, 0.03, 0.04, 0.05])), "ord int, p double")).collect()
    assert [r.bh for r in rows] == pytest.approx([0.05] * 5) and all(r.bh_reject for r in rows)


def test_wilson_and_balanced_accuracy(spark):
    rows = spark.createDataFrame([(0, 61), (30, 40), (0, 0)], "k long, n long").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    a, b, c = (r.w for r in rows)
    assert a.low == 0 and 0 < a.high < 0.1
    assert b.low < 0.75 < b.high and (c.estimate, c.low, c.high) == (0, 0, 1)
    ba = one(spark, stats.balanced_accuracy(F.lit(0), F.lit(60), F.lit(432), F.lit(432)).alias("b")).b
    assert ba.estimate == 0.5 and ba.low < 0.5 <= ba.high


def test_normal_tail(spark):
    xs = [0.0, 0.5, -1.96, 3.0, 6.9, 7.2, 12.0, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.two_sided_p("x").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(abs(r.x) / math.sqrt(2)), rel=1e-8, abs=1e-300)


def test_two_proportions(spark):
    df = spark.createDataFrame([(99, 100, 157, 200), (50, 100, 50, 100), (0, 0, 1, 2)], "a long, b long, c long, d long")
    p = [r.p for r in audits.two_proportion_z(df, "a", "b", "c", "d").collect()]
    assert p[0] < 0.001 and p[1:] == [1, 1]


def test_mcnemar(spark):
    strata = spark.createDataFrame([(52, 0), (9, 0), (58, 0), (30, 0)], "b long, c long")
    r = audits.stratified_mcnemar(strata).first()
    assert (r.b, r.c, r.max_reversal) == (149, 0, 0) and r.p < 1e-30
    r = audits.stratified_mcnemar(spark.createDataFrame([(20, 0), (0, 20)], "b long, c long")).first()
    assert (r.chi2, r.p, r.max_reversal) == (0, 1, 20)
    cases = [(0, 0), (5, 0), (0, 5), (7, 3), (400, 350)]
    rows = spark.createDataFrame(cases, "b long, c long").select("b", "c", stats.exact_mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        n, k = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel=1e-9)


def test_pearson_and_kappa(spark):
    r = lambda rows: spark.createDataFrame(rows, "x double, y double").agg(stats.pearson("x", "y").alias("r")).first().r
    assert r([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == pytest.approx(1)
    assert r([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)]) == 0 and r([(1.0, 2.0)]) == 0
    k = lambda *c: one(spark, stats.kappa(*[F.lit(v) for v in c]).alias("k")).k
    assert k(1, 1, 1, 1, 2) == 1 and k(2, 0, 2, 2, 2) == 1 and k(0, 0, 1, 1, 2) < 0


def test_panel(spark):
    rows = [(1, "s1", 1, 0.9, "human"), (2, "s1", 2, 0.8, "human"), (1, "s2", 1, 0.9, "human"), (2, "s2", 2, 0.2, "human"), (3, "s2", 3, 0.1, "api")]
    df = spark.createDataFrame(rows, "ord long, sample_id string, judge long, score double, source string")
    r = audits.agreement(df).first()
    assert (r.pairs, r.agreement, r.two_rater_samples) == (2, 0.5, 2)
    panel = {r.sample_id: r for r in audits.panel_summary(df).collect()}
    assert panel["s1"].majority and not panel["s2"].majority and panel["s2"].sources == ["api", "human"]


def test_rollouts(spark):
    rows = [("c", 1, 1, -0.5), ("c", 1, 2, 0.9), ("c", 1, 3, 0.4), ("c", 2, 1, 0.1)]
    runs = audits.rollouts_to_threshold(spark.createDataFrame(rows, "cond string, run long, n long, score double"))
    got = {r.run: r for r in runs.collect()}
    assert (got[1].reached, got[1].rollouts, got[2].reached) == (2, 3, None)
    r = audits.censored_means(runs).first()
    assert (r.n_reached, r.mean_reached, r.mean_censored) == (1, 2, 2.5)


def test_sample_size():
    from deckframe.operators.corpus import sample_size

    assert sample_size(0.5, 0.6) == 388
    with pytest.raises(ValueError, match="differ"):
        sample_size(0.5, 0.5)
