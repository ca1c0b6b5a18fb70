from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deckframe.operators import studies


def test_levels_are_matched(spark):
    rows = [("m", "A", "page", ["G1"], ["G1"]), ("m", "A", "page", ["G1"], []), ("m", "A", "page", [], ["G1"]), ("m", "A", "page", [], []), ("m", "A", "deck", [], ["S2"]), ("m", "A", "deck", ["S2", "G1"], ["S2"]), ("m", "B", "page", ["G1"], [])]
    df = spark.createDataFrame(rows, "model string, modality string, level string, expected_types array<string>, predicted_types array<string>")
    got = {(r.modality, r.type): (r.n_pos, r.tp, r.n_neg, r.fp, r.bal_acc) for r in studies.level_scores(df).collect()}
    assert got == {("A", "G1"): (3, 1, 2, 1, pytest.approx((1 / 3 + 0.5) / 2, abs=1e-6)), ("A", "S2"): (1, 1, 1, 1, 0.5)}
    means = studies.group_means(studies.level_scores(df)).first()
    assert means.semantic == 0.5 and means.geometry == pytest.approx(0.416667)


def test_forced_choice_both_ways(spark):
    rows = [("p1", 0, "a", "a"), ("p1", 1, "b", "b"), ("p2", 0, "a", "a"), ("p2", 1, "a", "b"), ("p3", 0, None, "a"), ("p3", 1, "a", "b")]
    df = spark.createDataFrame([("m", "G1", *r) for r in rows], "model string, defect string, pair string, turn int, pick string, expect string")
    r = studies.forced_choice(df).first()
    assert (r.trials, r.parsed, r.right, r.pairs, r.robust, r.accuracy, r.one_sided) == (6, 5, 3, 3, 1, 0.6, True)
    said = studies.both_ways(df.select(F.col("pair").alias("sample_id"), "turn", F.col("pick").alias("worse")))
    assert {x.sample_id: x.present for x in said.collect()} == {"p1": True, "p2": False, "p3": False}


def test_rescue_needs_significance_and_precision(spark):
    cells = spark.createDataFrame([("m", "G1", "C0", 0.5, 0.9), ("m", "G1", "C3", 0.8, 0.9), ("m", "G1", "C2", 0.65, 0.75), ("m", "G1", "C1", 0.9, 0.5)], "model string, defect string, cond string, bal_acc double, precision double")
    pairs = spark.createDataFrame([("m", "G1", "C3", 12, 1, 0.003), ("m", "G1", "C2", 3, 2, 1.0), ("m", "G1", "C1", 12, 0, 0.001)], "model string, defect string, cond string, gain long, loss long, p double")
    got = {r.cond: (r.rescued, r.improved) for r in studies.rescued(cells, pairs).collect()}
    assert got == {"C3": (True, False), "C2": (False, True), "C1": (False, False)}


def test_channels(spark):
    rows = [(t, m, v) for t, vs in (("G1", (0.5, 0.7, 0.5)), ("G2", (0.5, 0.5, 0.55)), ("G3", (0.7, 0.5, 0.5)), ("G4", (0.5, 0.9, None))) for m, v in zip("ABC", vs, strict=True) if v is not None]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, type string, modality string, bal_acc double")
    assert {r.type: r.verdict for r in studies.channels(df).collect()} == {"G1": "perception", "G2": "capability", "G3": "image_sufficient"}


def test_routes_fall_back(spark):
    cells = spark.createDataFrame([("G1", "vlm_c0", 0.8, 0.8), ("G2", "linter", 0.9, 0.9), ("G2", "vlm_c0", 0.5, 0.5)], "type string, engine string, bal_acc double, precision double")
    got = {r.config: (r.types, r.covered, r.covered_types) for r in studies.routed_coverage(cells, {"G1": "vlm_c3", "G2": "linter"}).collect()}
    assert got == {"linter_only": (1, 1, "G2"), "vlm_only": (2, 1, "G1"), "vlm_c3": (0, 0, ""), "linter_plus_vlm_c3": (1, 1, "G2"), "hybrid": (2, 2, "G1,G2")}


def test_last_shard_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string")
    b = spark.createDataFrame([(2, "b", 5)], "id int, v string, w int")
    assert sorted(tuple(r) for r in studies.later_wins([a, b], ["id"]).collect()) == [(1, "a", None), (2, "b", 5)]


def test_fidelity(spark):
    df = spark.createDataFrame([("G1", True, 0.1, 0.0), ("G1", True, 0.2, 0.3), ("G1", False, 0.0, 0.0), ("G1", True, 0.3, None), ("G1", True, None, 0.1)], "type string, injected boolean, free double, held double")
    r = studies.fidelity(df, 0.05).first()
    assert (r.n, r.injected_rate, r.rendered_rate, r.pairs) == (5, 0.8, 0.75, 3)
    assert r.absorbed_rate == pytest.approx(1 / 3, abs=1e-6) and r.median == pytest.approx(0.15) and r.late == 0.2 and r.upper_median == 0.2


def test_regimes(spark):
    rows = [("strong", f"c{i}", i / 4, 0.95, 0.01 * i, 0.01 * i) for i in range(5)] + [("weak", f"c{i}", min(1.0, i / 3), 0.5, 0.1 * i, 0.1 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "regime string, cond string, q double, initial double, gain double, best_gain double")
    stats = studies.regime_stats(df, tuple(f"c{i}" for i in range(5)))
    got = {r.regime: r for r in stats.collect()}
    assert got["weak"].best == "c4" and got["strong"].spread == pytest.approx(0.04) and got["strong"].corr_gain == pytest.approx(1.0)
    r = studies.compare_regimes(stats, "strong", "weak").first()
    assert (r.headroom_ratio, r.spread_ratio, r.verdict) == (10.0, 10.0, "bounded_positive")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "type string, injected boolean, free double, held double")
    assert studies.fidelity(none, 0.1).count() == 0
    cells = spark.createDataFrame([], "recall double")
    assert studies.mean_recall(cells) == 1.0
    assert studies.one_proportion_z(spark.createDataFrame([(0, 0), (8, 10)], "k long, n long"), "k", "n").collect()[0].p == 1.0


def test_linter_feedback_of_a_clean_deck_is_one_line(spark):
    slides = spark.createDataFrame([(10, 1, 0), (20, 2, 0)], "slide_id long, deck_id long, slide_index long")
    findings = spark.createDataFrame([(20, "margin", i, 2.0) for i in range(25)], "slide_id long, detector string, pos long, severity double")
    scores = spark.createDataFrame([(20, 25, 0.0)], "slide_id long, n_findings long, score double")
    got = {r.deck_id: (r.score, r.findings, len(r.reflection.split("\n"))) for r in studies.linter_feedback(slides, scores, findings).collect()}
    assert got == {1: (1.0, 0, 1), 2: (0.0, 25, 21)}
