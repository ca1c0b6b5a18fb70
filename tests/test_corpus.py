from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deckframe.operators import corpus, simulate


def test_evidence_and_fixes(spark):
    rows = [("Title overlaps box by 4 px", "overlap", None, True), ("severity is 3 px", "overlap", None, False), ("overlap", "overlap", None, False), ("looks bad", "overlap", None, False), ("e7 looks bad", "overlap", "E7", True), (None, "overlap", None, False), (" ", "x", "", False)]
    df = spark.createDataFrame(rows, "t string, k string, p string, want boolean")
    assert all(r.ok == r.want for r in df.select("want", corpus.evidence_ok(F.col("t"), F.col("k"), F.col("p")).alias("ok")).collect())
    assert [r[0] for r in spark.createDataFrame([("Please MOVE it",), ("remove",), ("moved",), (None,)], "t string").select(corpus.fix_ok(F.col("t"))).collect()] == [True, True, False, False]


def test_replay_takes_the_last_answer(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    answers = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, ord int, output string")
    assert sorted((r.n, r.output, r.answered) for r in corpus.replay(requests, answers, ["k"]).collect()) == [(1, "new", True), (2, None, False)]


def test_deck_quality(spark):
    slides = spark.createDataFrame([(1, 1, "Intro"), (2, 1, None)], "slide_id long, deck_id long, section string")
    from test_layout import box, elements

    shown = elements(spark, box(100, 100, 900, 60, etype="title", text="Main results"), *[box(100, 200 + 80 * i, 900, 60, etype="text", text="b") for i in range(7)])
    need = spark.createDataFrame([(1, "intro"), (1, "main_results"), (1, "missing")], "deck_id long, section string")
    decks = spark.createDataFrame([(1, 4), (2, None)], "deck_id long, target_slides long")
    got = {r.deck_id: r for r in corpus.deck_quality(corpus.quality_parts(decks, slides, shown, need)).collect()}
    parts = got[1]
    assert parts.coverage == pytest.approx(2 / 3, abs=1e-4) and parts.conciseness == 0.5 and parts["count"] == 0.5
    assert got[2].degenerate and got[2].quality == 0.0 and got[2]["count"] == 0.0
    terms = spark.createDataFrame([(1,), (1,)], "deck_id long")
    r = corpus.deck_quality(corpus.quality_parts(decks, slides, shown, need, terms)).where("deck_id = 1").first()
    assert r.terms == 0.5 and r.quality == pytest.approx(0.4 * 2 / 3 + 0.2 * r.geometry + 0.15 * 0.5 + 0.25 * 0.5, abs=1e-4)


def test_the_first_reason_rejects(spark):
    from test_layout import box, elements

    decks = spark.createDataFrame([(i,) for i in range(6)], "deck_id long")
    slides = spark.createDataFrame([(1, 1), (21, 2), (22, 2), (31, 3), (32, 3), (41, 4), (42, 4), (51, 5), (52, 5)], "slide_id long, deck_id long")
    good = lambda s: box(100, 100, 300, 60, slide_id=s, text="fine", etype="text", capacity=50)
    shown = elements(spark, good(1), good(21), box(0, 0, 0, 5, slide_id=22, text=" \n"), good(31), box(-80, 100, 60, 60, slide_id=32), good(41), good(42), good(51), box(100, 100, 300, 60, slide_id=52, text="long " * 90, etype="text", capacity=5))
    got = {r.deck_id: r.reason for r in corpus.reject_reasons(decks, slides, shown).collect()}
    assert got == {0: "empty_deck", 1: "too_few_slides", 2: "empty_slide", 3: "linter_defect", 4: None, 5: "linter_defect"}


def test_seeded_samples_and_quotas(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", i, "L") for i in range(60)] + [(99, "rare", 99, "M")], "ord long, type string, sample_id long, level string")
    a, b = (sorted(r.ord for r in simulate.stratified_sample(df, ["type"], 6, seed=3).collect()) for _ in range(2))
    assert a == b and len(a) == 19
    assert a != sorted(r.ord for r in simulate.stratified_sample(df, ["type"], 6, seed=4).collect())
    twin = {r.sample_id: r.partner for r in simulate.twins(df).collect()}
    assert twin[0] == 3 and twin[57] == 0 and 99 not in twin
