from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_layout import box, elements

from deckframe.operators import inject, layout


def column(spark, n=3, **more):
    return elements(spark, *[box(144.2, 180 + 90 * i, 800, 60, etype="text", text=f"bullet number {i}", color_group=1, r=17, g=17, b=17, **more) for i in range(n)])


def types(df):
    return {r.detector for r in layout.lint(df).collect()}


def test_each_slide_injector_is_seen_and_its_clean_twin_is_not(spark):
    df = column(spark, capacity=200)
    before = types(df) - {"palette"}
    assert before == set()
    cases = {
        "overflow": (inject.text_overflow(df, 64.0), ("text", "w", "measured_w")),
        "font": (inject.font_delta(df, 4.0), ("font", "expected_font")),
        "margin": (inject.page_offset(df, 8.0), ("x",)),
        "color_group": (inject.brand_colour(df, 24.0), ("r", "g", "b")),
    }
    for detector, (changes, columns) in cases.items():
        assert detector in types(inject.applied(df, changes, *columns)), detector
    assert inject.brand_colour(df, 24.0).first().severity == pytest.approx(24, abs=1.0)
    assert inject.margin_bleed(df, 16.0, "bottom").first().y == 1080 - 32 + 16 - 60


def test_severity_and_targets(spark):
    df = column(spark)
    assert inject.alignment_offset(df).first().targets == [1]
    assert inject.font_delta(df, -3.0).first().severity == 3
    one = elements(spark, box(100, 100, 300, 50, etype="text", text="alone", expected_x=90.0, expected_y=100.0))
    moved = inject.alignment_offset(one, 8.0).first()
    assert (moved.mode, moved.x, moved.expected_x) == ("absolute", 108, 90)
    assert inject.overlap(one).count() == 0
    far = inject.brand_colour(one, 10.0).first()
    assert far.mode == "absolute" and far.severity == pytest.approx(10, abs=0.6)


def test_words(spark):
    df = elements(spark, box(0, 0, 9, 9, etype="title", text="Plan"), box(0, 9, 9, 9, etype="text", text="  two  words "), box(0, 20, 9, 9, etype="image"))
    full = inject.density(df, 5).first()
    assert full.text == "Plan detail0 detail1 detail2 detail3" and full.targets == [0] and full.max_words == 50
    assert inject.density(df, 0).first().text == "Plan"
    assert inject.title_mismatch(df).first().text == "Unrelated:   two  words "
    told = inject.contradiction(df).first()
    assert told.targets == [2, 1] and "contradictory" in told.text
    empty = elements(spark, box(0, 0, 9, 9, etype="shape"))
    assert all(f.count() == 0 for f in (inject.density(empty), inject.text_overflow(empty), inject.title_mismatch(empty)))


def test_decks(spark):
    slides = spark.createDataFrame([(11, 1, 0, "intro"), (12, 1, 1, "body"), (13, 1, 2, "body"), (21, 2, 0, "intro")], "slide_id long, deck_id long, slide_index long, section string")
    assert {(r.slide_id, r.slide_index) for r in inject.order_break(slides).collect()} == {(11, 1), (12, 0), (13, 2)}
    assert {(r.deck_id, r.slide_id) for r in inject.missing_section(slides, "body").collect()} == {(1, 12)}
    shown = elements(spark, box(0, 0, 9, 9, slide_id=13, etype="text", text="the Platform, the Platform"), box(0, 0, 9, 9, slide_id=21, etype="text", text="other"), box(0, 0, 9, 9, slide_id=11, etype="text", text="the Platform"))
    assert {(r.slide_id, r.text, r.mode) for r in inject.term_variant(slides, shown, "Platform", "PlatformX").collect()} == {(13, "the PlatformX, the PlatformX", "replaced"), (21, "other PlatformX", "appended")}


def test_repair_takes_findings_away(spark):
    df = elements(
        spark,
        box(100, 80, 200, 40, etype="title", text="a title that is far too long", capacity=8),
        box(400, 200, 200, 100),
        box(450, 220, 200, 100),
        box(120, 340, 100, 80, expected_x=100.0, expected_y=340.0),
        box(8, 500, 100, 80),
        box(700, 500, 100, 80, font=32.0, expected_font=24.0),
        box(900, 500, 100, 80, r=255, b=255, er=0, eg=0, eb=0),
    )
    r = inject.repair_passes(df).first()
    assert r.found == ["alignment", "color", "font", "margin", "overflow", "overlap"] and r.left == [] and r.passes
    fixed = {x.pos: x for x in inject.repaired(df).collect()}
    assert fixed[0].text == "a title " and (fixed[1].x, fixed[1].y) == (666, 200) and fixed[3].x == 100 and fixed[4].x == 32 and fixed[5].font == 24 and fixed[6].r == 0


def test_overlaps_move_one_after_the_other(spark):
    """The first of a pair goes right of the second, below it where the page ends."""
    df = elements(spark, box(1700, 100, 200, 100), box(1650, 150, 250, 100), box(1600, 180, 260, 100))
    x = {r.pos: (r.new_x, r.new_y) for r in inject._moved_apart(df).collect()}
    assert x[0] == (1704, 296) and x[1] == (1654, 296)


def test_synthetic_manifest(spark):
    df = column(spark).unionByName(elements(spark, *[box(100, 100 * i, 300, 60, slide_id=2, etype="text" if i else "title", text="x y") for i in range(4)]))
    slides = df.select("slide_id").distinct()
    rows = inject.synthetic_manifest(slides, df, 2, 0.5, ("S6",), (64.0,)).collect()
    cells = sum(len(v) for v in inject.GRID.values()) * 2
    positives = [r for r in rows if r.type != "NO_DEFECT"]
    assert len(positives) == cells and len(rows) == cells + cells // 2 and len({r.sample_id for r in rows}) == len(rows)
    assert {r.split for r in positives} >= {"train", "ood_defect", "ood_severity"} and all(r.split == "ood_defect" for r in positives if r.type == "S6")
    assert any(r.sample_id.endswith("_G2_0p05_0000") for r in rows)
    assert inject.synthetic_manifest(slides.limit(0), df).count() == 0
    assert inject.slide_labels(df.where(F.lit(False))).count() == 0
