from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from deckframe.functions import colors
from deckframe.operators import inject, judging, layout, simulate, text, vision

FIELDS = {"slide_id": "long", "pos": "long", "etype": "string", "text": "string", "x": "double", "y": "double", "w": "double", "h": "double", "font": "double", "expected_x": "double", "expected_y": "double", "expected_font": "double", "align_group": "long", "font_group": "long", "color_group": "long", "r": "int", "g": "int", "b": "int", "er": "int", "eg": "int", "eb": "int", "capacity": "int", "measured_w": "double", "measured_h": "double", "hidden": "boolean", "opacity": "double", "fill": "boolean", "br": "int", "bg": "int", "bb": "int"}


def elements(spark, *rows):
    base = {"slide_id": 1, "etype": "shape", "text": "", "font": 24.0, "r": 0, "g": 0, "b": 0, "hidden": False, "opacity": 1.0, "fill": False}
    data = [tuple({**base, "pos": i, **row}.get(f) for f in FIELDS) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def box(x, y, w, h, **more):
    return {"x": float(x), "y": float(y), "w": float(w), "h": float(h), **more}


def test_one_slide_with_every_defect(spark):
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
    found = {(r.detector, r.pos): r.severity for r in layout.lint(df).collect()}
    assert {d for d, _ in found} == {"overflow", "overlap", "alignment", "font", "palette", "margin"}
    assert found["alignment", 3] == 20 and found["margin", 4] == 24 and found["font", 5] == 8
    assert layout.overlapping(df).select("pos", "other").first()[:] == (1, 2)
    score = layout.lint_scores(df).first()
    assert score.n_findings == len(found) and score.score == pytest.approx(max(0, 1 - 0.15 * len(found)))


def test_groups_leave_out_what_is_flagged(spark):
    df = elements(spark, *[box(100, 100 * i, 50, 50, align_group=1) for i in range(3)], box(140, 400, 50, 50, align_group=1), box(200, 500, 50, 50, align_group=1, expected_x=100.0, expected_y=500.0))
    assert {(r.pos, r.severity) for r in layout.alignment_findings(df).collect()} == {(3, 40.0), (4, 100.0)}


def test_majority_colour_ties_go_to_the_first(spark):
    rows = [box(0, 0, 9, 9, color_group=1, r=10), box(0, 0, 9, 9, color_group=1, r=200), box(0, 0, 9, 9, color_group=1, r=10), box(0, 0, 9, 9, color_group=1, r=200)]
    assert {r.pos for r in layout.color_group_findings(elements(spark, *rows)).collect()} == {1, 3}


def test_colours(spark):
    df = spark.createDataFrame([("#ff8000",), ("rgb(1, 2, 300)",), ("3,4,5",), ("#12",), (None,)], "c string").select(colors.parse_rgb(F.col("c")).alias("v"))
    assert [tuple(r.v) if r.v else None for r in df.collect()] == [(255, 128, 0), (1, 2, 255), (3, 4, 5), None, None]
    red = colors.with_lab(spark.createDataFrame([(255, 0, 0), (None, 0, 0)], "r int, g int, b int"), "c", "r", "g", "b").orderBy(F.col("r").desc_nulls_last()).select("c_l", "c_a", "c_b").collect()
    lab = list(red[0])
    assert tuple(red[1]) == (None, None, None)
    assert lab == pytest.approx([53.24, 80.09, 67.20], abs=0.02) and colors.lab_of((255, 0, 0)) == pytest.approx(lab)


def test_cheats(spark):
    df = elements(
        spark,
        box(0, 0, 100, 100, text="x", font=4.0, hidden=True, r=250, g=250, b=250),
        box(3000, 0, 10, 10),
        box(200, 200, 100, 100, text="covered"),
        box(200, 200, 100, 100, fill=True),
        box(500, 500, 100, 100, fill=True),
        box(500, 500, 100, 100, br=9, bg=9, bb=9),
        box(1920, 700, 10, 10),
        box(700, 700, 100, 20, text="dark", r=9, g=9, b=9, br=12, bg=9, bb=9),
    )
    slides = spark.createDataFrame([(1, True, 255, 255, 255)], "slide_id long, texture boolean, sr int, sg int, sb int")
    found = sorted((r.kind, -1 if r.pos is None else r.pos, r.other) for r in layout.cheats(df, slides).collect())
    assert found == [("covering_overlay", 2, 3), ("covering_overlay", 4, 5), ("low_contrast", 0, None), ("low_contrast", 7, None), ("off_canvas", 1, None), ("overflow_hidden", 0, None), ("texture_background", -1, None), ("tiny_text", 0, None)]


def test_rendered_overflow_goes_down_and_right(spark):
    columns = "slide_id long, deck_id long, pos long, x double, y double, x1 double, y1 double, w double, h double, no_autofit boolean"
    at = lambda pos, x, y, w, h, fixed=False: (1, 1, pos, float(x), float(y), float(x + w), float(y + h), float(w), float(h), fixed)
    boxes = spark.createDataFrame([at(0, 100, 100, 200, 50), at(1, 100, 400, 200, 50), at(2, 500, 100, 100, 50, True), at(3, 900, 100, 100, 50)], columns)
    spans = spark.createDataFrame([(1, 110.0, 110.0, 290.0, 140.0), (1, 110.0, 160.0, 290.0, 190.0), (1, 110.0, 410.0, 250.0, 430.0), (1, 510.0, 110.0, 660.0, 130.0), (1, 910.0, 110.0, 1002.0, 130.0)], "slide_id long, x double, y double, x1 double, y1 double")
    over = {r.pos: (r.v_over, r.h_over) for r in layout.box_overflow(boxes, spans).collect()}
    assert over == {0: (40.0, 0.0), 1: (0.0, 0.0), 2: (0.0, 60.0), 3: (0.0, 2.0)}
    hits = {r.pos: (r.collides, r.hard) for r in layout.overflow_hits(boxes, spans).collect()}
    assert hits == {0: (False, False), 2: (False, True)}


def test_injected_defects_are_found_and_snapping_takes_them_away(spark):
    df = elements(spark, *[box(144, 180 + 90 * i, 800, 60, etype="text", text="bullet", align_group=1) for i in range(3)])
    moved = inject.alignment_offset(df, 40.0).first()
    assert (moved.pos, moved.x, moved.mode, moved.severity) == (1, 184, "internal", 40)
    bent = inject.applied(df, inject.alignment_offset(df, 40.0), "x")
    assert [(r.pos, r.severity) for r in layout.alignment_findings(bent).collect()] == [(1, 40.0)] and layout.alignment_findings(df).count() == 0
    two = elements(spark, box(100, 100, 200, 100), box(900, 100, 200, 100))
    hit = inject.overlap(two, 0.4).first()
    assert hit.x == 940 and hit.severity == pytest.approx(160 / 240)
    both = inject.applied(two, inject.overlap(two, 0.4), "x", "y")
    assert layout.overlapping(both).count() == 1
    assert layout.overlapping(simulate.snap_to_master(bent)).count() == 0

def test_terms(spark):
    lines = ["the Platform is saturated", "the Platform refresh is due", "the Platform ships weekly", "the PlatformX adoption is slow"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "deck string, slide int, text string")
    r = text.variants(text.occurrences(df)).collect()
    assert [(x.canonical, x.variant) for x in r] == [("the Platform", "the PlatformX")]
    assert text.variants(text.occurrences(df.where("slide < 3"))).count() == 0
    helpers = spark.createDataFrame([("d", i, t) for i, t in enumerate(["HelpBotX", "HelpBotX", "HelpBotX", "HelpBot"])], df.schema)
    glossary = spark.createDataFrame([("HelpBot",)], "term string")
    assert text.variants(text.occurrences(helpers), glossary).first().canonical == "HelpBot"


def test_suppression(spark):
    rows = [(1, 0, 10.0, 10.0, 100.0, 50.0, 0.9), (1, 1, 11.0, 11.0, 101.0, 51.0, 0.7), (1, 2, 10.0, 200.0, 100.0, 240.0, 0.8)]
    df = spark.createDataFrame(rows, "image long, ord long, x0 double, y0 double, x1 double, y1 double, score double")
    assert {r.ord for r in vision.suppress(df).collect()} == {0, 2}


def test_assignment_is_the_best():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 3), (6, 6)]:
        cost = rnd.normal(size=(n, m))
        got = vision.assign(cost)
        small, large = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))
        assert math.isclose(sum(cost[i, j] for i, j in got), best) and len(got) == min(n, m)


def test_afc(spark):
    rows = [("G1", "paired", a, b) for a, b in [("a", "b"), ("a", "b"), ("a", "a"), ("tie", "b"), (None, "a")]]
    r = judging.afc_metrics(spark.createDataFrame(rows, "defect string, mode string, pick0 string, pick1 string")).first()
    assert (r.judgements, r.probe, r.partner, r.ties) == (9, 6, 2, 1)
    assert r.strict == pytest.approx(2 / 3) and r.loose == pytest.approx(6 / 9) and r.pick_first == pytest.approx(5 / 8)


def test_attribution_takes_the_last_row(spark):
    probe = [(1, "s1", 0, "A", "T1", "G1", "G1"), (2, "s1", 0, "A", "T1", "G1", None), (3, "s1", 0, "B", "T1", "G1", "G1")]
    df = spark.createDataFrame([(*p, 16.0, "template", 512, None) for p in probe], "ord long, sample_id string, model int, raw_modality string, task string, expected string, predicted string, severity double, template string, resolution long, repaired boolean")
    r = judging.attribute_failures(judging.classify(df)).first()
    assert (r.perception_rate, r.reasoning_rate, r.image_success) == (1, 0, 0)
    assert judging.modality_gaps(judging.classify(df)).first().gap == 0.5
