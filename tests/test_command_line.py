from __future__ import annotations

import json

import pytest

from deckframe.__main__ import VERBS, main
from deckframe.sources import decks
from deckframe.sources.flat import elements_of, slides_of


def element(i, x, y, w, h, text="", kind="shape", style=None, **metadata):
    return {"element_id": i, "type": kind, "bbox": {"x": x, "y": y, "width": w, "height": h}, "text": text, "style": style or {}, "metadata": metadata}


SLIDE = {
    "slide_id": "s1",
    "metadata": {"background_color": "#ffffff", "texture_background": True, "section": "intro"},
    "elements": [
        element("title", 100, 80, 200, 40, "a title that is far too long", "title", {"text_box_capacity": 8, "font_size_pt": 24}),
        element("box1", 400, 200, 200, 100),
        element("box2", 450, 220, 200, 100, style={"fill_color": "#00ff00"}),
        element("aligned", 120, 340, 100, 80, expected_bbox={"x": 100, "y": 340, "width": 100, "height": 80}),
        element("edge", 8, 500, 100, 80),
        element("font_bad", 700, 500, 100, 80, style={"font_size": 32}, expected_font_size_pt=24),
        element("color_bad", 900, 500, 100, 80, style={"color": "#ff00ff"}, expected_color="000000"),
        element("faint", 900, 700, 300, 60, "pale", style={"color": "rgb(250, 250, 250)", "opacity": 0.1, "overflow": "Hidden"}),
    ],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "decks").mkdir()
    (tmp_path / "decks" / "one.json").write_text(json.dumps(SLIDE))
    (tmp_path / "decks" / "two.json").write_text(json.dumps({"deck_id": "d", "slides": [{**SLIDE, "slide_id": f"p{i}"} for i in range(2)]}))
    rows = [{"sample_id": "s", "model": "m", "modality": m, "task": "T1", "labels": [{"type": "G1", "severity": 4}], "output": {"defects": [{"type": "G1"}] if m == "B" else []}} for m in "AB"]
    (tmp_path / "probe.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "manifest.jsonl").write_text(json.dumps({"sample_id": "x", "labels": [{"type": "G2", "severity": 0.3, "target_element_ids": ["a", "b"], "metadata": {"iou": "0.3"}}]}) + "\n")
    return tmp_path


def run(spark, tmp_path, *args):
    out = tmp_path / f"out-{args[0]}"
    assert main([*map(str, args), "--out", str(out)], spark) == 0
    return spark.read.json(str(out)).collect()


def test_nested_elements_become_columns(spark, folder):
    d = decks(spark, str(folder / "decks"))
    e = {r.element_id: r for r in elements_of(d).where("slide_id = 'one/s1'").collect()}
    assert e["title"].capacity == 8 and e["title"].font == 24 and e["aligned"].expected_x == 100 and e["font_bad"].font == 32 and e["font_bad"].expected_font == 24
    assert (e["color_bad"].r, e["color_bad"].g, e["color_bad"].b, e["color_bad"].er) == (255, 0, 255, 0) and e["box2"].fill and not e["box1"].fill
    assert e["faint"].hidden and e["faint"].opacity == 0.1 and e["box1"].opacity == 1.0 and e["box1"].r is None
    s = {r.slide_id: r for r in slides_of(d).collect()}
    assert set(s) == {"one/s1", "d/p0", "d/p1"} and s["d/p1"].slide_index == 1 and s["one/s1"].texture and s["one/s1"].section == "intro" and s["one/s1"].sr == 255


def test_lint_of_files(spark, folder):
    rows = run(spark, folder, "lint", folder / "decks")
    one = {(r.detector, r.element_id): r.severity for r in rows if r.slide_id == "one/s1"}
    assert set(one) == {("overflow", "title"), ("overlap", "box1"), ("alignment", "aligned"), ("margin", "edge"), ("font", "font_bad"), ("palette", "color_bad")}
    assert one["alignment", "aligned"] == 20 and one["margin", "edge"] == 24 and len(rows) == 18
    cheats = {r.kind for r in run(spark, folder, "hacking-audit", folder / "decks")}
    assert cheats == {"overflow_hidden", "faint_text", "low_contrast", "texture_background"}


def test_other_verbs(spark, folder):
    assert [r.gap for r in run(spark, folder, "gaps", folder / "probe.jsonl")] == [1.0]
    assert [r.perception for r in run(spark, folder, "attribution", folder / "probe.jsonl")] == [1]
    assert run(spark, folder, "summary", folder / "probe.jsonl")[0].records == 2
    assert run(spark, folder, "build-sft", folder / "manifest.jsonl")[0].findings[0].evidence == "Elements a, b visibly overlap on the page with IoU 0.3."
    assert run(spark, folder, "power", "0.5", "0.7")[0].samples == 93
    assert len(run(spark, folder, "matrix", "m1,m2", "A,B", "T1", "512", "1,2")) == 8
    assert {r.type for r in run(spark, folder, "inject", folder / "decks", "--type", "G1", "G6")} == {"G1", "G6"}
    assert len(run(spark, folder, "repair", folder / "decks")) == 24
    assert run(spark, folder, "prepare-clean-corpus", folder / "decks") == []
    assert {"lint", "lint-deck", "repair", "analyze", "panel", "matrix", "query"} <= set(VERBS)


def test_query_and_output(spark, folder, capsys):
    assert main(["query", "yes_no", "/root/testdata/sf0.001"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1500
