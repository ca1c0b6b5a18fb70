from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from deckframe.functions import texts
from deckframe.operators import exams, judging, records


def facts(spark, *rows):
    return records.classified(spark.createDataFrame([(i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(rows)], "ord long, record string"))


def test_records_from_any_place(spark):
    g1 = {"type": "G1", "severity": 16}
    got = facts(
        spark,
        {"sample_id": "s1", "model": "m", "modality": "Bprime", "task": "T1", "labels": [g1], "output": {"defects": [{"type": "G1"}, {"type": "G2", "present": False}, {}]}},
        {"sample_id": "s1", "adapter": "a", "payload": {"modality": "A", "task": "T1", "expected_labels": [g1], "metadata": {"resolution": 512}}, "parsed": {"findings": [{"type": "G1", "severity": "severe"}, {"type": "G3"}]}},
        {"labels": [], "payload": {"expected_labels": [g1]}, "label_types": ["G5"], "output": {"defects": []}},
        {"label_types": ["G5", "NO_DEFECT"], "modality": "odd", "severity": 3, "metadata": {"severity_grid_value": 4, "template_condition": "template"}, "output": {"defects": [{"type": "G5", "severity": "moderate"}, {"type": "G4", "severity": "bad"}], "overall_score": 0.3}},
        "no json",
    ).orderBy("ord").collect()
    assert [r.modality for r in got] == ["B_prime", "A", "", "odd", ""]
    assert [r.model for r in got] == ["m", "a", None, None, None]
    assert [r.expected_types for r in got] == [["G1"], ["G1"], [], ["G5"], []]
    assert [r.predicted_types for r in got] == [["G1"], ["G1", "G3"], [], ["G5", "G4"], []]
    assert [r.correct for r in got] == [True, True, True, True, True]
    assert [r.severity for r in got] == [16, 16, None, 3, None] and [r.grid for r in got] == [16, 16, None, 4, None]
    assert [r.score for r in got] == [0.0, pytest.approx(1 - 0.2 * 5 if 1 - 0.2 * 5 > 0 else 0), 1.0, 0.3, None]
    assert got[1].resolution == 512 and got[3].template == "template"


def test_perception_and_gap(spark):
    row = lambda m, hit: {"sample_id": "s1", "model": "m", "modality": m, "task": "T1", "template_condition": "template", "labels": [{"type": "G1", "severity": 16}], "output": {"defects": [{"type": "G1"}] if hit else []}}
    df = facts(spark, row("A", False), row("B", True), row("Bprime", True))
    a = judging.attribute_failures(df).first()
    assert (a.n, a.perception_rate, a.reasoning_rate) == (1, 1.0, 0.0)
    assert judging.modality_gaps(df).first().gap == 1.0 and judging.modality_gaps(df, "A", "B_prime").first().gap == 1.0
    clean = facts(spark, {"labels": [{"type": "NO_DEFECT"}], "output": {"defects": []}}).first()
    assert clean.expected_types == [] and clean.correct


def test_thresholds(spark):
    row = lambda sev, hit, task="T1": {"sample_id": "s", "model": "m", "modality": "A", "task": task, "labels": [{"type": "G1", "severity": sev}], "output": {"defects": [{"type": "G1"}] if hit else []}}
    df = facts(spark, row(4, False), row(8, True), row(16, True), row(2, True, "T2"))
    assert {(r.task, r.threshold, r.n_bins) for r in judging.psychometric(df).collect()} == {("T1", 8.0, 3), ("T2", 2.0, 1)}


def test_ground_truth_is_hidden(spark):
    hidden = {k: "x" for k in records.HIDDEN_IN_ELEMENTS}
    deck = {"deck_id": "d", "metadata": {**{k: "x" for k in records.HIDDEN_IN_CONTAINERS}, "topic": "t"}, "slides": [{"slide_id": "s", "metadata": {"missing_section": "x", "max_words": "kept"}, "elements": [{"element_id": "e", "type": "text", "text": "expected_color", "metadata": {**hidden, "role": "body"}}]}]}
    df = spark.createDataFrame([(json.dumps(deck), json.dumps(deck["slides"][0]))], "deck string, slide string")
    out = df.select(F.to_json(records.model_view(F.from_json("deck", records.DECK))), F.to_json(records.model_view(F.from_json("slide", records.SLIDE), "slide")), "deck").first()
    seen = json.loads(out[0])
    assert seen["metadata"] == {"topic": "t"} and seen["slides"][0]["metadata"] == {"max_words": "kept"}
    assert seen["slides"][0]["elements"][0] == {"element_id": "e", "type": "text", "text": "expected_color", "metadata": {"role": "body"}}
    assert json.loads(out[1]) == seen["slides"][0] and json.loads(out[2]) == deck


def labels(spark, *rows):
    return spark.createDataFrame([(*r[:4], r[4] if len(r) > 4 else {}) for r in rows], "sample_id long, type string, severity double, targets array<string>, meta map<string,string>")


def test_results_say_what_is_clean(spark):
    df = labels(spark, (1, "G1", 40.0, ["t"], {"overflow_px": "40"}), (1, "S2", 1.0, ["p1", "p2"], {"swapped_indices": "[0, 1]"}), (2, "NO_DEFECT", 0.0, []))
    page = {r.sample_id: r for r in exams.valid(exams.results(df)).collect()}
    assert page[1].has_defect and "text_fit" not in page[1].clean_dimensions and len(page[1].clean_dimensions) == 8 and page[1].valid
    assert not page[2].has_defect and page[2].clean_dimensions == [exams.DIMENSIONS[t] for t in exams.PAGE_TYPES]
    deck = {r.sample_id: r for r in exams.results(df, "deck").collect()}
    assert deck[1].clean_dimensions == ["terminology", "missing_section"]
    f = {r.type: r for r in exams.findings(df).collect()}
    assert f["G1"].severity == "severe" and f["G1"].element_id == "t" and f["G1"].evidence == "Element t text overflows its bounding box by 40 px on the page."
    assert f["S2"].related == ["p1", "p2"] and f["S2"].element_id is None


def test_levels_of_density(spark):
    rows = [(1, "S4", s, [], m) for s, m in ((60.0, {}), (73.0, {}), (95.0, {}), (60.0, {"max_words": "30"}), (60.0, {"severity_level": "minor"}), (60.0, {"max_words": "0"}))]
    assert [r.severity for r in exams.findings(labels(spark, *rows)).collect()] == ["minor", "moderate", "severe", "severe", "minor", "minor"]


def test_modalities_by_quota(spark):
    rows = [(i, "page" if i < 60 else "deck", i % 3 > 0) for i in range(80)]
    df = spark.createDataFrame(rows, "ord long, level string, has_image boolean")
    want, image = {}, dict((r[0], r[2]) for r in rows)
    for level, n in (("page", 60), ("deck", 20)):
        first = [r[0] for r in rows if r[1] == level and r[2]][: -(-n * 3 // 10)]
        want |= dict.fromkeys(first, "A")
    rest = [r[0] for r in rows if r[0] not in want]
    quota = min(sum(image[i] for i in rest), round(len(rest) * 0.5))
    for i in rest:
        c = image[i] and sum(v == "C" for v in want.values()) < quota
        want[i] = "C" if c else "B"
    assert {r.ord: r.modality for r in exams.assign_modalities(df).collect()} == want
    with pytest.raises(ValueError, match="needs 18"):
        exams.assign_modalities(df.where("not has_image or level = 'deck'").withColumn("level", F.lit("page")).unionByName(df.where("not has_image")))
    with pytest.raises(ValueError, match="shares"):
        exams.assign_modalities(df, 1.5)


def test_training_records_read_back(spark):
    df = labels(spark, (1, "G1", 4.0, ["t"]), (2, "NO_DEFECT", 0.0, []))
    samples = spark.createDataFrame([(1, "C", "page", "a.png", "b.png", "say <image>"), (2, "B", "deck", None, "c.png", "x")], "sample_id long, modality string, level string, image string, clean_image string, instruction string")
    r = exams.results(df)
    point = {x.sample_id: x for x in exams.parsed_answers(exams.training_records(samples, r)).collect()}
    assert point[1].images == ["a.png"] and point[1].types == ["G1"] and point[2].images == [] and point[2].exam_level == "DeckExamResult" and point[2].parsed == "result"
    pairs = {x.sample_id: json.loads(x.answer)["better"] for x in exams.training_records(samples, r, "pairwise").collect()}
    assert pairs == {1: "A", 2: "tie"}
    chat = exams.shared_chat(exams.training_records(samples, r)).collect()
    assert [(x.sample_id, x.messages[0].content) for x in chat] == [(1, "say <image>")]
    assert exams.dataset_entry("d", "f.jsonl")["d"]["formatting"] == "sharegpt"


def test_numbers_and_quotes(spark):
    values = [0.0, 1.0, 0.5, 12.345, 1234.5, 99.96, 0.00012345, 0.000012345, -3.14159, 1e7, 123456.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", texts.general(F.col("v"), 3).alias("a"), texts.general(F.col("v")).alias("b"))
    assert all((r.a, r.b) == (f"{r.v:.3g}", f"{r.v:g}") for r in df.collect())
    words = ["plain", "it's", 'say "x"', "it's \"both\"", "a\nb", "back\\slash", None]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(texts.quoted(F.col("w"))).collect()] == [repr(w) for w in words]


def test_scores_and_picks(spark):
    rows = [('{"score": 55}', 55), ("```json\n{\"score\": 120}\n```", 100), ("score = -4", 0), ("about 73 or so", 73), ("", None), (None, None), ('{"score": null} 7', 7)]
    got = spark.createDataFrame([(r,) for r, _ in rows], "r string").select(texts.score(F.col("r"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]
    assert [r[0] for r in spark.createDataFrame([("deck-12.png",), ("deck-3.jpg",), (None,)], "p string").select(texts.page_number(F.col("p"))).collect()] == [12, 0, 0]
