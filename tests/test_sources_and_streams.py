from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deckframe import sources
from deckframe.functions.recover import first_object, recover_json
from deckframe.operators import contract
from deckframe.streaming import twins


def test_html(spark):
    html = '<div id="a" data-x="10px" data-y="2" data-width="30" data-height="4" data-meta-role="title" style="color: red; x: 1"><b>Hi</b><br> there</div><p>no</p><img id="i" data-x="5"><p data-x="1">no id</p>'
    df = spark.createDataFrame([(1, html), (2, None)], "page long, html string")
    a, i = sources.html_elements(df).orderBy("pos").collect()
    assert (a.element_id, a.x, a.y, a.width, a.text, a.style["color"], a.metadata) == ("a", 10, 2, 30, "Hi there", "red", {"role": "title"})
    assert (i.element_id, i.type, i.text) == ("i", "img", "")


def test_pptx_slides_are_in_order_of_names_as_text(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p><a:t>s{n} &amp; more</a:t><a:t>second</a:t></p>")
    df = spark.createDataFrame([("f.pptx", bytearray(data.getvalue()))], "path string, content binary")
    rows = sources.pptx_outline(df).orderBy("slide_index", "pos").collect()
    assert [r.text for r in rows if r.pos == 0] == ["s1 & more", "s10 & more", "s2 & more"] and rows[1].y == 168


def test_arrow_files_and_streams(spark, tmp_path):
    table = pa.table({"a": [1, 2, 3], "b": ["x", "y", None], "c": [0.1, 0.2, 0.3]})
    with pa.OSFile(f"{tmp_path}/one.arrow", "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(f"{tmp_path}/two.arrow", "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert sorted(tuple(r) for r in sources.arrow_rows(spark, str(tmp_path), "a long, b string").na.fill("-").collect()) == [(1, "x")] * 2 + [(2, "y")] * 2 + [(3, "-")] * 2


def test_decks_and_slides(spark, tmp_path):
    slide = {"slide_id": "s", "elements": [{"element_id": "e", "type": "text", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}, "text": "t"}]}
    (tmp_path / "whole.json").write_text(json.dumps({"deck_id": "d", "slides": [slide, {**slide, "slide_id": "s2", "width": 960}]}))
    (tmp_path / "alone.json").write_text(json.dumps(slide))
    rows = sources.decks(spark, str(tmp_path)).orderBy("deck_id", "slide_index").collect()
    assert [(r.deck_id, r.slide_index, r.slide_id, r.width) for r in rows] == [("alone", 0, "s", 1920), ("d", 0, "s", 1920), ("d", 1, "s2", 960)]
    assert rows[0].elements[0].bbox.width == 3


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", [1, 2]), (2, None, None)], "b long, a string, c array<int>")
    sources.write_json_lines(df, f"{tmp_path}/out")
    line = next(x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines() if "ä" in x)
    assert list(json.loads(line)) == ["a", "b", "c"]
    assert sources.json_lines(spark, f"{tmp_path}/out", "b long, a string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\nnot json\n')
    loose = sources.json_lines(spark, f"{tmp_path}/bad.jsonl", "b long, _corrupt_record string", strict=False)
    assert {r._corrupt_record for r in loose.collect()} == {None, "not json"}
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.json_lines(spark, f"{tmp_path}/bad.jsonl", "b long").collect()
    sources.write_csv(df, f"{tmp_path}/csv", ("c",))
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[0] == "c,b,a"


def test_json_out_of_text(spark):
    cases = {'x ```json\n{"b": 1, "a": {"c": "}"}}\n``` y': '{"a":{"c":"}"},"b":1}', 'so {bad} {"k": [1]} end': '{"k":[1]}', "[1, 2]": None, "": None}
    assert {k: first_object(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert [r[0] for r in df.select(recover_json(F.col("t"))).collect()] == [*cases.values(), None]


def test_contract(spark):
    df = spark.createDataFrame([("G1", 8.0, None), ("G1", 9.0, None), ("G2", 0.3, None), ("S1", 1.0, None), ("G6", 1.0, "severe")], "k string, s double, given string")
    assert [r[0] for r in df.select(contract.severity_level(F.col("k"), F.col("s"), F.col("given"))).collect()] == ["minor", "moderate", "severe", "moderate", "severe"]
    assert spark.range(1).select(contract.score(F.array(F.lit("minor"), F.lit("severe"), F.lit("odd")))).first()[0] == pytest.approx(0.2)
    with pytest.raises(Exception, match="unknown modality"):
        spark.createDataFrame([("Z",)], "m string").select(contract.modality(F.col("m"), strict=True)).collect()


def test_streams_match_batch(spark, tmp_path):
    events = spark.read.schema(twins.EVENTS).parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(400)
    events.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/events")
    stream = twins.event_stream(spark, f"{tmp_path}/events")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp"))
    got = twins.drain(twins.windowed_counts(stream, late="365 days"), spark, "w1", "complete")
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(twins.windowed_counts(batch))
    best = {r.user_id: (r.n, r.best) for r in twins.drain(twins.running_best(stream), spark, "w2", "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("best").alias("best")).collect()}
    want = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.max(F.least(F.col("value") / 200, F.lit(1.0)))).alias("best")).collect()
    assert best == {r.user_id: (r.n, r.best) for r in want}
    once = twins.drain(twins.first_events(stream, late="365 days"), spark, "w3", "append")
    assert once.count() == batch.select("event_id").distinct().count()
