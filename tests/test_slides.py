from __future__ import annotations

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from deckframe.operators import manifests
from deckframe.sources import corpus_files, html_elements, listed, pptx_outline, pptx_shapes

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def shape(i, text="", place=(0, 0, 1270000, 635000), role=None, size=None, color=None, fill=None, fit=None):
    ph = f'<p:nvPr><p:ph type="{role}"/></p:nvPr>' if role else "<p:nvPr/>"
    xfrm = f'<a:xfrm><a:off x="{place[0]}" y="{place[1]}"/><a:ext cx="{place[2]}" cy="{place[3]}"/></a:xfrm>' if place else ""
    solid = f'<a:solidFill><a:srgbClr val="{fill}"/></a:solidFill>' if fill else ""
    run = f'<a:rPr{f" sz={chr(34)}{size}{chr(34)}" if size else ""}>{f"<a:solidFill><a:srgbClr val={chr(34)}{color}{chr(34)}/></a:solidFill>" if color else ""}</a:rPr>'
    paragraphs = "".join(f"<a:p><a:r>{run}<a:t>{t}</a:t></a:r></a:p>" for t in text.split("|")) if text else "<a:p/>"
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="shape {i}"/><p:cNvSpPr/>{ph}</p:nvSpPr><p:spPr>{xfrm}{solid}</p:spPr><p:txBody><a:bodyPr>{f"<a:{fit}/>" if fit else ""}</a:bodyPr>{paragraphs}</p:txBody></p:sp>'


TABLE = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="t"/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="0"/><a:ext cx="914400" cy="914400"/></p:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>hi &amp; ho</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>there</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
PICTURE = '<p:pic><p:nvPicPr><p:cNvPr id="10" name="p"/></p:nvPicPr><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="914400" cy="0"/></a:xfrm></p:spPr></p:pic>'


def deck(path, *slides, size=(12700000, 7143750)):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldSz cx="{size[0]}" cy="{size[1]}"/></p:presentation>')
        for i, shapes in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {NS}><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{''.join(shapes)}</p:spTree></p:cSld></p:sld>")


@pytest.fixture
def folder(tmp_path):
    many = [[shape(1, f"slide {i}")] for i in range(11)]
    many[1] = [shape(2, "Head", role="title", size=3400, color="112233"), shape(3, "a|b", (1270000, 714375, 2540000, 1428750), fill="FF0000", fit="noAutofit"), shape(4, place=None), TABLE, PICTURE, f"<p:grpSp><p:nvGrpSpPr><p:cNvPr id='11' name='g'/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x='0' y='0'/><a:ext cx='10' cy='10'/></a:xfrm></p:grpSpPr>{shape(12, 'in')}{shape(13, 'side')}</p:grpSp>"]
    (tmp_path / "sub").mkdir()
    deck(tmp_path / "sub" / "d.PPTX", *many)
    (tmp_path / "bad.pptx").write_bytes(b"no archive")
    (tmp_path / "x.txt").write_text("not a deck")
    (tmp_path / "y.json").write_text("{}")
    return str(tmp_path)


def test_shapes_with_places(spark, folder):
    files = corpus_files(spark, folder, (".pptx",))
    rows = pptx_shapes(files).collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"d.PPTX"}
    second = {r.shape_id: r for r in rows if r.slide_index == 1}
    assert (second[3].x, second[3].y, second[3].w, second[3].h) == (192.0, 108.0, 384.0, 216.0)
    assert [second[i].kind for i in (2, 3, 4, 9, 10, 11)] == ["title", "body", "shape", "table", "image", "group"]
    assert second[3].text == "a\nb" and second[9].text == "hi & ho | there" and second[11].text == "in\nside"
    assert (second[2].font, second[2].color, second[3].fill, second[3].autofit, second[4].x) == (34.0, "#112233", "#FF0000", "NONE", None)
    assert [r.text for r in sorted(rows, key=lambda r: r.slide_index) if r.slide_index > 8] == ["slide 9", "slide 10"]
    inches = {r.shape_id: r for r in pptx_shapes(files, None).collect() if r.slide_index == 1}
    assert set(inches) == {2, 3, 9, 11} and inches[9].w == 96.0


def test_outline_has_runs_only(spark, folder):
    texts = [r.text for r in pptx_outline(corpus_files(spark, folder + "/sub", (".pptx",))).where("slide_index = 3").orderBy("pos").collect()]
    assert texts == ["Head", "a", "b", "hi & ho", "there", "in", "side"]


def test_listing(spark, folder):
    rows = listed(corpus_files(spark, folder)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["bad.pptx", "d.PPTX", "y.json"]
    assert rows[0].sha256 == hashlib.sha256(b"no archive").hexdigest()
    assert [r.length for r in listed(corpus_files(spark, folder, max_bytes=20), "length").collect()] == [2, 10]


def test_html_takes_places_from_style(spark):
    html = '<div id="a" data-x="12%" style="top: 7px; width:30px; height:2em">t</div><p id="b" data-x="3" data-y="4px">u</p><p id="c">no</p>'
    rows = html_elements(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r.element_id, r.x, r.y, r.width, r.height) for r in rows] == [("a", None, 7.0, 30.0, None), ("b", 3.0, 4.0, 0.0, 0.0)]


def test_structures(spark):
    rows = ['{"b": 1, "a": [2]}', "{'x': (1, None)}", "[1]", "3", "{broken", "", None, "__import__('os')"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(manifests.structure(F.col("s")).alias("v")).select("v.*").collect()
    assert [(r.value, r.error) for r in got] == [('{"a": [2], "b": 1}', None), ('{"x": [1, null]}', None), (None, "Expected dict structure, got list"), (None, "Expected dict structure, got int"), (None, "SyntaxError"), (None, None), (None, None), (None, "ValueError")]


def test_changes_that_labels_claim(spark):
    one = lambda kind, offset, x1, text1="t", colour1="#0": (kind, offset, 0.0, 0.0, 9.0, 9.0, "t", "#0", x1, 0.0, 9.0, 9.0, text1, colour1)
    names = "x y w h text colour".split()
    df = spark.createDataFrame([one("G3", 16.0, 16.4), one("G3", 16.0, 17.0), one("G5", None, 0.0, colour1="#1"), one("G5", None, 5.0), one("G6", None, 1.0), one("S1", None, 0.0, "u"), one("S1", None, 0.0)], "kind string, offset double, " + ", ".join(f"{n}{i} {'double' if n in 'xywh' else 'string'}" for i in (0, 1) for n in names))
    got = [(r.present, r.changed) for r in manifests.changed_as_labelled(df).collect()]
    assert got == [(True, "bbox"), (False, "bbox"), (True, "style"), (False, "bbox"), (True, "bbox"), (True, "text"), (False, "")]


def test_report(spark):
    text = manifests.report("Run", {"Cells": spark.createDataFrame([(10, 0.5), (9, None)], "n int, rate double")})
    assert text.splitlines() == ["# Run", "", "## Cells", "", "| n | rate |", "|---|---|", "| 10 | 0.500 |", "| 9 |  |"]
