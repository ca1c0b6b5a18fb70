"""Shapes with their places out of PPTX archives, and listings of corpus files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespaces of the format, and pixels of an inch and of English metric units.
_A, _P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
EMU_A_PIXEL = 914400 / 96
DEFAULT_SIZE = (12192000, 6858000)
SUFFIXES = (".json", ".html", ".pptx")
MAX_DECK_BYTES = 25_000_000

_FIELDS = [("slide_index", pa.int32()), ("shape_index", pa.int32()), ("shape_id", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("role", pa.string()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64()), ("h", pa.float64()), ("font", pa.float64()), ("color", pa.string()), ("fill", pa.string()), ("autofit", pa.string())]
_SHAPE = ", ".join(f"{n} {'int' if t == pa.int32() else 'long' if t == pa.int64() else 'double' if t == pa.float64() else 'string'}" for n, t in _FIELDS)


def _text(node: ElementTree.Element) -> str:
    """Paragraphs of a shape below each other; of a table rows, cells between bars; of a group its members'."""
    if node.tag == f"{_P}grpSp":
        return "\n".join(t for t in (_text(c) for c in node if c.tag in _SHAPES) if t).strip()
    rows = node.findall(f".//{_A}tbl/{_A}tr")
    if rows:
        return "\n".join(" | ".join(_paragraphs(c) for c in row.findall(f"{_A}tc")) for row in rows).strip()
    body = node.find(f"{_P}txBody")
    return _paragraphs(body).strip() if body is not None else ""


def _paragraphs(node: ElementTree.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in node.iter(f"{_A}p"))


_SHAPES = frozenset(f"{_P}{n}" for n in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp"))


def _kind(node: ElementTree.Element, role: str | None, text: str) -> str:
    if node.tag == f"{_P}grpSp":
        return "group"
    if role is not None:
        return "subtitle" if "sub" in role.lower() else "title" if "title" in role.lower() else "body"
    if node.tag == f"{_P}pic":
        return "image"
    uri = node.find(f".//{_A}graphicData")
    if uri is not None:
        return "table" if uri.get("uri", "").endswith("/table") else "chart" if uri.get("uri", "").endswith("/chart") else "shape"
    return "body" if text else "shape"


def _hex(node: ElementTree.Element | None) -> str | None:
    found = node.find(f"{_A}solidFill/{_A}srgbClr") if node is not None else None
    return f"#{found.get('val')}" if found is not None else None


def _shape(node: ElementTree.Element, slide: int, index: int) -> dict | None:
    """One shape in English metric units; a shape without a place of its own has nulls."""
    props = next((p for p in node.iter() if p.tag in (f"{_P}cNvPr",)), None)
    holder = node.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
    role = None if holder is None else holder.get("type", "body")
    frame = node.find(f"{_P}xfrm") if node.tag == f"{_P}graphicFrame" else node.find(f"{_P}grpSpPr/{_A}xfrm") if node.tag == f"{_P}grpSp" else node.find(f"{_P}spPr/{_A}xfrm")
    place = [None] * 4
    if frame is not None and frame.find(f"{_A}off") is not None and frame.find(f"{_A}ext") is not None:
        off, ext = frame.find(f"{_A}off"), frame.find(f"{_A}ext")
        place = [float(off.get("x", 0)), float(off.get("y", 0)), float(ext.get("cx", 0)), float(ext.get("cy", 0))]
    text = _text(node)
    runs = list(node.iter(f"{_A}rPr")) + list(node.iter(f"{_A}defRPr"))
    font = next((int(r.get("sz")) / 100 for r in runs if r.get("sz")), None)
    body = node.find(f"{_P}txBody/{_A}bodyPr")
    fits = None if body is None else next((n for n, t in (("NONE", "noAutofit"), ("SHAPE_TO_FIT_TEXT", "spAutoFit"), ("TEXT_TO_FIT_SHAPE", "normAutofit")) if body.find(f"{_A}{t}") is not None), None)
    values = [slide, index, int(props.get("id", 0)) if props is not None else None, props.get("name") if props is not None else None, _kind(node, role, text), role, text, *place, font, next((h for h in map(_hex, runs) if h), None), _hex(node.find(f"{_P}spPr")), fits]
    return dict(zip((n for n, _ in _FIELDS), values, strict=True))


def read_shapes(content: bytes) -> tuple[int, int, list[dict]]:
    """Width, height and top-level shapes of a PPTX archive, slides in the order of their numbers; no shapes if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            size = re.search(rb"<p:sldSz[^>]*?cx=\"(\d+)\"[^>]*?cy=\"(\d+)\"", z.read("ppt/presentation.xml")) if "ppt/presentation.xml" in z.namelist() else None
            names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
            out = []
            for i, name in enumerate(names):
                tree = ElementTree.fromstring(z.read(name)).find(f"{_P}cSld/{_P}spTree")
                out += [_shape(node, i, j) for j, node in enumerate(c for c in (tree if tree is not None else ()) if c.tag in _SHAPES)]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return (*DEFAULT_SIZE, [])
    return (int(size[1]), int(size[2]), out) if size else (*DEFAULT_SIZE, out)


def pptx_shapes(files: DataFrame, frame: tuple[float, float] | None = (1920.0, 1080.0)) -> DataFrame:
    """Of binary files (path, content): a row for each shape, in a frame of that size, or at 96 dots an inch without one.

    Shapes without a place or of no size are left out where there is no frame, and stay with nulls or zeros in one.
    """
    kind = pa.list_(pa.struct(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            decks = [read_shapes(c.as_py() or b"") for c in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([d[0] for d in decks], pa.int64()), pa.array([d[1] for d in decks], pa.int64()), pa.array([d[2] for d in decks], kind)], ["path", "deck_w", "deck_h", "shapes"])

    fields = ", ".join(f.replace(" ", ":", 1) for f in _SHAPE.split(", "))
    df = files.select("path", "content").mapInArrow(run, f"path string, deck_w long, deck_h long, shapes array<struct<{fields}>>")
    df = df.select("path", "deck_w", "deck_h", F.explode("shapes").alias("s")).select("path", "deck_w", "deck_h", "s.*")
    across = F.lit(1 / EMU_A_PIXEL) if frame is None else frame[0] / F.col("deck_w")
    down = F.lit(1 / EMU_A_PIXEL) if frame is None else frame[1] / F.col("deck_h")
    df = df.withColumns({"x": F.col("x") * across, "y": F.col("y") * down, "w": F.col("w") * across, "h": F.col("h") * down})
    return (df.where("w > 0 and h > 0") if frame is None else df).drop("deck_w", "deck_h")


def corpus_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, max_bytes: int | None = None) -> DataFrame:
    """path, length and content of the files of a folder and those below it whose names end so, in any case, that are not too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
    files = files.where(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    return files if max_bytes is None else files.where(F.col("length") <= max_bytes)


def listed(files: DataFrame, by: str = "path") -> DataFrame:
    """path, length and sha256 of files, in the order of their paths or sizes."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy(by, "path")
