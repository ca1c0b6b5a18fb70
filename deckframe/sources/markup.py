"""Elements out of annotated HTML and texts out of PPTX archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_KIND = pa.list_(pa.struct([("element_id", pa.string()), ("type", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("width", pa.float64()), ("height", pa.float64()), ("text", pa.string()), ("style", pa.map_(pa.string(), pa.string())), ("metadata", pa.map_(pa.string(), pa.string()))]))


#: A text run, and no longer name that begins alike.
_RUN = re.compile(r"<a:t(?:\s[^>]*)?>(.*?)</a:t>", re.DOTALL)


def css(style: str | None) -> dict[str, str]:
    pairs = (p.split(":", 1) for p in (style or "").split(";") if ":" in p)
    return {k.strip(): v.strip() for k, v in pairs}


def number(text: str | None) -> float | None:
    """A length in pixels; null if it is none."""
    try:
        return float(re.sub(r"px$", "", (text or "").strip()))
    except ValueError:
        return None


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict] = []
        self.open: list[dict | None] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        element = None
        name = a.get("data-element-id") or a.get("id")
        if "data-x" in a and name:
            style = css(a.get("style"))
            of = lambda key, fallback: number(a[key] if key in a else style.get(fallback, "0"))
            element = {"element_id": name, "type": a.get("data-type") or tag, "x": of("data-x", "left"), "y": of("data-y", "top"), "width": of("data-width", "width"), "height": of("data-height", "height"), "text": "", "style": style, "metadata": {k[10:]: v or "" for k, v in a.items() if k.startswith("data-meta-")}}
            self.found.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _VOID and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        holder = next((e for e in reversed(self.open) if e is not None), None)
        if holder is not None and data.strip():
            holder["text"] = f"{holder['text']} {data.strip()}".strip()


def read_html(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.found


def html_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but ``html``, and one row for each annotated element: pos and its fields."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([read_html(x.as_py()) for x in b.column(html)], _KIND)], [*keep, "_elements"])

    fields = "element_id:string,type:string,x:double,y:double,width:double,height:double,text:string,style:map<string,string>,metadata:map<string,string>"
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html]
    df = pages.select(*keep, html).mapInArrow(run, ", ".join([*kinds, f"_elements array<struct<{fields}>>"]))
    return df.select(*keep, F.posexplode("_elements").alias("pos", "e")).select(*keep, "pos", "e.*")


def read_pptx(content: bytes) -> list[list[str]]:
    """The texts of each slide of a PPTX archive; slides in the order of their names as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
        return [[unescape(re.sub(r"<.*?>", "", t, flags=re.DOTALL)) for t in _RUN.findall(z.read(n).decode("utf-8", "replace"))] for n in names]


def pptx_outline(files: DataFrame) -> DataFrame:
    """Of binary files (path, content): path, slide_index, pos, text and a box for it, a line every 72 pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slides = [read_pptx(c.as_py()) for c in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(slides, pa.list_(pa.list_(pa.string())))], ["path", "slides"])

    df = files.select("path", "content").mapInArrow(run, "path string, slides array<array<string>>")
    df = df.select("path", F.posexplode("slides").alias("slide_index", "texts")).select("path", "slide_index", F.posexplode("texts").alias("pos", "text"))
    return df.select("*", F.lit(96.0).alias("x"), (96.0 + 72.0 * F.col("pos")).alias("y"), F.lit(1728.0).alias("width"), F.lit(56.0).alias("height"))
