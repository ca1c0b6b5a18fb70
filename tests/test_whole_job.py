from __future__ import annotations

import re
from html import unescape

from pyspark.sql import functions as F

from deckframe.operators import simulate
from deckframe.queries import QUERIES
from deckframe.sources.markup import _VOID

SMALL = "/root/testdata/sf0.001"
ANNOTATED = frozenset("div p h1 h2 h3 h4 h5 h6 li a td article section".split())


def test_unique_ids_stay_unique_beyond_999(spark):
    df = spark.range(1, 12346).select(F.col("id").alias("ord"), F.lit("a").alias("base"))
    got = {r.ord: r.unique_id for r in simulate.unique_ids(df).collect()}
    assert got == {i: "a" if i == 1 else f"a_{i:03d}" for i in range(1, 12346)} and len(set(got.values())) == 12345


def brute_elements(html):
    """(type, text) of each annotated element of a page, by passing over its tags."""
    out, opened = [], []
    tokens = re.split(r"(?is)(<!--.*?-->|<!.*?>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>)", html or "")
    for token in tokens:
        if token.startswith("<!"):
            continue
        whole = re.match(r"(?is)<(script|style)\b[^>]*>(.*)</", token)
        data = whole[2] if whole else None if re.match(r"</?[a-zA-Z]", token) else unescape(token)
        if data is not None:
            holder = next((e for e in reversed(opened) if e), None)
            if holder and data.strip():
                holder[1] = f"{holder[1]} {data.strip()}".strip()
        elif token.startswith("</"):
            if token[2:-1].strip().lower() not in _VOID and opened:
                opened.pop()
        else:
            tag = re.match(r"<([^\s/>]+)", token)[1].lower()
            element = [tag, ""] if tag in ANNOTATED else None
            if element:
                out.append(element)
            if tag not in _VOID:
                opened.append(element)
    return [tuple(e) for e in out]


def test_whole_pages_are_read(spark):
    got = {}
    for r in QUERIES["html_page_elements"](spark, SMALL).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.type, r.text))
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    want = {r.page_id: e for r in pages if (e := brute_elements(r.html))}
    wrong = [k for k in want.keys() | got.keys() if want.get(k) != got.get(k)]
    assert not wrong, [(len(wrong), k, list(zip(want.get(k, []), got.get(k, [])))[:3]) for k in wrong[:2]]
    assert len(got) >= 50 and max(len(t) for e in got.values() for _, t in e) > 200
