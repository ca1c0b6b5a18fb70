from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from deckframe.llm import line_dedup


def brute(rows, ratio=line_dedup.MAX_RATIO, min_site=10, min_line=5):
    has = lambda x: re.search("[^\x20\x09-\x0d]", x)
    pages, counts = {}, {}
    for _, site, text in rows:
        pages[site] = pages.get(site, 0) + 1
        for x in set((text or "").split("\n")):
            if has(x):
                counts[site, x] = counts.get((site, x), 0) + 1
    out = []
    for i, site, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        drop = lambda x: has(x) and pages[site] >= min_site and counts[site, x] >= min_line and counts[site, x] > ratio * pages[site]  # noqa: E731, B023
        kept = [x for x in lines if not drop(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        site = rnd.choice(["hot"] * 5 + ["b", "c", None, "tiny" if i < 20 else "d"])
        lines = [f"line {rnd.randrange(2000)}" for _ in range(rnd.choice([0, 1, 4]))]
        lines += [x for x, p in (("menu", 0.3), (f"foot {site}", 0.5), ("", 0.4), (" \t", 0.2), ("rare", 0.08)) if rnd.random() < p]
        rnd.shuffle(lines)
        rows.append((i, site, "\n".join(lines)))
    return [*rows, (900, "hot", None), (901, "hot", ""), (902, "hot", "menu"), (902, "hot", "menu"), (None, "b", "menu\nx"), (903, "lone", "menu"), (904, "hot", "menu\n" + "long line " * 30000)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, _drop int, _n_lines string")
    out, before, gone = line_dedup.dedup_lines(df)
    assert out.columns[:5] == df.columns
    got = sorted(((r.doc_id, r.text, r[before], r[gone]) for r in out.collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 200


def test_pages_by_host(spark):
    """The same line is boilerplate on one host and not on another; hosts are compared in lower case."""
    rows = [(i, f"http://{'A.example' if i % 2 else 'a.EXAMPLE'}/{i}", f"menu\nown {i}") for i in range(20)] + [(100 + i, f"https://b.example/{i}", f"own {i}" + ("\nmenu" if i == 0 else "")) for i in range(40)] + [(200, None, "menu"), (201, "no scheme", "menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", line_dedup.host_of(F.col("url")))
    out, _, gone = line_dedup.dedup_lines(df, "host", "html")
    got = {r.page_id: (r.html, r[gone]) for r in out.collect()}
    assert all(got[i] == (f"own {i}", 1) for i in range(20)) and got[100] == ("own 0\nmenu", 0) and got[200] == ("menu", 0)


def test_empty_table_and_hosts(spark):
    out, _, _ = line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, source string, text string"))
    assert out.count() == 0
    urls = spark.createDataFrame([("http://A.b/x://y",), ("//no",), (None,), ("https://h?q",)], "u string")
    assert [r[0] for r in urls.select(line_dedup.host_of(urls["u"])).collect()] == ["a.b", None, None, "h"]
