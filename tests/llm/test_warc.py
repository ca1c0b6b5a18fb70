from __future__ import annotations

import hashlib

from deckframe.llm import warc
from deckframe.plans import work_dir

BIG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100
ROWS = [
    (1, "http://a/\r\nX: y", BIG),
    (2, "http://b", BIG),
    (9, None, BIG),
    (9, None, BIG),
    (None, "http://n", BIG),
    (3, "http://c", "small"),
    (4, "http://d", "small"),
    (5, "http://e", None),
    (6, "http://f", ""),
    (None, None, "z" * 1000),
    (None, "q", "z" * 1000),
    (7, "u", "x" * 999),
    (8, "u", "x" * 999),
    (10, "u", "y" * 3_000_000),
    (11, "u", "\u0000\ud7ff|" * 400),
]


def expected():
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        ids = [j for j, _, h in ROWS if (h or "").encode() == data and j is not None]
        last = max(ids, default=None) if len(data) >= 1000 else None
        revisit = last is not None and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string").repartition(4)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    assert got == expected()


def test_payloads_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None], "page_id long, url string, html string")
    folder = f"{work_dir(spark)}/warc-test-{id(df)}"
    warc.write_archives(df, folder)
    back = warc.with_originals(warc.read_archives(spark, folder, payloads=True)).collect()
    text = {i: (h or "").encode() for i, _, h in ROWS}
    assert len(back) == sum(r[0] is not None for r in ROWS)
    for r in back:
        assert (bytes(r.payload) if r.record_type == "response" else text[r.original_page_id]) == text[r.page_id]
    assert next(r.url for r in back if r.page_id == 1) == "http://a/%0D%0AX: y"


def test_a_run_of_large_pages_makes_many_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    rows = [(i, "http://small", f"s{i}") for i in range(3000)] + [(10_000 + i, "http://big/" + "u" * 5000, f"{i} " + "b" * 400_000) for i in range(12)] + [(20_000, "http://huge", "h" * 5_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "warc")
    warc.write_archives(df, folder)
    sizes = [p.stat().st_size for p in (tmp_path / "warc").rglob("part-*")]
    assert sum(n > 1 << 20 for n in sizes) == 1 and max(sizes) < 5_002_000
    back = warc.read_archives(spark, folder, payloads=True).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in back} == {(i, h) for i, _, h in rows}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
