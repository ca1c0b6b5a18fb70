from __future__ import annotations

import random
import re
from itertools import combinations

from deckframe.llm import url_rules as u


def parts(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return (lower(m[1]), m[2]) if m else ("", "")


def tokens(host, path):
    return {"h:" + x for x in host.split(".") if x} | {"p:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}


def brute(pages, labels, min_support, min_confidence, min_count=5):
    marks = {}
    for d, quality, toxic in labels:
        if d is not None and (quality is not None and toxic is not None or quality == 0 or toxic == 1):
            marks[d] = marks.get(d, False) or quality == 0 or toxic == 1
    seen = [(tokens(*parts(url)), marks[i]) for i, url in pages if i in marks]
    seen = [(t, b) for t, b in seen if t or b]
    freq, hits = {}, {}
    for t, b in seen:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                freq[c] = freq.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + b
    base = sum(b for _, b in seen) / max(1, len(seen))
    rules = [set(c) for c in freq if hits[c] >= max(min_count, min_support * len(seen)) and hits[c] / freq[c] >= min_confidence and hits[c] / freq[c] > base]
    out = []
    for i, url in pages:
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(r <= tokens(host, path) for r in rules) else "allow")
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    hosts = ["www.Spam.example.net", "good.example.org", "example.org", "x.com", "m.spam.io", "notexample.org", "org"]
    paths = ["", "/", "/en/1", "/en/17?x=/es/", "/es/5#t", "/fr/a/b", "/de/3", "/casino/9", "/a//b/"]
    pages = [(i, f"http://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(500)]
    bad = lambda url: "pam" in url and "casino" in url or "x.com/a" in url
    labels = [(i, 0 if bad(url) or rnd.random() < 0.05 else 1, 0) for i, url in pages if i % 2] + [(2, None, None), (None, 0, 1), (4, None, 1), (1, 1, 0)]
    pages += [(900, None), (901, "no scheme"), (902, "://only"), (903, "HTTP://É.Org/É"), (None, "http://m.spam.io/casino/1"), (7, pages[7][1]), (904, "http://a.b/" + "x/" * 20000), (905, "http://h://x.com/de/")]
    df = spark.createDataFrame([(*r, "z") for r in pages], "page_id long, url string, host string")
    ld = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = u.judge_urls(df, ld, min_support=0.01, min_confidence=0.6).drop("confidence").collect()
    want = brute(pages, labels, 0.01, 0.6)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sum(r[4] == "block" and r[3] is None for r in want) > 20


def test_deep_paths_are_one_item(spark):
    """Segments that always stand together, many of them, on labelled pages; some stand apart on others."""
    names = [f"s{chr(97 + i)}" for i in range(24)]
    deep = "/".join(names)
    pages = [(i, f"http://deep.net/{deep}/{i}") for i in range(30)] + [(100 + i, f"http://ok.net/{i % 3}/page") for i in range(60)]
    labels = [(i, 0, 0) for i in range(30)] + [(100 + i, 1, 0) for i in range(50)]
    pages += [(200 + i, f"http://else.net/{n}") for i, n in enumerate(names)] + [(300, "http://deep.net/x"), (301, "http://ok.net/page")]
    got = u.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    assert all((verdicts[i] == "block") == (i < 30 or 200 <= i <= 300) for i, _ in pages)


def test_a_better_rule_two_tokens_shorter(spark):
    """{a, b, c} goes although {a, b} is worse than both it and {a}."""
    rows = [(["a"], True)] * 10 + [(["a", "b"], False)] * 2 + [(["a", "b"], True)] + [(["a", "b", "c"], True)] * 5 + [(["a", "b", "c"], False)] * 1 + [(["z"], False)] * 40
    _, index = u.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.0, min_confidence=0.5, min_count=1)
    kept = {tuple(r["items"]): r.confidence for r in index.collect()}
    assert sorted(kept) == [("a",), ("b",), ("c",)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert u.judge_urls(pages, labels).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], pages.schema)
    assert [tuple(r)[1:5] for r in u.judge_urls(one, labels).collect()] == [("a.org", "/x", "org/", "allow")]
