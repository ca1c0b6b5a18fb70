from __future__ import annotations

import random

import numpy as np
import pytest

from deckframe.llm import decontaminate as d


def make(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    some = lambda k: [rnd.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(some(rnd.randrange(8, 40))) + ". " + " ".join(some(rnd.randrange(1, 12))) + ".") for i in range(n)]
    docs = []
    for i in range(150):
        w = some(rnd.choice([0, 5, 100, 400, 900]))
        if i % 3 == 0:
            text = items[rnd.randrange(n)][1].upper().replace(".", " ,")
            at = rnd.randrange(len(w) + 1)
            w[at:at] = text.split(" ")
        docs.append((i, " ".join(w)))
    return items, docs


def test_search_retrieves_all_above_threshold():
    items, docs = make()
    for block in (1, 4, 64):
        index = d.Index([(i, *d.split_item(t)) for i, t in items], block)
        dense = np.zeros((len(index.terms), len(items)))
        for t, posted in enumerate(index.postings):
            for j, v in posted:
                dense[t, j] = v
        assert np.allclose(dense.sum(axis=0), 1)
        found = 0
        for _, text in docs:
            words = d.tokens(text)
            terms = np.array(sorted({index.terms[w] for w in words if w in index.terms}), np.int64)
            score = dense[terms].sum(axis=0) if len(terms) else np.zeros(len(items))
            for least in (0.2, 0.6):
                got = dict(index.search(terms, least))
                assert sorted(got) == np.flatnonzero(score >= least - 1e-9).tolist()
                found += len(got)
        assert found > 100


def brute(items, docs):
    """Documents in which a passage holds MIN_OVERLAP of both parts of an item, by the passages of the index."""
    index = d.Index([(i, *d.split_item(t)) for i, t in items])
    out = {}
    for i, text in docs:
        words = d.tokens(text)
        hits = set()
        for s in index.passages(len(words)):
            passage = words[s : s + index.passage]
            grams = {k: {tuple(passage[a : a + k]) for a in range(len(passage))} for k in range(1, 6)}
            for item, t in items:
                if all(sum(g in grams[len(g)] for g in p) >= d.MIN_OVERLAP * len(p) for p in map(d.shingles, map(d.tokens, d.split_item(t)))):
                    hits.add(item)
        out[i] = sorted(hits, key=lambda x: (x is not None, x))
    return out


def test_against_brute_force(spark):
    items, docs = make(2)
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1]), (903, ("x " * 5000) + items[3][1] + " y" * 5000)]
    df = spark.createDataFrame([(*r, "q") for r in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([*items, (777, None), (778, " ")], "item_id long, text string")
    rows = d.contamination(df, bench).collect()
    want = brute(items, docs)
    assert {r.doc_id: [h.item_id for h in r.hits] for r in rows} == want
    assert len(rows) == len(docs) and sum(map(bool, want.values())) >= 50 and 3 in want[903]
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if not want[i])


def test_long_items_and_shards(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_ITEMS", 7)
    items, docs = make(3, 30)
    items.append((99, " ".join(f"long{i}" for i in range(400)) + ". the end."))
    docs.append((800, "a b c " * 50 + items[-1][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: sorted(h.item_id for h in r.hits) for r in d.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert 99 in got[800]
    assert all(got[i] for i in range(0, 150, 3))
    assert got == brute(items, docs)


@pytest.mark.parametrize("shard", [1 << 14, 9])
def test_null_and_repeated_items_in_any_number_of_indexes(spark, monkeypatch, shard):
    monkeypatch.setattr(d, "SHARD_ITEMS", shard)
    items, docs = make(5, 40)
    extra = [(None, "An item that nobody gave a number to at all. It stands here."), (None, "Another one without any number of its own. It stands there."), items[3], (3, items[4][1])]
    docs += [(700, "zz " * 90 + extra[0][1]), (701, extra[1][1]), (702, items[4][1]), (None, items[5][1]), (None, items[5][1]), (703, None), (704, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + extra, "item_id long, text string")
    rows = d.contamination(df, bench).collect()
    want = brute(items + extra, docs)
    order = lambda ids: sorted(ids, key=repr)
    assert len(rows) == len(docs)
    assert {r.doc_id: order({h.item_id for h in r.hits}) for r in rows} == {i: order(set(x)) for i, x in want.items()}
    assert want[700] == want[701] == [None] and order(want[702]) == [3, 4] and want[None] == [5]
    whole = d.Index([(i, *d.split_item(t)) for i, t in dict.fromkeys(items + extra)])
    assert all({(h.item_id, h.score) for h in r.hits} == {(h.item, h.score) for h in whole.hits(dict(docs)[r.doc_id])[2]} for r in rows)
    kept = d.drop_contaminated(df, bench)
    assert sorted(map(repr, kept.collect())) == sorted(repr(x) for x in df.collect() if not want[x.doc_id])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.contaminated for r in d.contamination(one, bench).collect()] == [False]
    assert d.drop_contaminated(one, bench).count() == 1


@pytest.mark.parametrize(("text", "parts"), [("A b. C d.", ("A b.", "C d.")), ("Only one", ("Only one", "")), ("q\na", ("q", "a")), (None, ("", ""))])
def test_split_item(text, parts):
    assert d.split_item(text) == parts
