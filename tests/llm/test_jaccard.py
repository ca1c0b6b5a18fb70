from __future__ import annotations

import random

import pytest

import corpus_pipeline
from deckframe.llm import jaccard, simhash


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Sets of doc_ids that links at 0.8 join."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= 0.8:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), set()).add(d)
    return {frozenset(g) for g in out.values()}


def corpus(seed=3):
    """Families of texts that differ by a few words: similarities on both sides of 0.8; chains within a family."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([3, 40, 120, 400]))]
        texts.append(" ".join(w))
        for _ in range(6):
            if rnd.random() < 0.5:
                w = texts[-1].split()
            w = list(w)
            for _ in range(rnd.choice([1, 1, 2, len(w) // 50, len(w) // 40])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [1 << 22, 300])
def test_links_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "x " * 5000)], "doc_id long, text string")
    df = df.selectExpr("*", "xxhash64(coalesce(text, '')) th").cache()
    ids = {}
    for r in df.collect():
        ids.setdefault(r.th, []).append(r.doc_id)
    root = {d: d for d, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in jaccard.similar(df).collect():
        root[find(ids[r.u][0])] = find(ids[r.v][0])
    for same in ids.values():
        for d in same:
            if d in root:
                root[find(d)] = find(same[0])
    got = {}
    for d, _ in rows:
        got.setdefault(find(d), set()).add(d)
    want = brute(rows)
    assert {frozenset(g) for g in got.values()} == want
    assert len(rows) / 4 < len(want) < len(rows) * 3 / 4


def test_stage_drops_what_is_similar(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").select("doc_id").collect()}
    assert all(len(g & kept) <= 1 for g in brute(rows))
    assert len(kept) < simhash.drop_near_duplicates(df).count()


def test_empty_table(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
