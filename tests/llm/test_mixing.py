from __future__ import annotations

import random
import re

import pytest

from deckframe.llm import mixing


def targets(sizes, weights=(3, 1, 2), budget=1.5, copies=2):
    """Share by weight; what is above a source's cap is shared again among the others."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > copies * sizes[s]}
        for s in full or open_:
            out[s] = copies * sizes[s] if full else weight[s] * level
        left -= sum(out[s] for s in full)
        if not full:
            break
        open_ -= full
    return out


def corpus(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if rnd.random() < 0.4 else rnd.choice(["a", "b", "B", "é", "zz", None])
        rows.append((i, source, "w " * rnd.choice([0, 1, 5, 50, 300])))
    return [*rows, (7, "a", "dup row"), (7, "a", "dup row"), (None, "b", "no id"), (None, "b", "no id"), (900, "a", None), (901, "none", ""), (902, "tiny", "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, key string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows)
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"\S+", t or ""))
    want = targets(size)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 602
    assert 1.5 * sum(size.values()) - 602 <= sum(taken.values()) <= 1.5 * sum(size.values())


def test_mixed_documents(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns[:4] == df.columns and len(mixed.columns) == 8
    same_as_mix(df, mixed)


def same_as_mix(df, mixed):
    """What the mix takes of each row is what its document says, and no row is taken for another."""
    key = lambda r: repr((r[0], r[1], r[2], r[3]))
    plan = [(r.doc_id, r.source, r.size, r.taken) for r in mixing.mix(df).collect() if r.taken > 0]
    got = mixed.collect()
    *_, size, _, target, taken = mixed.columns
    assert sorted(map(key, plan)) == sorted(key((r.doc_id, r.source, r[size], r[taken])) for r in got)
    assert all(r[size] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r[taken] in (r[size], 2 * r[size]) for r in got)
    assert all(r[target] > 0 for r in got)


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_ids_with_other_texts(spark, hot):
    """A third of all rows has one id, or none; some of them are alike in all columns."""
    rnd = random.Random(4)
    rows = [(hot, "a", "w " * rnd.choice([1, 10, 10, 1000]) + rnd.choice(["", "x", "y"])) for _ in range(200)]
    rows += [(hot, "b", "same row")] * 40 + [(2, "c", "all alike here")] * 50
    rows += [(i + 10, rnd.choice("abcd"), "w " * rnd.choice([1, 20, 90])) for i in range(300)]
    df = spark.createDataFrame([(*r, {"k": "v"}) for r in rows], "doc_id long, source string, text string, more map<string,string>").drop("more")
    mixed = mixing.mixed_documents(df)
    same_as_mix(df, mixed)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mixed_documents(df.repartition(5)).collect()))
    assert 0 < mixed.where("text = 'all alike here'").count() <= 50


def test_empty_table_and_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], df.schema)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
