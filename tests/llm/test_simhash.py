from __future__ import annotations

import random
import re

import pytest
import xxhash

from deckframe.llm import simhash
from deckframe.llm.components import components


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """rows: (doc_id, text) to [(doc_id, fp, component)]."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, fps[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def unsigned(x):
    return x & ((1 << 64) - 1)


def corpus(seed=5, n=400):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ß", "Abc"]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts[-40:]).split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 80, 200]))]
        texts.append(" ".join(w))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("few", "chunk", "spare"), [(32, 2048, 1), (1, 5, 1), (2, 9, 25)])
def test_against_brute_force(spark, monkeypatch, few, chunk, spare):
    monkeypatch.setattr(simhash, "SPARE_BITS", spare)
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = [*corpus(), (5000, None), (5001, ""), (5002, " \t"), (None, None), (5003, "Abc"), (5004, "abc"), (5003, "Abc"), (5005, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    want = brute(rows)
    assert got == sorted(x for x in want if x[0] is not None)
    assert len({c for _, _, c in want}) < len(rows) - 50


def test_one_row_of_each_group_stays(spark):
    rows = [*corpus(9, 120), (None, "a b c d"), (None, "a b c d"), (None, "unlike anything else here"), (4000, "a b c d"), (4001, "x y"), (4001, "x y")]
    df = spark.createDataFrame([(*r, "fp", i) for i, r in enumerate(rows)], "doc_id long, text string, fp string, component_id int")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for d, _, c in brute(rows) if c is not None})
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["unlike anything else here"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    loops = {a for a, b in edges if a == b and near[a] == {a}}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k not in loops}


def test_blocks_grow_with_the_fingerprints():
    assert simhash.blocks_for(0) == simhash.blocks_for(1 << 21) == 5
    assert [simhash.blocks_for(10**k) for k in (8, 9, 10, 12)] == [6, 6, 7, 9]
    for count in (5, 7, 8):
        masks = [unsigned(m) for m in simhash._masks(count)]
        assert all(any(x & m == 0 for m in masks) for x in (1 | 1 << 31 | 1 << 63, 0b111, 1 << 12 | 1 << 13 | 1 << 14))
