from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from deckframe.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def words(text):
    return WORD.findall(text or "")


def grams(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(text)]
    # Spark hashes a pair of longs by hashing the second with the first's hash as seed
    one = lambda v, seed: xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    pairs = [signed(one(b, one(a, 42))) for a, b in zip(h, h[1:])]
    return [x % q.BUCKETS for x in h] + [x % q.BUCKETS + q.BUCKETS for x in pairs]


def base(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def corpus(n=120):
    rnd = random.Random(4)
    vocab = ["word%d" % i for i in range(80)] + ["É", "naïve", "a|b", "**"]
    rows = [(i, " ".join(rnd.choice(vocab) + rnd.choice(["", "\n", "\t", " "]) for _ in range(rnd.choice([3, 9, 10, 30, 200])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\x0b "), (None, "x y z " * 20), (n + 3, "same line\nsame line\n\nsame line\n other"), (5, rows[5][1]), (n + 4, "z$$$ q%%% " * 3 + "junk only here once and never again 1 2 3 4"), (n + 5, "long " * 40000)]
    return rows, [(i, int(i % 3 > 0), 0) for i in range(0, n, 2)] + [(None, 1, 0), (7, None, None)]


def test_against_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, _words string, _quality int")
    df, name = q.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = df.select("doc_id", "text", f"{name}.*").collect()
    assert df.columns[:4] == docs.columns and len(got) == len(rows)
    trusted = {d for d, quality, _ in labels if quality == 1}
    raw, target = Counter(), Counter()
    for d, t in rows:
        g = grams(t)
        raw.update(g)
        if d is not None and d in trusted:
            target.update(g)
    space, rn, tn = 2 * q.BUCKETS, sum(raw.values()), sum(target.values())
    weight = lambda b: math.log((target[b] + 1) / (tn + space)) - math.log((raw[b] + 1) / (rn + space))
    for r in got:
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        g = grams(r.text)
        llr = sum(map(weight, g)) / len(g) if g else 0.0
        assert r.llr == pytest.approx(llr, abs=2e-6)
        if abs(llr - q.MIN_LLR) > 1e-5:
            assert r.kept == (not want[-1] and llr >= q.MIN_LLR)
    assert {True, False} == {r.kept for r in got}
    assert df.where(f"{name}.kept").count() == sum(r.kept for r in got)


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    df, name = q.quality_rules(one, labels)
    assert [(r.llr, r.kept) for r in df.select(f"{name}.*").collect()] == [(0.0, True)]
    df, name = q.quality_rules(one.limit(0), labels)
    assert df.count() == 0
