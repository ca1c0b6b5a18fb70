from __future__ import annotations

import hashlib
import random
import re

import pytest

from deckframe.llm import hashing, substring_dedup
from deckframe.llm.substring_dedup import dedup_substrings


def brute(rows, size=50):
    texts = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    rank = lambda d: float("inf") if d is None else d
    least = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, float("inf")), rank(d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < rank(d):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(200)] + ["É", "ß.", " x"]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [some(rnd.choice([49, 50, 51, 60, 120])) for _ in range(12)]
    rows = []
    for i in range(300):
        w = some(rnd.choice([0, 3, 49, 50, 80, 200]))
        for _ in range(rnd.choice([0, 1, 1, 3])):
            at = rnd.randrange(len(w) + 1)
            p = rnd.choice(passages)
            w[at:at] = p if rnd.random() < 0.7 else p[rnd.randrange(10) :]
        rows.append((i * 37 % 307, rnd.choice([" ", "\n", "\t \r\n"]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n "), (None, rows[5][1]), (None, " ".join(passages[0])), rows[7], rows[7]]
    rows += [(903, "a " * 500), (904, "a " * 400), (905, "  ".join(passages[3] * 4) + " "), (7, " ".join(passages[4]))]
    return rows


@pytest.mark.parametrize("gather", [1 << 21, 100])
def test_against_brute_force(spark, monkeypatch, gather):
    monkeypatch.setattr(substring_dedup, "GATHER", gather)
    monkeypatch.setattr(hashing, "BLOCK", 3000)
    rows = corpus(gather)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, starts string, rank int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 5000


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
