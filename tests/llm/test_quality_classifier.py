from __future__ import annotations

import zlib

import numpy as np
import pytest

from deckframe.llm import quality_classifier as c
from deckframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_scores_are_the_log_density_difference():
    rnd = np.random.default_rng(1)
    d = 3
    means, covs = [rnd.normal(size=d) for _ in "ab"], [np.cov(rnd.normal(size=(d, 50))) for _ in "ab"]
    chol = [np.linalg.cholesky(s) for s in covs]
    m = c.Model(np.zeros(d), np.ones(d), means, [np.linalg.inv(x) for x in chol], [np.log(np.diag(x)).sum() for x in chol], 0.7)
    z = rnd.normal(size=(20, d))
    x = np.column_stack([np.full(20, 1e12), z])  # so many words that nothing is drawn to the mean
    density = lambda k: -0.5 * np.einsum("ij,jk,ik->i", z - means[k], np.linalg.inv(covs[k]), z - means[k]) - 0.5 * np.log(np.linalg.det(covs[k]))
    want = 1 / (1 + np.exp(-(density(1) - density(0) + 0.7) / c.TEMPERATURE))
    assert m.scores(x) == pytest.approx(want, rel=1e-9)


def test_learning_against_numpy(spark):
    """The model out of distributed sums is that of plain numpy on all rows at once."""
    rnd = np.random.default_rng(5)
    d = len(c.FEATURES)
    label = rnd.integers(0, 2, 400)
    x = np.column_stack([rnd.integers(1, 200, 400), rnd.normal(size=(400, d)) * rnd.uniform(0.5, 3, d) + label[:, None] * 0.7])
    df = spark.createDataFrame([(row.tolist(), int(k)) for row, k in zip(x, label, strict=True)], "x array<double>, label int").repartition(7)
    m = c.learn(df)
    centre, spread = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0)
    z = np.clip((x[:, 1:] - centre) / spread, -c.CLIP, c.CLIP) * (x[:, :1] / (x[:, :1] + c.FEW))
    means = [z[label == k].mean(axis=0) for k in (0, 1)]
    covs = [np.cov(z[label == k].T, bias=True) for k in (0, 1)]
    n = [np.sum(label == k) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    score = np.full(400, np.log(n[1] / n[0]))
    for k, sign in ((0, -1), (1, 1)):
        s = (1 - c.POOLED) * covs[k] + c.POOLED * pooled
        s = (1 - c.IDENTITY) * s + c.IDENTITY * np.trace(s) / d * np.eye(d)
        score += sign * (-0.5 * np.einsum("ij,jk,ik->i", z - means[k], np.linalg.inv(s), z - means[k]) - 0.5 * np.linalg.slogdet(s)[1])
        assert m.means[k] == pytest.approx(means[k])
    assert m.scores(x) == pytest.approx(1 / (1 + np.exp(-score / c.TEMPERATURE)), abs=1e-9)


def test_edges(spark):
    texts = [None, "", " \n", "a", "Fine words stand here. " * 30, "$$$ ### " * 40, "é" * 10, "w " * 400000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i != 5), 0) for i in range(8)] + [(5, None, None), (None, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = c.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in c.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in c.classify(docs, labels.where("quality = 1 and doc_id <> 4")).collect()} == {1.0}
    assert c.classify(docs.limit(0), labels).count() == 0


def test_statistics_of_each_text_alone():
    texts = ["Hello World, 12!\n", "", "a|b $ c", "É é\tÀ", "x" * 50]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    together = c.measure(np.frombuffer(b"".join(raw), np.uint8), ends)
    for t, row in zip(raw, together, strict=True):
        assert c.measure(np.frombuffer(t, np.uint8), np.array([len(t)]))[0] == pytest.approx(row)
    assert together[:, 0].tolist() == [3, 0, 3, 3, 1]
