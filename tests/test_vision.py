"""Matching of boxes: whole batches of images at once, components apart, large images by a sweep."""

from __future__ import annotations

import numpy as np
import pytest

from deckframe.operators import vision

BOXES = "image long, side string, ord long, x0 double, y0 double, x1 double, y1 double"


def overlaps(a, b):
    inter = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None).prod(axis=2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(axis=1)
    return inter / (area(a)[:, None] + area(b)[None, :] - inter)


def random_boxes(rnd, n, frame):
    at = rnd.uniform(0, frame, (n, 2))
    return np.hstack([at, at + rnd.uniform(5, 60, (n, 2))])


def test_recovery_takes_the_largest_total(spark):
    """Crowded and large images against the matching over all pairs of an image."""
    rnd, want, rows = np.random.default_rng(3), {}, []
    for image, (n, m, frame) in enumerate([(0, 3, 90), (4, 0, 90), (7, 5, 90), (5, 9, 60), (40, 40, 200), (1100, 1000, 4000)] + [(6, 6, 100)] * 40):
        true = random_boxes(rnd, m, frame)
        near = true[rnd.permutation(m)[: min(n, m)]] + rnd.uniform(-9, 9, (min(n, m), 4)) * 0.5
        found = np.vstack([near, random_boxes(rnd, n - len(near), frame)])
        rows += [(image, s, i, *map(float, box)) for s, boxes in (("found", found), ("true", true)) for i, box in enumerate(boxes)]
        iou = overlaps(found, true)
        hits = [iou[p] for p in vision.assign(-iou) if iou[p] >= 0.3] if iou.size else []
        want[image] = (m, len(hits), len(hits) / m if m else 0.0, sum(hits) / len(hits) if hits else 0.0)
    got = {r.image: r for r in vision.recovery(spark.createDataFrame(rows, BOXES), 0.3).collect()}
    assert got.keys() == want.keys()
    for image, (n_true, matched, recall, mean) in want.items():
        assert (got[image].n_true, got[image].matched) == (n_true, matched)
        assert (got[image].recall, got[image].mean_iou) == (pytest.approx(recall), pytest.approx(mean))


def test_recovery_of_nothing_and_of_unknown_places(spark):
    rows = [(1, "true", 0, 0.0, 0.0, 9.0, 9.0), (1, "found", 0, 0.0, 0.0, 9.0, None), (1, "found", 1, 0.0, 0.0, 9.0, 9.0), (2, "found", 0, 5.0, 5.0, 5.0, 9.0), (2, "true", 0, 5.0, 5.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, BOXES)
    assert {tuple(r) for r in vision.recovery(df).collect()} == {(1, 1, 1, 1.0, 1.0), (2, 1, 0, 0.0, 0.0)}
    assert {r.image: r.matched for r in vision.recovery(df.where("image = 2"), 0.0).collect()} == {2: 1}
    assert vision.recovery(df.limit(0)).collect() == []


def test_recovery_calls_python_by_batch(spark):
    """A call for each image took 213 s at sf0.1."""
    plan = vision.recovery(spark.createDataFrame([], BOXES))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
