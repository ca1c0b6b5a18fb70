"""Operators on detected boxes: suppression and the best one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.functions.texts import picture_type

#: Pairs of boxes that are measured at once, at most about.
MANY = 1 << 20


def suppress(detections: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Non-maximum suppression of each image whatever the class, as a fold over its boxes.

    Boxes (image, ord, x0, y0, x1, y1, score) go by falling score, of equal ones in
    order; one stays if its overlap with every box kept so far is below ``threshold``.
    """
    box = F.struct((-F.col("score")).alias("s"), "ord", "x0", "y0", "x1", "y1")
    rows = detections.groupBy("image").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    zero = F.lit(0.0)

    def shared(a, b):
        return F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))

    def area(a):
        return F.greatest(zero, a["x1"] - a["x0"]) * F.greatest(zero, a["y1"] - a["y0"])

    def clash(a, b):
        return (shared(a, b) >= threshold * (area(a) + area(b) - shared(a, b))) & (area(a) + area(b) > 0)

    keep = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    kept = rows.select("image", F.explode(keep).alias("b"))
    return kept.select("image", "b.ord", (-F.col("b.s")).alias("score"))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of least total cost, min(rows, columns) of them, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m] = row
        best, back, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        col = m
        while owner[col] >= 0:
            done[col] = True
            r = owner[col]
            slack = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (slack < best[:m])
            best[:m][better], back[:m][better] = slack[better], col
            open_ = np.where(done[:m], np.inf, best[:m])
            nxt = int(np.argmin(open_))
            step = open_[nxt]
            u[owner[done]] += step
            v[done] -= step
            best[:m][~done[:m]] -= step
            col = nxt
        while col != m:
            owner[col] = owner[back[col]]
            col = back[col]
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def _touching(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of boxes of ``a`` and ``b`` (x0, y0, x1, y1; those of an image lie between its places in ``at_a`` and ``at_b``) that overlap, as their rows and overlaps, in order of ``a``.

    Within an image with many pairs a box meets, of ``b`` by start, only those before
    its own end and from the first on that ends after its own start.
    """
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    low, high, order = np.repeat(at_b[:-1], n_a), np.repeat(at_b[1:], n_a), np.arange(len(b))
    for i in np.flatnonzero(n_a * n_b > MANY):
        mine, theirs = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
        order[theirs] = at_b[i] + np.argsort(b[theirs, 0], kind="stable")
        starts, ends = b[order[theirs], 0], np.maximum.accumulate(np.nan_to_num(b[order[theirs], 2], nan=-np.inf))
        low[mine] = at_b[i] + np.searchsorted(ends, a[mine, 0], "right")
        high[mine] = np.maximum(low[mine], at_b[i] + np.searchsorted(starts, a[mine, 2], "left"))
    upto = np.concatenate([[0], np.cumsum(high - low)])
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    of_a, of_b, row = area(a), area(b), 0
    while row < len(a):
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + MANY, "right")) - 1)
        n = high[row:stop] - low[row:stop]
        i = np.repeat(np.arange(row, stop), n)
        j = order[np.arange(len(i)) + np.repeat(low[row:stop] - (upto[row:stop] - upto[row]), n)]
        row = stop
        inter = np.clip(np.minimum(a[i, 2:], b[j, 2:]) - np.maximum(a[i, :2], b[j, :2]), 0, None).prod(axis=1)
        i, j, inter = i[inter > 0], j[inter > 0], inter[inter > 0]
        yield i, j, inter / (of_a[i] + of_b[j] - inter)


def _chosen(i: np.ndarray, j: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j, iou) the one-to-one matching of the largest total takes; each component is matched for itself."""
    taken = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1) if len(i) else np.zeros(0, bool)
    shared = np.flatnonzero(~taken)
    by_i: dict[int, list[int]] = {}
    by_j: dict[int, list[int]] = {}
    ends = list(zip(i[shared].tolist(), j[shared].tolist(), strict=True))
    for e, (x, y) in enumerate(ends):
        by_i.setdefault(x, []).append(e)
        by_j.setdefault(y, []).append(e)
    seen_i: set[int] = set()
    seen_j: set[int] = set()
    for first in by_i:
        if first in seen_i:
            continue
        seen_i.add(first)
        todo, edges = [first], []
        while todo:
            for e in by_i[todo.pop()]:
                edges.append(e)
                if (y := ends[e][1]) not in seen_j:
                    seen_j.add(y)
                    fresh = [ends[o][0] for o in by_j[y] if ends[o][0] not in seen_i]
                    seen_i.update(fresh)
                    todo.extend(dict.fromkeys(fresh))
        rows, columns = ({v: k for k, v in enumerate(sorted({ends[e][side] for e in edges}))} for side in (0, 1))
        cost, edge = np.zeros((len(rows), len(columns))), {}
        for e in edges:
            at = rows[ends[e][0]], columns[ends[e][1]]
            edge[at], cost[at] = shared[e], -iou[shared[e]]
        taken[[edge[at] for at in assign(cost) if at in edge]] = True
    return taken


def recovery(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Of boxes (image, side 'found' or 'true', ord, x0, y0, x1, y1): matched boxes, recall and mean overlap of each image.

    The images of a batch are measured at once. Boxes that overlap nothing add nothing
    to a matching, so only components of overlapping boxes are searched, and those of
    one pair not at all.
    """
    box = F.struct("ord", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, box))).alias(s)

    def flat(boxes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        n = pc.list_value_length(boxes).to_numpy(zero_copy_only=False)
        values = boxes.flatten()
        columns = [pc.fill_null(values.field(c), float("nan")).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
        return np.column_stack(columns), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, at_a), (b, at_b) = flat(batch.column("found")), flat(batch.column("true"))
            i, j, iou = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *_touching(a, b, at_a, at_b), strict=True))
            hit = _chosen(i, j, iou) & (iou >= least)
            image = np.repeat(np.arange(batch.num_rows), np.diff(at_a))[i[hit]]
            matched, n_true = np.bincount(image, minlength=batch.num_rows), np.diff(at_b)
            if least <= 0:  # then pairs that do not overlap are matched as well
                matched = np.minimum(np.diff(at_a), n_true)
            total = np.bincount(image, weights=iou[hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(n_true), pa.array(matched), pa.array(matched / np.maximum(n_true, 1)), pa.array(total / np.maximum(matched, 1))], ["image", "n_true", "matched", "recall", "mean_iou"])

    kind = pairs.schema["image"].dataType.simpleString()
    return pairs.groupBy("image").agg(side("found"), side("true")).mapInArrow(match, f"image {kind}, n_true long, matched long, recall double, mean_iou double")


def recovered(detections: DataFrame, width: int = 960) -> DataFrame:
    """Of detections (slide_id, pos, label, x0, y0, x1, y1, img_w, img_h): elements in a frame of one width, the height by the image."""
    s = width / F.col("img_w").cast("double")
    size = lambda lo, hi: F.greatest(F.lit(0.0), F.col(hi) - F.col(lo))
    box = {"x": F.col("x0") * s, "y": F.col("y0") * s, "w": size("x0", "x1") * s, "h": size("y0", "y1") * s}
    return detections.select("slide_id", "pos", F.concat(F.lit("rec_"), F.col("pos").cast("string")).alias("element_id"), picture_type(F.col("label")).alias("etype"), *[F.round(v, 6).alias(k) for k, v in box.items()], F.lit(width).alias("width"), F.bround(F.col("img_h") * s).cast("int").alias("height"))


def image_size(width: int, height: int, long_edge: int) -> tuple[int, int]:
    """Width and height of an image whose longer side is ``long_edge``."""
    if min(width, height) < 0 or max(width, height) <= 0 or long_edge <= 0:
        raise ValueError("sizes must be positive")
    scale = long_edge / max(width, height)
    return max(1, round(width * scale)), max(1, round(height * scale))


def in_pixels(elements: DataFrame, long_edge: int, width: int = 1920, height: int = 1080) -> DataFrame:
    """Boxes in the pixels of an image of a size, whose real scales count."""
    across, down = image_size(width, height, long_edge)
    sx, sy = across / width, down / height
    return elements.select("slide_id", "pos", F.lit(across).alias("image_width"), F.lit(down).alias("image_height"), *[F.round(F.col(c) * (sx if c in "xw" else sy), 6).alias(c) for c in "xywh"])
