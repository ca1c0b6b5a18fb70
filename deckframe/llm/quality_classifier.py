"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is measured once, all of it; the statistics are ratios and logarithms, so
that length alone says little. Class means and covariances come from sums over the
labelled rows, added up in each task and then by key. A class covariance is shrunk
towards the pooled one and that towards a multiple of the identity; its Cholesky
factor is computed once and travels with the scoring task. A document's score is the
logistic function of the difference of the log densities, Mahalanobis distances and
determinants, and of the log odds of the classes, over ``TEMPERATURE``.

Rows learn only where the CRC-32 of the id as text is not 0 modulo ``FOLDS``; no
label, language, source or id enters a score.

Defined results: null and empty texts are measured as texts without words, a very
long text whole and alone; null ids
are scored and count as not held out, and are never learned from; labels that are
null, or rows that a label table repeats with both labels, take part as given;
without a row of either class every score is 0.5, with one class alone it is that
class; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.llm.hashing import Hashed, blocks, word_bounds
from deckframe.plans import sized, stored

FOLDS = 5
THRESHOLD = 0.3
#: Shares of the pooled covariance, and then of the identity.
POOLED, IDENTITY = 0.3, 0.05
TEMPERATURE = 3.0
#: Statistics are held within so many deviations of their mean, and drawn to it in texts of about so few words.
CLIP, FEW = 4.0, 5.0

#: Classes of bytes: lower, upper, digit, stops, other marks, symbols, bar, space, newline, beyond ASCII.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "!\"'()-/[]{}_+=~`@\\^", "#*$%&<>", "|", " \t\x0b\x0c\r", "\n"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_KINDS = len(_CLASSES) + 1
#: What a row of statistics holds after the number of words.
FEATURES = ["word_bytes", "upper", "digits", "stops", "marks", "symbols", "bars", "newlines", "distinct", "short", "capitals"]


def measure(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Statistics of texts that follow each other in ``data`` and end at ``ends``; a row for each."""
    n = len(ends)
    doc = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    kinds = np.bincount(doc * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    lower, upper, digit, stops, marks, symbols, bar, _, newline, other = kinds.T
    starts, stops_at = word_bounds(data, ends)
    owner = doc[starts] if len(starts) else np.zeros(0, np.int64)
    size = stops_at - starts
    words = np.bincount(owner, minlength=n).astype(float)
    w, letters = np.maximum(words, 1), np.maximum(lower + upper + other / 2, 1)
    hashes = Hashed(data, ends).words
    pairs = np.unique(np.stack([owner.view(np.uint64), hashes]), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    short = np.bincount(owner, weights=size <= 3, minlength=n)
    capital = np.bincount(owner, weights=_CLASS[data[starts]] == 1, minlength=n) if len(starts) else np.zeros(n)
    ratio = lambda x, y: np.log(x / y + 0.01)
    return np.column_stack(
        [
            words,
            np.log1p(np.bincount(owner, weights=size, minlength=n) / w),
            ratio(upper, letters),
            ratio(digit, w),
            ratio(stops, w),
            ratio(marks, w),
            ratio(symbols, w),
            ratio(bar, w),
            ratio(newline, w),
            np.log((distinct + 1) / (words + 1)),
            short / w,
            capital / w,
        ]
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in blocks(batch):
                x = measure(data, ends)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), flat], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def _scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    words = x[:, :1]
    return np.clip((x[:, 1:] - centre) / spread, -CLIP, CLIP) * (words / (words + FEW))


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    #: Inverse Cholesky factors of the class covariances, and halves of their log determinants.
    factors: list[np.ndarray]
    half_logdets: list[float]
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = _scaled(x, self.centre, self.spread)
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - h for m, f, h in zip(self.means, self.factors, self.half_logdets, strict=True)]
        d = (density[1] - density[0] + self.log_odds) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def learn(examples: DataFrame) -> Model | float:
    """Of examples (x, label 0 or 1): the model, or a constant score where a class is missing."""
    examples = stored(examples, "examples")
    d = len(FEATURES)
    columns = [f(F.col("x")[i + 1]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    first = examples.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), *columns).first()
    n0, n1 = first[0], first[1]
    if not n0 or not n1:
        return 0.5 if n0 == n1 else float(n1 > 0)
    centre, spread = np.array(first[2::2], float), np.array(first[3::2], float)
    spread = np.where(spread > 1e-9, spread, 1.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d * (d + 1)))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 1)
            z, label = _scaled(x, centre, spread), batch.column("label").to_numpy()
            for k in (0, 1):
                own = z[label == k]
                sums[k] += np.concatenate([own.sum(axis=0), (own.T @ own).ravel()])
        label, at = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(label.ravel().astype(np.int32)), pa.array(at.ravel().astype(np.int32)), pa.array(sums.ravel())], ["label", "at", "value"])

    parts = examples.select("label", "x").mapInArrow(add, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, d * (d + 1)))
    for r in parts.collect():  # 2 * d * (d + 1) rows
        sums[r["label"], r["at"]] = r["value"]
    n = np.array([n0, n1], float)
    means = [sums[k, :d] / n[k] for k in (0, 1)]
    scatter = [sums[k, d:].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factors, half = [], []
    for k in (0, 1):
        s = (1 - POOLED) * scatter[k] / n[k] + POOLED * pooled
        s = (1 - IDENTITY) * s + IDENTITY * max(np.trace(s) / d, 1e-6) * np.eye(d)
        chol = np.linalg.cholesky((s + s.T) / 2)
        factors.append(np.linalg.inv(chol))
        half.append(float(np.log(np.diag(chol)).sum()))
    return Model(centre, spread, means, factors, half, float(np.log(n1 / n0)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; ``labels`` has doc_id and quality."""
    x = stored(statistics(docs), "statistics")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").dropna()
    marks = stored(marks.where(~out), "marks")
    model = learn(x.join(sized(marks), "doc_id").select("x", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = m.scores(rows) if isinstance(m, Model) else np.full(batch.num_rows, m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", out.alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
