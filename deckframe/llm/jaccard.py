"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash: ``BANDS`` bands of ``ROWS`` minima each. A pair at
similarity s shares no band with probability (1 - s^ROWS)^BANDS: below one in two
million at 0.8, less above. What shares a band is only linked to the band's smallest
text, so candidates are as many as rows, however hot the band.

Candidates' components are then compared exactly, on the sets themselves: what is
linked afterwards has the similarity, and nothing else has. A component of more than
``CHUNK`` characters is dealt to pairs of chunks, so that no task gets it whole. Of
equal texts one row is compared, that of the smallest id; the table that says which
rows go where is narrow and broadcast while it is small, so only these rows move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.llm.components import components
from deckframe.plans import sized, stored

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
BANDS = 48
ROWS = 6
#: Characters of a component's texts from which it is dealt to chunks, and the size of these.
CHUNK = 1 << 22
#: Shingles that are multiplied at once.
SLICE = 256


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; case and ASCII spaces as in ``simhash``."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(parts[i : i + k]), SEED) for i in range(max(1, len(parts) - k + 1))), np.uint64))


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed number for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    factors = _numbers(BANDS * ROWS, SEED)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[a : a + SLICE, None] * factors).min(axis=0))
    keys = _numbers(BANDS, SEED + 1)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that keep together exactly what links of the similarity keep together.

    Each set meets those not reached yet: by the lists of its members, or by passing
    over what is left, whichever is shorter.
    """
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(n), size)
    _, token = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    lists = owner[np.argsort(token, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(token))]) if len(token) else np.zeros(1, np.int64)
    marked = np.zeros(len(ends), bool)
    left = np.ones(n, bool)
    token_left, owner_left = token, owner
    out = []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            if len(token_left) > 2 * size[left].sum():
                keep = left[owner_left]
                token_left, owner_left = token_left[keep], owner_left[keep]
            own = token[starts[x] : starts[x + 1]]
            if not len(own) or not len(token_left):
                continue
            if (ends[own + 1] - ends[own]).sum() < len(token_left):
                met = np.concatenate([lists[ends[t] : ends[t + 1]] for t in own])
            else:
                marked[own] = True
                met = owner_left[marked[token_left]]
                marked[own] = False
            who, shared = np.unique(met, return_counts=True)
            near = who[left[who] & (shared >= similarity * (size[x] + size[who] - shared) - 1e-9)]
            left[near] = False
            out += [(x, y) for y in near.tolist()]
            todo += near.tolist()
    return out


def _bands(texts: DataFrame) -> DataFrame:
    """Of texts (th, id, text): th, id, the length of the text and the keys of its bands; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(shingles(t.as_py())) for t in b.column("text")]
            size = [len(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("th"), b.column("id"), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["th", "id", "size", "keys"])

    return stored(texts.mapInArrow(run, "th long, id long, size long, keys array<long>"), "bands")


def _candidates(bands: DataFrame) -> DataFrame:
    """Links (u, v) between the hashes of texts that share a band."""
    each = bands.select("th", F.explode("keys").alias("key"))
    least = each.groupBy("key").agg(F.min("th").alias("u"), F.max("th").alias("most")).where("u < most").select("key", "u")
    return each.join(stored(least, "shared-bands"), "key").where("th <> u").select("u", F.col("th").alias("v"))


def similar(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """Links (u, v) between hashes of texts (xxhash64) that join exactly what the similarity joins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("th"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))
    bands = _bands(texts)
    groups = stored(components(_candidates(bands)).withColumnRenamed("node", "th"), "candidates")
    own = bands.select("th", "id", "size").join(sized(groups), "th").groupBy("th", "root").agg(F.min("id").alias("id"), F.max("size").alias("size"))
    own = stored(own, "candidate-texts")
    parts = own.groupBy("root").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("parts"))
    dealt = own.join(parts, "root").withColumn("parts", F.greatest("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("th"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a chunk meets itself in each of its pairs
    dealt = dealt.where((F.col("part") != F.col("other")) | (F.col("parts") == 1))
    marks = stored(dealt.select("th", "id", "root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")), "candidate-chunks")
    rows = texts.join(sized(marks), ["th", "id"]).select("root", "lo", "hi", "th", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("th")  # rows alike in id and text
        th = pdf["th"].to_numpy(np.int64)
        pairs = forest([shingles(t) for t in pdf["text"]], similarity)
        return pd.DataFrame({"u": [th[x] for x, _ in pairs], "v": [th[y] for _, y in pairs]}, dtype="int64")

    return rows.groupBy("root", "lo", "hi").applyInPandas(compare, "u long, v long")
