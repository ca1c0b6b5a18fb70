"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming distance, components.

A fingerprint has 64 bits. Its bits are cut into blocks; two fingerprints at
``MAX_BITS`` differing bits or fewer agree on all blocks but that many, so for one
choice of the others both have the same key. There are as many blocks as keys need to
be a few bits longer than the number of fingerprints (``blocks_for``), so chance
neighbours stay few at any size. Fingerprints are first made distinct: exact copies,
however many, are one row from then on.

Keys that few fingerprints share are joined with themselves, and the distance is a
condition of that join; a pair counts under its first common choice only. Keys that
many share hold near copies of one text, and there all pairs would be quadratic:
such a key is dealt to pairs of chunks of bounded size, and each yields a spanning
forest of its links, which keeps the components and never lists the links. No key
meets in one task whole and none is left out.

Defined results: null and blank texts have fingerprint zero and link like any
other; a very long text is hashed whole, slice by slice; null ids get the smallest id that their component has, or null; repeated
rows come back as often as they are given; an empty table gives an empty result;
columns other than the two used play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.llm.components import components
from deckframe.llm.jaccard import similar
from deckframe.plans import fresh, sized, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Blocks at least, and bits of a key beyond those that number the fingerprints.
BLOCKS, SPARE_BITS = 5, 1
#: Members from which a key is dealt to chunks, and the size of these.
FEW = 32
CHUNK = 2048
#: Shingles whose bits are added up at once.
SLICE = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    parts = raw.split()  # bytes: the ASCII spaces only
    if not parts:
        return 0
    if len(parts) <= k:
        grams = [b" ".join(parts)]
    else:
        flat, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1).tolist()
        ends = (ends - 1).tolist()
        grams = (flat[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False))
    count, ones, h = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while len(part := np.fromiter((h(g, seed) for g in itertools.islice(grams, SLICE)), np.uint64)):
        count += len(part)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if len(part) < SLICE or isinstance(grams, list):
            break
    return int(np.packbits((2 * ones > count).astype(np.uint8)).view(">u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text that tells rows of one id apart), fp; one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp, pa.int64())], ["doc_id", "th", "fp"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def blocks_for(n: int) -> int:
    """The fewest blocks whose keys are ``SPARE_BITS`` bits longer than n needs."""
    blocks = BLOCKS
    while blocks < 12 and 64 * (blocks - MAX_BITS) / blocks < n.bit_length() + SPARE_BITS:
        blocks += 1
    return blocks


def _masks(count: int) -> list[int]:
    cuts = [round(i * 64 / count) for i in range(count + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(cuts)]
    return [_signed(sum(c)) for c in itertools.combinations(blocks, count - MAX_BITS)]


def _forest(fps: np.ndarray, split: int) -> list[tuple[int, int]]:
    """Links that keep together what is together under links of MAX_BITS; with ``split``, only links across it count."""
    n = len(fps)
    root = np.arange(n)
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 21) // max(n, 1))
    left, right = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    for a in range(left.start, left.stop, step):
        b = min(a + step, left.stop)
        i, j = np.nonzero(np.bitwise_count(fps[a:b, None] ^ fps[None, right]) <= MAX_BITS)
        i, j = i + a, j + right.start
        if not split:
            i, j = i[i < j], j[i < j]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[q] = p
                out.append((x, y))
    return out


def _chunk_links(pdf: pd.DataFrame) -> pd.DataFrame:
    fps, parts = pdf["fp"].to_numpy(np.int64), pdf["part"].to_numpy()
    order = np.argsort(parts, kind="stable")
    fps, parts = fps[order], parts[order]
    split = int(np.searchsorted(parts, parts[0], side="right")) if parts[0] != parts[-1] else 0
    pairs = _forest(fps.view(np.uint64), split)
    return pd.DataFrame({"u": [fps[x] for x, _ in pairs], "v": [fps[y] for _, y in pairs]}, dtype="int64")


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct longs ``fp`` that join exactly what distance MAX_BITS joins."""
    masks = _masks(blocks_for(fps.count()))
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    blocks = fps.select("fp", F.inline(tables))
    sizes = stored(blocks.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "block-sizes")
    shared = stored(blocks.join(sizes, ["t", "key"]), "blocks")

    def first(a: Column, b: Column) -> Column:
        """The first choice of blocks under which both have one key."""
        x = a.bitwiseXOR(b)
        out = F.lit(len(masks))
        for i, m in reversed(list(enumerate(masks))):
            out = F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(out)
        return out

    few = shared.where(F.col("n") <= FEW)
    a, b = few.alias("a"), few.alias("b")
    u, v = F.col("a.fp"), F.col("b.fp")
    close = (u < v) & (F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS)
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & close & (first(u, v) == F.col("a.t")))
    many = shared.where(F.col("n") > FEW).withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    many = many.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("t", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp")
    forest = many.groupBy("t", "key", "lo", "hi").applyInPandas(_chunk_links, "u long, v long")
    return pairs.select(u.alias("u"), v.alias("v")).union(forest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One row for each document: doc_id, th, fp, component_id (the smallest id reachable), keep.

    ``keep`` marks one row of each component, or all copies of that row if it is repeated.
    With ``similarity``, texts whose five-word shingles have that Jaccard similarity are linked as well.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    distinct = stored(rows.groupBy("fp").agg(F.min(F.struct(last.alias("id"), "doc_id", "th", "fp")).alias("first")), "distinct-fps")
    found = links(distinct.select("fp"))
    if similarity is not None:
        of = stored(rows.select("th", "fp").distinct(), "text-fps")
        u, v = (of.select(F.col("th").alias(c), F.col("fp").alias(f"{c}_fp")) for c in ("u", "v"))
        close = stored(similar(docs, text_col, similarity, id_col), "similar").join(u, "u").join(v, "v")
        found = found.union(close.select("u_fp", "v_fp"))
    roots = components(found)
    whole = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    whole = stored(whole, "fp-roots")
    best = whole.groupBy("root").agg(F.min("first").alias("best"))
    named = stored(whole.join(best, "root").select("fp", "best"), "fp-components")
    out = rows.join(named, "fp")
    keep = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("fp") == F.col("best.fp")) & (F.col("th") == F.col("best.th"))
    return out.select("doc_id", "th", "fp", F.col("best.doc_id").alias("component_id"), keep.alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays, that with the smallest id.

    Rows are marked by id and a hash of the text. While there are few marks they are
    broadcast and no text moves; of rows alike in both, which are few or none, one stays.
    """
    k, th = fresh(docs, "_key", "_text_hash")
    smallest = F.lit(-(1 << 63))
    marks = near_duplicates(docs, id_col, text_col, similarity).where("keep").groupBy(F.coalesce("doc_id", smallest).alias(k), F.col("th").alias(th)).agg(F.count("*").alias("_n"))
    marks = stored(marks, "kept")
    keyed = docs.withColumn(k, F.coalesce(F.col(id_col).cast("long"), smallest)).withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    once, often = marks.where("_n = 1").select(k, th), marks.where("_n > 1").select(k, th)
    out = keyed.join(sized(once), [k, th], "left_semi").select(*docs.columns)
    if not often.head(1):
        return out
    return out.unionByName(keyed.join(sized(often), [k, th], "left_semi").dropDuplicates([k, th]).select(*docs.columns))
