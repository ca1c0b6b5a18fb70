"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The items form an inverted index. BM25 weights are divided by the score an item has
for its own text, so a score is the share of an item that a passage covers and one
threshold serves all items. Each document is cut into passages that overlap by the
longest item; each passage, all its words, is a query. Items stand in blocks, the
same for all terms, and each term keeps its largest weight in each block that it
occurs in; blocks whose summed maxima stay below the threshold are passed over,
within the live ones cursors move document at a time with a pivot, and every item at
or above the threshold is retrieved. A retrieved item counts if shares of at least
``MIN_OVERLAP`` of the five-word shingles both of its question and of its answer
stand in the passage.

Documents are only mapped: nothing of them is shuffled. An index holds at most
``SHARD_ITEMS`` items, about 1 KB each for items of some fifty words, and one index
at a time is built on the driver and broadcast; more items take one pass over the
documents for each index, and passes are joined by document. Counts of terms, the
number of items, their mean length and the longest are taken over all items, so
results do not depend on how many indexes there are.

Defined results: words are runs of letters, digits and underscores in lower case;
null and empty texts have no passage and are clean; a very long text is cut into as
many passages as it takes; items without words are left out, items that repeat in
all columns count once, and an item without an id is reported with a null; an item
shorter than a shingle must stand whole; in an item given as one text the last
sentence is the answer, and one sentence alone is a question; null ids and repeated
rows of documents pass through; an empty table gives an empty result, no items leave
all documents clean; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.plans import stored

SHINGLE = 5
MIN_SCORE = 0.6
MIN_OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Items in a block with common maxima.
BLOCK_ITEMS = 4
#: Words of a passage, or twice the longest item if that is more.
PASSAGE = 140
#: Items in one index.
SHARD_ITEMS = 1 << 14
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item given as one text."""
    parts = [p for p in _SENTENCE.split(text or "") if tokens(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


def shingles(words: Sequence[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _overlap(part: set[tuple], words: Sequence) -> float:
    if not part:
        return 1.0
    found = set()
    for k in {len(g) for g in part}:
        found |= part & {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return len(found) / len(part)


class Hit(NamedTuple):
    item: int | None
    score: float
    start: int
    question: float
    answer: float


class Stats(NamedTuple):
    """Of all items: how many there are, words of each on average and at most, and items with each word."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


def stats_of(words: Sequence[list[str]]) -> Stats:
    return Stats(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), Counter(w for x in words for w in set(x)))


class Index:
    """Inverted index of items (id, question, answer); ``stats`` are theirs unless given."""

    def __init__(self, items: Sequence[tuple[int | None, str, str]], block: int = BLOCK_ITEMS, stats: Stats | None = None):
        items = [x for x in items if tokens(x[1]) or tokens(x[2])]
        self.ids = [i for i, _, _ in items]
        parts = [(tokens(q), tokens(a)) for _, q, a in items]
        words = [q + a for q, a in parts]
        n, mean, longest, df = stats or stats_of(words)
        self.terms = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
        self.parts = [tuple(np.array([self.terms[w] for w in p], np.int32) for p in qa) for qa in parts]
        term, item, weight = [], [], []
        for j, x in enumerate(words):
            own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(x) / mean)) for w, f in Counter(x).items()}
            whole = sum(own.values())
            term += [self.terms[w] for w in own]
            item += [j] * len(own)
            weight += [v / whole for v in own.values()]
        term, item, weight = np.array(term, np.int32), np.array(item, np.int32), np.array(weight, np.float64)
        order = np.lexsort((item, term))
        term, self.items, self.weights = term[order], item[order], weight[order]
        #: Postings of term t, by item, stand at starts[t] to starts[t + 1].
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.block, self.blocks = block, -(-len(items) // block)
        own_block = self.items // block
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (own_block[1:] != own_block[:-1])])) if len(term) else np.zeros(0, np.int64)
        #: Of each term, the blocks that it occurs in and its largest weight there, at bounds[t] to bounds[t + 1].
        self.block_ids = own_block[first]
        self.maxima = np.nextafter(np.maximum.reduceat(self.weights, first).astype(np.float32), np.float32(2)) if len(first) else np.zeros(0, np.float32)
        self.bounds = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.longest = longest
        self.passage = max(PASSAGE, 2 * self.longest)

    @property
    def postings(self) -> list[list[tuple[int, float]]]:
        spans = zip(self.starts[:-1], self.starts[1:], strict=True)
        return [list(zip(self.items[a:b].tolist(), self.weights[a:b].tolist(), strict=True)) for a, b in spans]

    def passages(self, n: int) -> range:
        """Starts of the passages of a text of n words; any run as long as an item lies in one."""
        step = self.passage - self.longest
        return range(0, max(1, n - self.longest) if n else 0, step)

    def search(self, terms: np.ndarray, least: float = MIN_SCORE) -> list[tuple[int, float]]:
        """All items that distinct ``terms`` score at ``least`` or more, by place in the index."""
        if not len(terms):
            return []
        a, b = self.bounds[terms], self.bounds[terms + 1]
        size = b - a
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        sums = np.bincount(self.block_ids[at], weights=self.maxima[at], minlength=self.blocks)
        out: list[tuple[int, float]] = []
        for x in np.flatnonzero(sums >= least - 1e-4).tolist():
            out += self._block(terms, x, least)
        return out

    def _block(self, terms: np.ndarray, b: int, least: float) -> Iterator[tuple[int, float]]:
        lo, hi = b * self.block, (b + 1) * self.block
        lists = []
        for t in terms.tolist():
            a, z = self.starts[t], self.starts[t + 1]
            a, z = a + self.items[a:z].searchsorted([lo, hi])
            if a < z:
                here = list(zip(self.items[a:z].tolist(), self.weights[a:z].tolist(), strict=True))
                lists.append([0, here, max(v for _, v in here)])
        while True:
            live = sorted((x for x in lists if x[0] < len(x[1])), key=lambda x: x[1][x[0]][0])
            bound, pivot = 0.0, None
            for x in live:
                bound += x[2]
                if bound >= least - 1e-9:
                    pivot = x[1][x[0]][0]
                    break
            if pivot is None:
                return
            if live[0][1][live[0][0]][0] == pivot:
                score = 0.0
                for x in live:
                    if x[1][x[0]][0] != pivot:
                        break
                    score += x[1][x[0]][1]
                    x[0] += 1
                if score >= least - 1e-9:
                    yield pivot, score
            else:
                for x in live:
                    if x[1][x[0]][0] >= pivot:
                        break
                    while x[0] < len(x[1]) and x[1][x[0]][0] < pivot:
                        x[0] += 1

    def hits(self, text: str | None) -> tuple[int, int, list[Hit]]:
        """Passages of a text, items retrieved for them, and the best verified hit of each item."""
        words = tokens(text)
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        starts, retrieved, best = self.passages(len(words)), 0, {}
        for s in starts:
            part = np.unique(ids[s : s + self.passage])
            if len(part) and part[0] < 0:
                part = part[1:]
            for j, score in self.search(part):
                retrieved += 1
                passage = ids[s : s + self.passage].tolist()
                question, answer = (_overlap(shingles(p.tolist()), passage) for p in self.parts[j])
                hit = Hit(self.ids[j], round(score, 4), s, round(question, 4), round(answer, 4))
                if min(question, answer) >= MIN_OVERLAP and (j not in best or (hit.score, -s) > (best[j].score, -best[j].start)):
                    best[j] = hit
        return len(starts), retrieved, sorted(best.values(), key=lambda h: (h.item is not None, h))


def _parts(rows: list, whole: bool) -> list[tuple[int | None, str, str]]:
    return [(r[0], *split_item(r[1])) if whole else (r[0], r[1] or "", r[2] or "") for r in rows]


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of ``items`` (item_id and text, or item_id, question and answer), of bounded size each."""
    whole = "question" not in items.columns
    names = ["item_id", *(["text"] if whole else ["question", "answer"])]
    rows = stored(items.select(*names).distinct(), "items")
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    if shards == 1:
        yield Index(_parts(rows.orderBy(*names).collect(), whole))
        return

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(q) + tokens(a) for _, q, a in _parts([tuple(r.values()) for r in b.to_pylist()], whole)]
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(found, pa.list_(pa.string()))], ["shard", "words"])

    shard = F.pmod(F.xxhash64(*names), F.lit(shards)).cast("int")
    words = stored(rows.select(*names, shard.alias("shard")).mapInArrow(split, "shard int, words array<string>").where(F.size("words") > 0), "item-words")
    n, total, longest = words.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    each = words.select("shard", F.explode(F.array_distinct("words")).alias("word"))
    counts = stored(each.groupBy("word").agg(F.count("*").alias("df")), "item-terms")
    for s in range(shards):
        own = each.where(F.col("shard") == s).select("word").distinct()
        df = {r[0]: r[1] for r in counts.join(own, "word").collect()}  # the words of one index
        mine = rows.where(shard == s).orderBy(*names).collect()
        yield Index(_parts(mine, whole), stats=Stats(n, total / max(1, n), longest, df))


_HIT = "struct<item_id:bigint,score:double,start:int,question_overlap:double,answer_overlap:double>"


def _with_hits(rows: DataFrame, shared: Broadcast[Index]) -> DataFrame:
    """``rows`` (doc_id, th, text) without the text, with n_passages, n_retrieved and hits of one index."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.hits(text.as_py()) for text in batch.column("text")]
            hits = [[dict(zip(("item_id", "score", "start", "question_overlap", "answer_overlap"), h, strict=True)) for h in x[2]] for x in found]
            arrays = [batch.column("doc_id"), batch.column("th"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(hits, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "n_passages", "n_retrieved", "hits"])

    kept = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kept}, th long, n_passages long, n_retrieved long, hits array<{_HIT}>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_passages, n_retrieved, contaminated and hits."""
    context = docs.sparkSession.sparkContext
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    passes: list[DataFrame] = []
    held: Broadcast[Index] | None = None
    for index in indexes(items):
        if held is not None:  # the pass before is done before the next index is shared
            passes[-1] = stored(passes[-1], "contamination")
            held.destroy()
        held = context.broadcast(index)
        passes.append(_with_hits(rows, held))
    columns = ["doc_id", "n_passages", "n_retrieved", (F.size("hits") > 0).alias("contaminated"), "hits"]
    if len(passes) == 1:
        return passes[0].select(*columns)
    own = reduce(DataFrame.union, [p.dropDuplicates(["doc_id", "th"]) for p in passes]).groupBy("doc_id", "th")
    own = own.agg(F.max("n_passages").alias("n_passages"), F.sum("n_retrieved").alias("n_retrieved"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    key = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("doc_id", "th")]
    return rows.select("doc_id", "th").alias("r").join(own.alias("o"), key[0] & key[1]).select("o.*").select(*columns)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified hit, columns untouched."""
    at = docs.columns.index(text_col)
    held: Broadcast[Index] | None = None
    for index in indexes(items):
        if held is not None:
            docs = stored(docs, "not-contaminated")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast[Index] = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.hits(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
