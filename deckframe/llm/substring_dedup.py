"""Substring dedup: repeated windows of ``WINDOW`` words, with a count-min prefilter.

First pass: each window is represented by the smallest hash of its runs of
``ANCHOR`` words. Equal windows have equal representatives, and a representative
stands for some twenty neighbouring windows, so counting it once where it begins
overestimates no less than counting windows and needs a twentieth of the cells. The
sketches of the partitions, ``DEPTH`` rows of counters that stop at two, are merged
cell by cell; the merged bits are of bounded size and are broadcast.

Second pass: windows whose representative was seen at most once, by the estimate,
can't occur in two documents and are left out; the others are grouped exactly by a
hash of 128 bits. The estimate never falls short, so no repeated window is lost.
What a task has gathered is combined before the shuffle: of equal windows only those
of the smallest id go on, and the others are decided on the spot, so a passage which
a third of all documents share comes to the grouping once from each task.

Defined results: null, empty or short texts have no window and stay whole; a null id
counts as larger than any other; rows with one id are one document for the
comparison, so they never remove each other's words; repeated rows come out alike;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckframe.llm.hashing import ONE, TWO, Hashed, U, blocks, mix, rolled

WINDOW = 50
#: Words in the runs that represent a window.
ANCHOR = 16
DEPTH = 2
#: Cells of a sketch row: at least four for each representative expected, within these bounds.
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 27
#: Bytes of text for one representative, about.
BYTES_A_CELL = 100
#: Cells in a slice of the sketch, the unit in which sketches are merged.
SLICE = 1 << 16
#: Windows that a task gathers before it combines them: some 80 bytes each at the peak.
GATHER = 1 << 20
#: Rows of a batch that a task sends on.
OUT_ROWS = 1 << 16

def _cells(anchor: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchor + U((row + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & U(cells - 1)).astype(np.int64)


def _begins(anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)


def _mark(one: np.ndarray, two: np.ndarray, cells: np.ndarray) -> None:
    """Count ``cells`` in two planes of bits: seen at least once, at least twice."""
    at, n = np.unique(cells, return_counts=True)
    if not len(at):
        return
    byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    byte = byte[first]
    new, again = np.bitwise_or.reduceat(bit, first), np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint8(0)), first)
    two[byte] |= again | (one[byte] & new)
    one[byte] |= new


def sketch(texts: DataFrame, size: int, cells: int) -> np.ndarray:
    """DEPTH rows of bits: the cells counted twice or more over all of ``texts`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.zeros((DEPTH, 2, cells // 8), np.uint8)  # a quarter of a byte for each cell and row
        for batch in batches:
            for _, _, data, ends in blocks(batch):
                h = Hashed(data, ends)
                doc, _, at = h.windows(size)
                anchor = h.anchors(size, ANCHOR)[at]
                anchor = anchor[_begins(anchor, doc)]
                for row in range(DEPTH):
                    _mark(*planes[row], _cells(anchor, row, cells))
        half = min(SLICE, cells) // 8
        for row in range(DEPTH):
            for i in range(0, cells // 8, half):
                one, two = planes[row, :, i : i + half]
                if one.any():
                    bits = one.tobytes() + two.tobytes()
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "slice": pa.array([i // half], pa.int32()), "bits": pa.array([bits], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = min(SLICE, cells) // 8
        merged: dict[tuple[int, int], list[np.ndarray]] = {}  # a share of the slices: the sketch is bounded
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["bits"], np.uint8)
                one, two = merged.setdefault((r["row"], r["slice"]), [np.zeros(half, np.uint8), np.zeros(half, np.uint8)])
                two |= x[half:] | (one & x[:half])
                one |= x[:half]
        for (row, part), (_, two) in merged.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "slice": pa.array([part], pa.int32()), "bits": pa.array([two.tobytes()], pa.binary())})

    schema = "row int, slice int, bits binary"
    merged = texts.mapInArrow(count, schema).repartition("row", "slice").mapInArrow(merge, schema)
    out = np.zeros((DEPTH, cells // 8), np.uint8)
    half = min(SLICE, cells) // 8
    for r in merged.toLocalIterator():  # DEPTH * cells bits in all
        out[r["row"], r["slice"] * half : (r["slice"] + 1) * half] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class _Gathered:
    """Windows of some documents, in the order in which they came."""

    def __init__(self) -> None:
        self.count, self.docs = 0, 0
        self.ranks: list[np.ndarray] = []
        self.ths: list[np.ndarray] = []
        self.windows: list[tuple[np.ndarray, ...]] = []  # document, place, two hashes

    def add(self, ranks: np.ndarray, ths: np.ndarray, doc: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        self.ranks.append(ranks)
        self.ths.append(ths)
        self.windows.append(((doc + self.docs).astype(np.int32), pos.astype(np.int32), h1, h2))
        self.docs += len(ranks)
        self.count += len(doc)

    def combined(self) -> Iterator[pa.RecordBatch]:
        """The windows of the smallest rank among equal ones, and as arrays the places of the others; this is empty then."""
        ranks, ths = np.concatenate(self.ranks), np.concatenate(self.ths)
        doc, pos, h1, h2 = (np.concatenate([w[i] for w in self.windows]) for i in range(4))
        self.__init__()
        order = np.lexsort((h2, h1))
        new = h1[order]
        new = np.concatenate([[True], new[1:] != new[:-1]])
        x = h2[order]
        new[1:] |= x[1:] != x[:-1]
        x = ranks[doc[order]]
        least = np.minimum.reduceat(x, np.flatnonzero(new))
        late = np.empty(len(order), bool)
        late[order] = x > least[np.cumsum(new) - 1]
        del x, least, new, order
        on = np.flatnonzero(~late)  # in order of documents still: what neighbours share packs well
        for i in range(0, len(on), OUT_ROWS):
            at = on[i : i + OUT_ROWS]
            none = pa.nulls(len(at), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ranks[doc[at]], ths[doc[at]], h1[at].view(np.int64), h2[at].view(np.int64), pos[at])] + [none], _FOUND)
        if not late.any():
            return
        rank, th, pos = ranks[doc[late]], ths[doc[late]], pos[late]
        del doc, h1, h2, late, on
        order = np.lexsort((pos, th, rank))
        rank, th, pos = rank[order], th[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (th[1:] != th[:-1])]))
        rank, th, ends = rank[first], th[first], np.concatenate([first[1:], [len(pos)]])
        own = mix(th.view(U) ^ mix(rank.view(U)))  # a key of its own for each document: nothing is left to compare
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(ends, first[i] + OUT_ROWS, side="right")))
            lists = pa.ListArray.from_arrays(pa.array((np.concatenate([first[i:j], ends[j - 1 : j]]) - first[i]).astype(np.int32)), pa.array(pos[first[i] : ends[j - 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(rank[i:j]), pa.array(th[i:j]), pa.array(own[i:j].view(np.int64)), pa.array(th[i:j]), pa.nulls(j - i, pa.int32()), lists], _FOUND)
            i = j


_FOUND = ["rank", "th", "h1", "h2", "pos", "starts"]


def repeated_windows(rows: DataFrame, size: int, cells: int) -> DataFrame:
    """Every window of ``rows`` (rank, th, text) that their sketch can't rule out, combined within tasks: rank, th, h1, h2, pos; or starts, decided ones of a document."""
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows.select("text"), size, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered()
        for batch in batches:
            ranks, ths = batch.column("rank").to_numpy(), batch.column("th").to_numpy()
            for i, j, data, ends in blocks(batch):
                h = Hashed(data, ends)
                doc, pos, at = h.windows(size)
                anchor = h.anchors(size, ANCHOR)[at]
                keep = np.ones(len(at), bool)
                for row in range(DEPTH):
                    keep &= _set(bits.value[row], _cells(anchor, row, cells))
                if keep.any():
                    doc, at = doc[keep], at[keep]
                    gathered.add(ranks[i:j], ths[i:j], doc, pos[keep], rolled(h.words, size, ONE)[at], rolled(h.words, size, TWO)[at])
                if gathered.count > GATHER:
                    yield from gathered.combined()
        if gathered.count:
            yield from gathered.combined()

    return rows.mapInArrow(run, "rank long, th long, h1 long, h2 long, pos int, starts array<int>")


def _cell_count(rows: DataFrame) -> int:
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    want = 4 * max(1, size // BYTES_A_CELL)
    return max(MIN_CELLS, min(MAX_CELLS, 1 << want.bit_length()))


def removals(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """Of rows (rank, th, text): rank, th, starts, the windows of each document that also start in one of smaller rank."""
    found = repeated_windows(rows, size, _cell_count(rows))
    same = Window.partitionBy("h1", "h2")
    over = found.withColumn("least", F.min("rank").over(same)).where(F.col("starts").isNotNull() | (F.col("rank") > F.col("least")))
    lists = over.select("rank", "th", F.coalesce("starts", F.array("pos")).alias("starts"))
    return lists.groupBy("rank", "th").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def dedup_substrings(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256."""
    text, last = F.col(text_col), F.lit((1 << 63) - 1)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), last).alias("rank"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text")
    )
    gone = removals(rows.select("rank", "th", "text"), size)
    joined = rows.join(gone, ["rank", "th"], "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "kept_sha256": []}
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                parts = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, removed = len(parts), 0
                if starts.is_valid:
                    s = starts.values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + size, -1)
                    covered = np.cumsum(edge[:n]) > 0
                    removed = int(covered.sum())
                    parts = [p for p, c in zip(parts, covered.tolist(), strict=True) if not c]
                kept = b" ".join(parts)
                for k, v in zip(out, (n, removed, kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["kept_sha256"], pa.string())],
                ["doc_id", *out],
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
