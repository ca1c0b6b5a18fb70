"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled order, once for each time they may be
taken. A copy's virtual finish time is the source's words up to and with it over
the source's target; the queue takes copies by finish time until the budget of
words is spent, so every source is served in proportion to its target.

The targets use up the budget, so it runs out at time 1: copies up to then are taken
by their finish time alone, and those after it that could still fit are sorted
globally and cut where the budget ends. Running sums are prefix sums over sorted
ranges (``running``), so no window holds a source, an id or the corpus. What the queue
says of a source is how many of its words are taken, a number; a document is judged
by its own place against it, so no text is shuffled and none meets its copies.

Defined results: null text has size 0 and takes nothing; sources with no words
have target 0; null is a source of its own, in the last place; repeated rows and
null ids are documents like any other, each row for itself: rows of one id and size
follow each other by a hash of the row, and of rows alike in all columns some may be
taken more often; a very long text is one document of its size; other columns pass
through ``mixed_documents``, and names that clash with its own get an underscore; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckframe.plans import fresh, running, sized, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_COPIES = 2
#: Copies that finish this long before time 1 are taken without a look at the others.
MARGIN = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """Of a table (source, size): source, place, source_size, target; one row a source.

    The target is weight times the level at which the targets, each capped at
    ``copies`` times its source's size, use up the budget. This is where resharing
    the excess by weight ends. The windows run over the sources alone.
    """
    total = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = total.withColumn("place", F.row_number().over(by_name))
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("cap", copies * F.col("source_size").cast("double")).withColumn("full", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    df = df.withColumn("words", budget * F.sum("source_size").over(everything).cast("double"))
    df = df.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("open"))
    # with the sources before it full, the level does not fill this one; of such levels the first is the highest
    level = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything)
    df = df.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap"))))
    return df.select("source", "place", "source_size", "target")


#: The shuffled order of the documents of a source; the row's number tells rows alike apart.
_ORDER = ["key", "id", "size", "th"]


def _measured(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(doc_id: Column, text: Column, th: Column, more: Column | None = None) -> list[Column]:
    own = doc_id.cast("long")
    key = F.md5(F.coalesce(own.cast("string"), F.lit("")))
    size = _measured(text) if more is None else _measured(text) + more
    return [key.alias("key"), F.coalesce(own, F.lit(-(1 << 63))).alias("id"), size.alias("size"), th.alias("th")]


def _queue(docs: DataFrame, th: Column, weights: Sequence[float], budget: float, copies: int) -> tuple[DataFrame, DataFrame]:
    """The documents in their order (doc_id, source, place, key, id, size, th, upto), and the sources with words, those that the mix takes."""
    rows = docs.select("doc_id", "source", *_place(F.col("doc_id"), F.col("text"), th), F.monotonically_increasing_id().alias("row"))
    base = stored(rows, "mix-sizes")
    sources = stored(source_targets(base, weights, budget, copies), "mix-sources")
    b, s = base.alias("b"), sized(sources).alias("s")
    known = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "place", "source_size", "target")
    queue = running(known, ["place"], [*_ORDER, "row"], "size", "mix-queue")
    whole = (sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] or 0) * budget

    turns = F.explode(F.array(*[F.lit(i) for i in range(copies)]))
    end = F.col("upto") + F.col("turn") * F.col("source_size")
    each = queue.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("turn", turns).withColumn("end", end)
    sure = F.col("end") <= F.col("target") * (1 - MARGIN)
    first = stored(each.where(sure).groupBy("place").agg(F.sum("size").alias("sure")), "mix-sure")
    left = whole - (first.agg(F.sum("sure")).first()[0] or 0)
    late = each.where(~sure).join(sized(first), "place", "left").where(F.col("end") - F.coalesce("sure", F.lit(0)) <= left)
    late = late.select("place", *_ORDER, "row", "turn", (F.col("end").cast("double") / F.col("target")).alias("v"))
    served = running(late, [], ["v", "place", *_ORDER, "row", "turn"], "size", "mix-late").where(F.col("upto") <= left)
    more = served.groupBy("place").agg(F.sum("size").alias("more"))
    words = (F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("words")
    done = sources.join(first, "place", "left").join(more, "place", "left").select("place", "source", "source_size", "target", words)
    return queue, stored(done, "mix-done")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """Of documents (doc_id, source, text): doc_id, source, size, source_size, target, taken."""
    queue, sources = _queue(docs, F.xxhash64("text"), weights, budget, copies)
    served = queue.join(sized(sources.select("place", "words")), "place")
    turns = sum(F.when(F.col("upto") + i * F.col("source_size") <= F.col("words"), F.col("size")).otherwise(F.lit(0)) for i in range(copies))
    return served.select("doc_id", "source", "size", "source_size", "target", turns.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """The documents that the mix takes: the columns of ``docs``, then size, source_size, target, taken.

    The documents that a source gives in a turn are those up to a last one in its
    order. A row is compared with the last ones of its source; rows alike in all
    columns with a last one are counted, and as many as are taken are given again.
    """
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    th = F.xxhash64(*plain)
    queue, sources = _queue(docs, th, weights, budget, copies)
    own = F.struct(*_ORDER)
    given = queue.join(sized(sources.select("place", "words")), "place").where("size > 0")
    within = [F.col("upto") + i * F.col("source_size") <= F.col("words") for i in range(copies)]
    last = stored(given.groupBy("place").agg(*[F.max(F.when(w, own)).alias(f"last{i}") for i, w in enumerate(within)]), "mix-last")
    alike = given.join(sized(last), "place").groupBy("place")
    counts = [f for i, w in enumerate(within) for f in (F.count_if(own == F.col(f"last{i}")).alias(f"all{i}"), F.count_if((own == F.col(f"last{i}")) & w).alias(f"in{i}"))]
    marks = stored(sources.join(last, "place").join(alike.agg(*counts), "place"), "mix-marks")
    names = fresh(docs, "size", "source_size", "target", "taken")
    mark, measured, turns, part, n = fresh(docs, "_mark", "_order", "_turns", "_part", "_n")
    m = sized(marks.select(F.struct(*marks.columns).alias(mark)))
    df = docs.join(m, F.col("source").eqNullSafe(F.col(mark)["source"]))
    # never added; what depends on the row keeps filters and projections from being merged with this one, where each would measure again
    never = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    df = df.withColumn(measured, F.struct(*_place(F.col("doc_id"), F.col("text"), th, never)))
    p, at = F.col(measured), F.col(mark)
    whole = [(p < at[f"last{i}"]) | ((p == at[f"last{i}"]) & (at[f"in{i}"] == at[f"all{i}"])) for i in range(copies)]
    some = [(p == at[f"last{i}"]) & (at[f"in{i}"] < at[f"all{i}"]) for i in range(copies)]
    count = lambda conditions: sum((F.when(c, F.lit(1)).otherwise(F.lit(0)) for c in conditions), F.lit(0))
    df = df.withColumn(turns, count(whole)).withColumn(part, count(some) > 0)

    def out(x: DataFrame, times: Column) -> DataFrame:
        values = (p["size"], at["source_size"], at["target"], (times * p["size"]).cast("long"))
        x = x.select(*docs.columns, *[v.alias(name) for v, name in zip(values, names, strict=True)])
        return x.where(F.col(names[-1]) > 0)

    sure = out(df.where(~F.col(part)), F.col(turns))
    if not marks.where(" or ".join(f"in{i} < all{i}" for i in range(copies))).head(1):
        return sure
    same = [*docs.columns, mark, measured, turns]
    edge = df.where(part).groupBy(*same).agg(F.count("*").alias(n)).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    times = F.col(turns) + count([s & (F.col(n) <= at[f"in{i}"]) for i, s in enumerate(some)])
    return sure.union(out(edge, times))
