"""Chat formatting: cumulative snapshots collapse into the conversations they grow to.

A logged conversation that is a prefix of a longer one, or equal to one of smaller
id, adds nothing. Each prefix of each conversation gets a rolling hash: the running
sums, in four lanes of 32 bits, of the hashes of its turns with their places. The
prefixes are combined by hash, and an anti-join leaves the conversations that no
longer one continues; only those are rendered. Texts move once, for rendering.

Defined results: turns stand in the order of turn, role and the md5 of the text,
nulls first; a row that repeats another counts once; a null role reads "unknown" and
a null text is empty; rows without a conv_id belong to no conversation and are left
out; an empty table gives an empty result; other columns play no part. A rendered
conversation is one row and must fit in memory as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckframe.plans import sized, stored

TURN = "<|{role}|>\n{text}<|end|>\n"
_LOW = (1 << 32) - 1
_KEY = ["k", "s1", "s2", "s3", "s4"]


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Of distinct turns (conv_id, turn, role, digest): conv_id, n, and for each prefix its length k and rolling hash s1..s4."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    df = turns.withColumn("k", F.row_number().over(order))
    a, b = F.xxhash64("k", "role", "digest"), F.xxhash64("digest", "role", "k")
    lanes = [a.bitwiseAND(_LOW), F.shiftrightunsigned(a, 32), b.bitwiseAND(_LOW), F.shiftrightunsigned(b, 32)]
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(x).over(upto).alias(f"s{i + 1}") for i, x in enumerate(lanes)]
    return df.select("conv_id", "k", F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("n"), *sums)


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another."""
    each = stored(prefixes(_turns(conversations).select("conv_id", "turn", "role", "digest").distinct()), "prefixes")
    whole = F.when(F.col("k") == F.col("n"), F.col("conv_id"))
    reach = stored(each.groupBy(*_KEY).agg(F.max("n").alias("longest"), F.min(whole).alias("smallest")), "prefix-reach")
    t, r = each.where("k = n").alias("t"), reach.alias("r")
    same = [F.col(f"t.{c}") == F.col(f"r.{c}") for c in _KEY]
    beaten = (F.col("r.longest") > F.col("t.n")) | (F.col("r.smallest") < F.col("t.conv_id"))
    condition = beaten
    for s in same:
        condition = s & condition
    return t.join(r, condition, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(conversations: DataFrame, template: str = TURN) -> DataFrame:
    """conv_id, n_turns and rendered, for each conversation that stays."""
    kept = stored(maximal(conversations), "maximal")
    rows = _turns(conversations).join(sized(kept), "conv_id")
    turns = F.sort_array(F.collect_set(F.struct("turn", "role", "digest", "text")))
    head, tail = template.split("{role}")
    middle, tail = tail.split("{text}")
    shown = F.transform(turns, lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail)))
    return rows.groupBy("conv_id", "n_turns").agg(F.array_join(shown, "").alias("rendered"))
