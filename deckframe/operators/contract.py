"""The examiner's contract: records to defects, labels to levels, messages for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = {"none": 0, "minor": 1, "moderate": 2, "severe": 3}
#: Severities up to which a defect of a type is minor, and moderate.
CUTS = {"G1": (8.0, 32.0), "G2": (0.05, 0.2), "G3": (4.0, 16.0), "G4": (1.0, 4.0), "G5": (3.0, 12.0), "G6": (8.0, 16.0)}


def rank(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in RANKS.items()])


def score(levels: Column) -> Column:
    """1 less a fifth for each rank of an array of levels, not below 0."""
    return F.greatest(F.lit(0.0), 1 - 0.2 * F.aggregate(levels, F.lit(0), lambda s, x: s + F.coalesce(rank(x), F.lit(0))))


def severity_level(kind: Column, severity: Column, given: Column) -> Column:
    """minor, moderate or severe by the cuts of a type, moderate for types without; a level that is given wins."""
    out = F.lit("moderate")
    for k, (minor, moderate) in CUTS.items():
        out = F.when(kind == k, F.when(severity <= minor, "minor").when(severity <= moderate, "moderate").otherwise("severe")).otherwise(out)
    return F.coalesce(given, out)


def modality(name: Column, strict: bool = False) -> Column:
    """A, B, C or B_prime; others stay, or fail if strict."""
    fixed = F.when(name == "Bprime", F.lit("B_prime")).otherwise(name)
    return F.when(fixed.isin("A", "B", "C", "B_prime"), fixed).otherwise(F.raise_error(F.concat(F.lit("unknown modality: "), name)) if strict else fixed)


def messages(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its turns as role and content, the last assistant's answer apart."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    df = conversations.groupBy("conv_id").agg(turns.alias("t"))
    last = F.try_element_at(F.filter("t", lambda x: x["role"] == "assistant"), F.lit(-1))
    return df.select("conv_id", F.size("t").alias("n_turns"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), last["content"].alias("answer"))
