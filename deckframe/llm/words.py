"""Words and lines of a text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of characters other than these; matched as bytes or code points alike.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of ``text`` in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines of ``text`` between newlines; null has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")
