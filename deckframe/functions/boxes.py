"""Box arithmetic on columns named x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: str, b: str) -> Column:
    """Intersection area of the boxes of two aliases."""
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{at}") + F.col(f"{a}.{size}"), F.col(f"{b}.{at}") + F.col(f"{b}.{size}")) - F.greatest(F.col(f"{a}.{at}"), F.col(f"{b}.{at}")))
    return side("x", "w") * side("y", "h")


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where the union is empty."""
    area = lambda t: F.greatest(F.lit(0.0), F.col(f"{t}.w")) * F.greatest(F.lit(0.0), F.col(f"{t}.h"))
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / F.when(union > 0, union)).otherwise(F.lit(0.0))


#: Points of a text that says none.
FONT = 24.0


def capacity(given: Column, w: Column, h: Column, font: Column) -> Column:
    """Characters that fit: the given number if there is one, else characters a line times lines."""
    font = F.coalesce(font, F.lit(FONT))
    a_line = F.greatest(F.lit(1), F.floor(w / F.greatest(F.lit(1.0), font * 0.55)))
    rows = F.greatest(F.lit(1), F.floor(h / F.greatest(F.lit(1.0), font * 1.25)))
    return F.when(given.isNotNull(), F.greatest(F.lit(0), given)).otherwise(a_line * rows)  # greatest passes over nulls


def text_overflow(text: Column, given: Column, w: Column, h: Column, font: Column, measured_w: Column, measured_h: Column) -> Column:
    """Pixels of text beyond its box: measured if measured, else from the characters in excess."""
    has = lambda c: F.coalesce(c != 0, F.lit(False))
    over = lambda m, size: F.when(has(m), F.greatest(F.lit(0.0), m - size)).otherwise(F.lit(0.0))
    extra = F.greatest(F.lit(0), F.length(text) - capacity(given, w, h, font))
    return F.when(has(measured_w) | has(measured_h), F.greatest(over(measured_w, w), over(measured_h, h))).otherwise(extra * F.coalesce(font, F.lit(FONT)) * 0.55)
