"""Colours on columns: parsing, CIELAB and the CIE76 difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_rgb(text: Column) -> Column:
    """``#rrggbb``, ``rgb(r,g,b)`` or ``r,g,b`` as struct(r, g, b) within 0..255; else null."""
    t = F.trim(text)
    hexed = t.rlike("^#[0-9A-Fa-f]{6}$")
    numbers = F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))
    listed = t.rlike(r"^(rgb\()?\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\)?$")
    at = lambda i: F.when(hexed, F.conv(F.substring(t, 2 + 2 * i, 2), 16, 10).cast("int")).when(listed, F.least(F.lit(255), F.get(numbers, F.lit(i)).cast("int")))
    return F.when(hexed | listed, F.struct(at(0).alias("r"), at(1).alias("g"), at(2).alias("b")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


#: sRGB to XYZ over the D65 white point, a row for each of x, y, z.
_XYZ = ((0.4124564 / 0.95047, 0.3575761 / 0.95047, 0.1804375 / 0.95047), (0.2126729, 0.7151522, 0.0721750), (0.0193339 / 1.08883, 0.1191920 / 1.08883, 0.9503041 / 1.08883))
_EDGE, _SLOPE = 216.0 / 24389.0, 24389.0 / 27.0


def lab_of(rgb: Sequence[int]) -> tuple[float, float, float]:
    """CIELAB (D65) of one sRGB colour."""
    linear = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    x, y, z = (t ** (1 / 3) if t > _EDGE else (t * _SLOPE + 16) / 116 for t in (sum(k * v for k, v in zip(row, linear, strict=True)) for row in _XYZ))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def with_lab(df: DataFrame, name: str, r: str, g: str, b: str) -> DataFrame:
    """``df`` with name_l, name_a and name_b, the CIELAB (D65) of three columns; null if one of them is.

    Each stage is a projection of plain arithmetic, so all of it stays in generated code.
    """
    linear = lambda c: F.when(c <= 0.04045 * 255, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    bend = lambda t: F.when(t > _EDGE, F.pow(t, F.lit(1.0 / 3.0))).otherwise((t * _SLOPE + 16.0) / 116.0)
    s, t, u = ([f"_{name}_{stage}{i}" for i in range(3)] for stage in "stu")
    df = df.withColumns({n: linear(F.col(c)) for n, c in zip(s, (r, g, b), strict=True)})
    df = df.withColumns({n: sum((F.col(c) * k for c, k in zip(s, row, strict=True)), F.lit(0.0)) for n, row in zip(t, _XYZ, strict=True)})
    df = df.withColumns({n: bend(F.col(c)) for n, c in zip(u, t, strict=True)})
    x, y, z = (F.col(c) for c in u)
    return df.withColumns({f"{name}_l": y * 116.0 - 16.0, f"{name}_a": (x - y) * 500.0, f"{name}_b": (y - z) * 200.0}).drop(*s, *t, *u)


def distance(a: str | Sequence[float], b: str | Sequence[float]) -> Column:
    """CIE76: the distance in CIELAB of two colours, each a name given to ``with_lab`` or three numbers."""
    parts = lambda c: [F.col(f"{c}_{x}") for x in "lab"] if isinstance(c, str) else [F.lit(float(v)) for v in c]
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(parts(a), parts(b), strict=True)), F.lit(0.0)))
