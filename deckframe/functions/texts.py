"""Scores, choices, names and numbers out of text, and numbers into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a detector's label that make a picture of a box.
PICTURES = ("image", "figure", "chart", "table", "seal", "formula")


def score(raw: Column) -> Column:
    """A judge's score within 0 and 100: of a JSON object, else after the word, else the first number of up to three digits; else null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^(?i)```(?:json)?\s*", ""), r"\s*```$", ""))
    whole = F.when(F.try_parse_json(text).isNotNull(), F.get_json_object(text, "$.score")).try_cast("double")
    named = F.nullif(F.regexp_extract(text, r"(?i)\"?score\"?\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    plain = F.nullif(F.regexp_extract(text, r"\b(\d{1,3}(?:\.\d+)?)\b", 1), F.lit("")).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(whole, named, plain))) + F.when(F.coalesce(whole, named, plain).isNotNull(), 0.0)


def better(object_: Column) -> Column:
    """a, b or tie of a recovered JSON object's field ``better``; else null."""
    pick = F.lower(F.trim(F.get_json_object(object_, "$.better")))
    return F.when(pick.isin("a", "b", "tie"), pick)


def yes(value: Column) -> Column:
    """True or false of an answer, null for any other."""
    v = value.cast("string")
    return F.when(v.isin("yes", "y", "true", "1"), True).when(v.isin("no", "n", "false", "0"), False)


def page_number(path: Column) -> Column:
    """The number of a page's image, by which pages are sorted: of ``deck-12.png`` 12; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"-(\d+)\.png$", 1), F.lit("")).try_cast("long"), F.lit(0))


def safe_id(value: Column, default: str = "artifact") -> Column:
    """Letters, digits, ``-`` and ``_``; any other character is an underscore, and none stands at the ends."""
    clean = F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def run_name(path: Column, prefix: str) -> Column:
    """(model, tag, condition) of a result file's name: prefix_model_tag_condition, a suffix aside."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(_rows\.jsonl|\.json)$", "")
    parts = F.split(F.substr(name, F.lit(len(prefix) + 2)), "_")
    return F.struct(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("tag"), F.array_join(F.slice(parts, 3, 99), "_").alias("condition"))


def sort_key(*columns: Column) -> list[Column]:
    """The order of reports: as text, nulls as empty text; numbers stand by their digits."""
    return [F.coalesce(c.cast("string"), F.lit("")) for c in columns]


def general(value: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no trailing zeros, in scientific form beyond them."""
    v = value.cast("double")
    science = F.format_string(f"%.{digits - 1}e", v)
    e = F.regexp_extract(science, r"e([+-]\d+)$", 1).try_cast("int")
    fixed = F.lit(None).cast("string")
    for k in range(-4, digits):
        fixed = F.when(e == k, F.format_string(f"%.{digits - 1 - k}f", v)).otherwise(fixed)
    strip = lambda c: F.when(c.contains("."), F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")).otherwise(c)
    mantissa = F.concat(strip(F.regexp_extract(science, "^(.*)e", 1)), F.regexp_extract(science, r"(e[+-]\d+)$", 1))
    return F.when(v == 0, "0").when(v.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(strip(fixed), mantissa))


def quoted(text: Column) -> Column:
    """Text as a Python literal: in single quotes, in double ones if it has single ones only; null is None."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    one = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.isNull(), "None").when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(one)


def picture_type(label: Column) -> Column:
    """image for a detector's label that names a picture, text otherwise."""
    return F.when(label.rlike("|".join(PICTURES)), "image").otherwise("text")


def named_in(evidence: Column, target: Column, text: Column) -> Column:
    """Does evidence name the target, or a third of the first six long words of its text?"""
    low = F.lower(evidence)
    words = F.slice(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: F.length(w) > 3), 1, 6)
    hits = F.size(F.filter(words, lambda w: low.contains(w)))
    enough = (F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 3)))
    return F.coalesce((F.length(target) > 0) & low.contains(F.lower(target)), F.lit(False)) | F.coalesce(enough, F.lit(False))
