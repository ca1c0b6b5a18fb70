"""Nested decks to the flat tables of slides and elements that the operators read.

What an element's style and metadata say is taken from the first key that has it;
unknown keys play no part, and a value that does not parse is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.functions.colors import parse_rgb
from deckframe.plans import stored

#: The keys that carry a text's colour.
COLOUR_KEYS = ("color", "font_color", "fill_color", "rgb")


def _get(of: str, key: str, kind: str) -> Column:
    return F.try_variant_get(F.col(of), f"$.{key}", kind)


def _first(kind: str, *places: str) -> Column:
    return F.coalesce(*[_get(*p.split("."), kind) for p in places])


def _rgb(text: Column) -> Column:
    bare = F.when(text.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), text)).otherwise(text)
    return parse_rgb(bare)


def _named(colour: Column, prefix: str) -> list[Column]:
    return [colour[c].alias(f"{prefix}{c}") for c in "rgb"]


def slides_of(decks: DataFrame) -> DataFrame:
    """Of decks as ``sources.decks`` reads them: a row for each slide: slide_id (deck and slide), deck_id, slide_index, section, texture, and its background sr, sg, sb."""
    key = F.concat_ws("/", "deck_id", "slide_id")
    meta = F.col("slide_metadata")
    at = lambda k, kind="string": F.try_variant_get(meta, f"$.{k}", kind)
    texture = F.coalesce(at("texture_background"), at("background_texture"))
    return decks.select(key.alias("slide_id"), "deck_id", F.col("slide_index").cast("long").alias("slide_index"), at("section").alias("section"), (texture.isNotNull() & ~F.lower(texture).isin("", "false", "0")).alias("texture"), *_named(_rgb(at("background_color")), "s"), "width", "height")


def elements_of(decks: DataFrame) -> DataFrame:
    """A row for each element: slide_id, deck_id, pos, element_id, etype, text, the box, font, colours, expectations and groups as ``layout`` names them."""
    key = F.concat_ws("/", "deck_id", "slide_id").alias("slide_id")
    df = decks.select(key, "deck_id", F.posexplode("elements").alias("p", "e"))
    df = df.select("slide_id", "deck_id", F.col("p").cast("long").alias("pos"), "e.element_id", F.lower(F.coalesce("e.type", F.lit("shape"))).alias("etype"), F.coalesce("e.text", F.lit("")).alias("text"), *[F.col(f"e.bbox.{a}").cast("double").alias(b) for a, b in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))], F.coalesce("e.z", F.lit(0)).cast("long").alias("z"), F.col("e.style").alias("st"), F.col("e.metadata").alias("md"))
    box = lambda axis: F.coalesce(_get("md", f"expected_bbox.{axis}", "double"), F.when(_get("md", "expected_bbox.x", "double").isNull(), _get("md", f"placeholder_bbox.{axis}", "double")))
    group = lambda *places: F.nullif(_first("string", *places), F.lit(""))
    own = F.coalesce(*[_rgb(_get("st", k, "string")) for k in COLOUR_KEYS], _rgb(_get("md", "color", "string")))
    overflow = F.lower(_first("string", "st.overflow", "md.overflow"))
    return df.select(
        "slide_id", "deck_id", "pos", "element_id", "etype", "text", "x", "y", "w", "h", "z",
        _first("double", "st.font_size_pt", "st.font_size").alias("font"),
        box("x").alias("expected_x"), box("y").alias("expected_y"), _get("md", "expected_font_size_pt", "double").alias("expected_font"),
        group("md.alignment_group").alias("align_group"), group("md.text_level", "md.font_group").alias("font_group"), F.when(own.isNotNull(), group("md.color_group")).alias("color_group"),
        *_named(own, ""), *_named(_rgb(_first("string", "md.expected_color", "st.expected_color")), "e"),
        F.coalesce(F.nullif(_get("st", "text_box_capacity", "int"), F.lit(0)), _get("md", "text_box_capacity", "int")).alias("capacity"),
        _get("md", "rendered_text_width_px", "double").alias("measured_w"), _get("md", "rendered_text_height_px", "double").alias("measured_h"),
        (F.coalesce(overflow, F.lit("")) == "hidden").alias("hidden"), F.coalesce(_first("double", "st.opacity", "md.opacity"), F.lit(1.0)).alias("opacity"),
        (F.length(F.coalesce(_first("string", "st.fill_color"), F.lit(""))) > 0).alias("fill"), *_named(_rgb(_get("st", "background_color", "string")), "b"),
    )


def tables(decks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slides and elements, written: operators read them many times, and what reads nested values is worked out once."""
    return stored(slides_of(decks), "flat-slides"), stored(elements_of(decks), "flat-elements")
