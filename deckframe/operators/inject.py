"""Injected defects and their repair, over tables of elements and slides.

An injector returns what it changes: one row for each slide (or deck) that it can
change, with the changed element or slide, the new values, ``severity`` and
``targets``. ``applied`` puts the changes into the elements. A slide that lacks what
an injector needs has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckframe.functions.boxes import capacity
from deckframe.functions.colors import distance, lab_of, with_lab
from deckframe.operators import layout
from deckframe.plans import sized, stored

WIDTH, HEIGHT = 1920.0, 1080.0
#: Hues of off-brand colours, and the colour of text that has none.
HUES = ((203, 36, 41), (26, 95, 180), (38, 162, 105), (224, 120, 20), (129, 61, 156))
#: Default severities, and severities of the synthetic grid.
DEFAULTS = {"G1": 32.0, "G2": 0.1, "G3": 16.0, "G4": 4.0, "G5": 24.0, "G6": 16.0, "S1": 1.0, "S4": 90.0, "S6": 1.0}
TEXTS = ("text", "body", "textbox", "placeholder")


def _first(elements: DataFrame, condition: Column | None, *columns: str) -> DataFrame:
    """The first element of each slide that fits: slide_id, pos and ``columns``."""
    rows = elements if condition is None else elements.where(condition)
    return rows.groupBy("slide_id").agg(F.min_by(F.struct("pos", *columns), "pos").alias("e")).select("slide_id", "e.*")


def _has_text() -> Column:
    return (F.length("text") > 0) | F.col("etype").isin("text", "textbox", "placeholder")


def _first_of_role(elements: DataFrame, role: str, *columns: str, text: bool = True) -> DataFrame:
    """The first element of a role or, without one, the first element (with text)."""
    own = _first(elements, F.col("etype") == role, *columns)
    rest = _first(elements, _has_text() if text else None, *columns)
    fields = ["pos", *columns]
    both = rest.alias("r").join(own.alias("o"), "slide_id", "full")
    return both.select("slide_id", *[F.when(F.col("o.pos").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in fields])


def applied(elements: DataFrame, changes: DataFrame, *columns: str) -> DataFrame:
    """``elements`` with the values of ``columns`` that ``changes`` (slide_id, pos) has."""
    new = changes.select("slide_id", "pos", *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    df = elements.join(new, ["slide_id", "pos"], "left")
    return df.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*elements.columns)


def text_overflow(elements: DataFrame, overflow: float = 32.0, seed: int = 7) -> DataFrame:
    """Filler before or after the first text, by a seeded coin, in a box that only held the text: text, w, measured_w."""
    df = _first(elements, _has_text(), "text", "w", "font")
    a_char = F.col("font") * 0.55
    filler = F.repeat(F.lit("X"), F.greatest(F.lit(1), F.floor(overflow / F.greatest(F.lit(1.0), a_char)) + 2).cast("int"))
    after = F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("slide_id").cast("string"))), 1, 1) < "8"
    longer = F.when(after, F.concat("text", F.lit(" "), filler)).otherwise(F.concat(filler, F.lit(" "), F.col("text")))
    df = df.withColumn("snug", F.least("w", F.greatest(a_char, F.length("text") * a_char))).withColumn("text", longer)
    return df.select("slide_id", "pos", "text", F.col("snug").alias("w"), (F.length("text") * a_char).alias("measured_w"), F.lit(overflow).alias("severity"), F.array("pos").alias("targets"))


def overlap(elements: DataFrame, severity: float = 0.1) -> DataFrame:
    """The first element of a slide is moved onto the second: x and y; the severity is the overlap that results."""
    rows = elements.groupBy("slide_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "w", "h"))), 1, 2).alias("e")).where(F.size("e") == 2)
    a, b = F.col("e")[0], F.col("e")[1]
    shared = F.least(a["w"], b["w"]) * max(0.1, min(0.8, severity * 2))
    df = rows.select("slide_id", a["pos"].alias("pos"), b["pos"].alias("other"), (b["x"] + b["w"] - shared).alias("x"), b["y"].alias("y"), a["w"].alias("w"), a["h"].alias("h"), b["x"].alias("x2"), b["w"].alias("w2"), b["h"].alias("h2"))
    side = lambda lo, size, lo2, size2: F.greatest(F.lit(0.0), F.least(lo + size, lo2 + size2) - F.greatest(lo, lo2))
    both = side(F.col("x"), F.col("w"), F.col("x2"), F.col("w2")) * F.least("h", "h2")
    union = F.col("w") * F.col("h") + F.col("w2") * F.col("h2") - both
    return df.select("slide_id", "pos", "x", "y", F.when(union > 0, both / union).otherwise(0.0).alias("severity"), F.array("pos", "other").alias("targets"))


def column_middle(elements: DataFrame, *columns: str, members: int = 3) -> DataFrame:
    """The middle by height of the largest column of a slide: texts of one type at one rounded x, ``members`` or more.

    Of equally large columns the one that starts first counts.
    """
    key = ["slide_id", "etype", "col"]
    rows = elements.where(F.col("etype").isin(*TEXTS) & (F.length("text") > 0)).withColumn("col", F.bround("x"))
    each = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("y", "pos", *columns))).alias("m")).where(F.col("n") >= members)
    best = each.groupBy("slide_id").agg(F.max_by(F.struct("n", "m"), F.struct("n", -F.col("start"))).alias("b"))
    middle = F.element_at("b.m", (F.floor(F.col("b.n") / 2) + 1).cast("int"))
    return best.select("slide_id", middle.alias("e"), F.transform("b.m", lambda x: x["pos"]).alias("members")).select("slide_id", "e.*", "members").drop("y")


def alignment_offset(elements: DataFrame, offset: float = 16.0) -> DataFrame:
    """The middle of the largest column is shifted right; without a column the first element, whose place is then expected: x, expected_x, mode."""
    inner = column_middle(elements, "x").select("slide_id", "pos", (F.col("x") + offset).alias("x"), F.lit(None).cast("double").alias("expected_x"), F.lit("internal").alias("mode"))
    rest = _first(elements, None, "x", "expected_x").join(inner.select("slide_id"), "slide_id", "left_anti")
    outer = rest.select("slide_id", "pos", (F.col("x") + offset).alias("x"), F.coalesce("expected_x", "x").alias("expected_x"), F.lit("absolute").alias("mode"))
    return inner.unionByName(outer).withColumn("severity", F.lit(offset)).withColumn("targets", F.array("pos"))


def page_offset(elements: DataFrame, margin: float = 16.0) -> DataFrame:
    """All elements of a slide move together until the leftmost stands ``margin`` from the edge: a row for each element."""
    least = F.min("x").over(Window.partitionBy("slide_id"))
    return elements.select("slide_id", "pos", (F.col("x") - least + margin).alias("x"), (least - margin).alias("severity"))


def margin_bleed(elements: DataFrame, bleed: float = 16.0, side: str = "left", margin: float = 32.0) -> DataFrame:
    """The first element crosses the margin of one side by ``bleed``: x and y."""
    moves = {"left": ("x", F.lit(margin - bleed)), "top": ("y", F.lit(margin - bleed)), "right": ("x", WIDTH - margin + bleed - F.col("w")), "bottom": ("y", HEIGHT - margin + bleed - F.col("h"))}
    name, value = moves[side]
    df = _first(elements, None, "x", "y", "w", "h").withColumn(name, value)
    return df.select("slide_id", "pos", "x", "y", F.lit(bleed).alias("severity"), F.array("pos").alias("targets"))


def font_delta(elements: DataFrame, delta: float = 4.0) -> DataFrame:
    """The first text grows by ``delta`` points and remembers its size: font, expected_font."""
    df = _first(elements, _has_text(), "font")
    return df.select("slide_id", "pos", (F.col("font") + delta).alias("font"), F.col("font").alias("expected_font"), F.lit(abs(delta)).alias("severity"), F.array("pos").alias("targets"))


_RGB = ("r", "g", "b")


def _closest(candidates: DataFrame, keys: Sequence[str], delta: float) -> DataFrame:
    """Of candidates (keys, r0..b0, step, r, g, b) the first of those whose distance to r0, g0, b0 is nearest to ``delta``: r, g, b, realized."""
    df = with_lab(with_lab(candidates, "base", "r0", "g0", "b0"), "own", *_RGB).withColumn("realized", distance("base", "own"))
    best = F.min_by(F.struct(*_RGB, "realized"), F.struct(F.abs(F.col("realized") - delta), F.col("step")))
    return df.groupBy(*keys).agg(best.alias("c")).select(*keys, "c.*")


def hue_at(colours: DataFrame, delta: float, steps: int = 200) -> DataFrame:
    """Of colours (r0, g0, b0, hue): the point on the way to the hue whose distance is nearest to ``delta``; the first of equal ones."""
    hues = F.array(*[F.array(*[F.lit(v) for v in h]) for h in HUES])
    t = F.col("step") / float(steps)
    rows = colours.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    rows = rows.withColumns({c: F.bround(F.col(f"{c}0") + (F.get(F.get(hues, F.col("hue")), F.lit(i)) - F.col(f"{c}0")) * t).cast("int") for i, c in enumerate(_RGB)})
    return _closest(rows, ["r0", "g0", "b0", "hue"], delta)


def ray_at(colours: DataFrame, delta: float, steps: int = 442) -> DataFrame:
    """Of colours (r0, g0, b0): the step towards the middle of each channel nearest to ``delta``, up to the first that reaches it."""
    rows = colours.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    axis = lambda c: F.when(F.col(c) >= 128, -1).otherwise(1)
    rows = rows.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(f"{c}0") + axis(f"{c}0") * F.col("step"))).cast("int") for c in _RGB})
    key = ["r0", "g0", "b0"]
    far = with_lab(with_lab(rows, "base", *key), "own", *_RGB).withColumn("far", distance("base", "own")).select(*key, "step", *_RGB, "far")
    stop = far.where(F.col("far") >= delta).where("step > 0").groupBy(*key).agg(F.min("step").alias("stop"))
    kept = far.join(stop, key, "left").where(F.col("step") <= F.coalesce("stop", F.lit(steps))).drop("far", "stop")
    return _closest(kept, key, delta)


def brand_colour(elements: DataFrame, delta: float = 24.0) -> DataFrame:
    """The middle of the largest column gets a hue at a distance; without a column the first element is drawn away from its colour: r, g, b, mode."""
    one = column_middle(elements, *_RGB)
    letters = F.split(F.concat(F.lit("e"), F.col("pos").cast("string")), "")
    hue = F.pmod(F.aggregate(F.transform(letters, lambda x: F.ascii(x)), F.lit(0), lambda s, x: s + x), F.lit(len(HUES)))
    renamed = {c: F.col(c).alias(f"{c}0") for c in _RGB}
    one = one.select("slide_id", "pos", hue.alias("hue"), *renamed.values())
    table = stored(hue_at(one.select("r0", "g0", "b0", "hue").distinct(), delta), "hues")
    inner = one.join(sized(table), ["r0", "g0", "b0", "hue"]).withColumn("mode", F.lit("internal"))
    rest = _first(elements, None, *_RGB).join(one.select("slide_id"), "slide_id", "left_anti").select("slide_id", "pos", *renamed.values())
    table = stored(ray_at(rest.select("r0", "g0", "b0").distinct(), delta), "rays")
    outer = rest.join(sized(table), ["r0", "g0", "b0"]).withColumn("mode", F.lit("absolute"))
    names = ["slide_id", "pos", *_RGB, F.round("realized", 6).alias("severity"), F.array("pos").alias("targets"), "mode"]
    return inner.select(*names).unionByName(outer.select(*names))


def title_mismatch(elements: DataFrame) -> DataFrame:
    """The title says that it is unrelated, with the start of the body: text."""
    title = _first_of_role(elements, "title").select("slide_id", "pos")
    body = _first_of_role(elements, "text", "text").select("slide_id", F.col("pos").alias("body"), "text")
    text = F.concat(F.lit("Unrelated: "), F.substring(F.coalesce(F.nullif("text", F.lit("")), F.lit("Unrelated implementation details")), 1, 80))
    return title.join(body, "slide_id").select("slide_id", "pos", text.alias("text"), F.lit(1.0).alias("severity"), F.array("pos", "body").alias("targets"))


def density(elements: DataFrame, target_words: int = 90, max_words: int = 50) -> DataFrame:
    """The first text is filled up to ``target_words``: text, max_words."""
    df = _first(elements, _has_text(), "text").withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    filler = F.when(F.size("words") < target_words, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), target_words - F.size("words") - 1)), lambda i: F.concat(F.lit("detail"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return df.select("slide_id", "pos", F.array_join(F.concat("words", filler), " ").alias("text"), F.lit(max_words).alias("max_words"), F.lit(float(target_words)).alias("severity"), F.array("pos").alias("targets"))


def contradiction(elements: DataFrame, role: str = "image", claim: str = "three-layer architecture") -> DataFrame:
    """The body denies what a diagram claims: text."""
    figure = _first_of_role(elements, role, text=False).select("slide_id", F.col("pos").alias("figure"))
    body = _first_of_role(elements, "text").select("slide_id", "pos")
    text = F.lit(f"This slide describes a contradictory single-layer architecture, not {claim}.")
    return figure.join(body, "slide_id").select("slide_id", "pos", text.alias("text"), F.lit(1.0).alias("severity"), F.array("figure", "pos").alias("targets"))


def order_break(slides: DataFrame) -> DataFrame:
    """The first two slides of each deck change places: slide_id, deck_id, slide_index."""
    many = F.count("*").over(Window.partitionBy("deck_id")) > 1
    i = F.col("slide_index")
    return slides.withColumn("_many", many).where("_many").select("deck_id", "slide_id", F.when(i == 0, 1).when(i == 1, 0).otherwise(i).cast("long").alias("slide_index"))


def term_variant(slides: DataFrame, elements: DataFrame, canonical: str, variant: str) -> DataFrame:
    """On the last slide of each deck a term becomes its variant; where it does not occur, the first text names the variant: text."""
    last = slides.groupBy("deck_id").agg(F.max_by("slide_id", "slide_index").alias("slide_id"))
    own = elements.join(last.select("slide_id"), "slide_id", "left_semi")
    told = own.where(F.col("text").contains(canonical)).select("slide_id", "pos", F.replace("text", F.lit(canonical), F.lit(variant)).alias("text"), F.lit("replaced").alias("mode"))
    rest = _first(own, _has_text(), "text").join(told.select("slide_id"), "slide_id", "left_anti")
    return told.unionByName(rest.select("slide_id", "pos", F.concat("text", F.lit(f" {variant}")).alias("text"), F.lit("appended").alias("mode")))


def missing_section(slides: DataFrame, section: str) -> DataFrame:
    """The first slide of a section, of each deck that has one, which goes: deck_id, slide_id."""
    return slides.where(F.col("section") == section).groupBy("deck_id").agg(F.min_by("slide_id", "slide_index").alias("slide_id"))


def _page(elements: DataFrame, margin: float) -> DataFrame:
    return page_offset(elements, margin).groupBy("slide_id").agg(F.max("severity").alias("severity"), F.array_sort(F.collect_list("pos")).alias("targets"))


#: The injector of each type, which takes elements and a severity.
INJECTORS: dict[str, Callable[[DataFrame, float], DataFrame]] = {
    "G1": text_overflow,
    "G2": overlap,
    "G3": alignment_offset,
    "G4": font_delta,
    "G5": brand_colour,
    "G6": _page,
    "S1": lambda elements, _: title_mismatch(elements),
    "S4": lambda elements, words: density(elements, int(words)),
    "S6": lambda elements, _: contradiction(elements),
}


def slide_labels(elements: DataFrame, cells: Sequence[tuple[str, float]] = tuple(DEFAULTS.items())) -> DataFrame:
    """slide_id, type, level, severity, targets: the label of each slide that can be changed, for each type and level asked for; severity is what results."""
    made = [INJECTORS[kind](elements, level).select("slide_id", F.lit(kind).alias("type"), F.lit(float(level)).alias("level"), F.col("severity").cast("double").alias("severity"), "targets") for kind, level in cells]
    return reduce(DataFrame.unionByName, made)


# --- repair ---------------------------------------------------------------------------------------------------------


def _flags(elements: DataFrame) -> DataFrame:
    return layout.lint(elements).groupBy("slide_id", "pos").agg(F.collect_set("detector").alias("flags"))


def _moved_apart(elements: DataFrame, gap: float = 16.0) -> DataFrame:
    """New x and y of the first of each overlapping pair: right of the other or, if they still touch, below it, one pair after the other."""
    e = elements.select("slide_id", "pos", "x", "y", "w", "h")
    pairs = layout.overlapping(elements).select("slide_id", "pos", "other")
    second = e.select("slide_id", F.col("pos").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xywh"])
    met = pairs.join(second, ["slide_id", "other"]).groupBy("slide_id", "pos").agg(F.array_sort(F.collect_list(F.struct("other", "ox", "oy", "ow", "oh"))).alias("others"))
    df = e.join(met, ["slide_id", "pos"])
    low = F.lit(gap)

    def step(at: Column, o: Column) -> Column:
        w, h = F.col("w"), F.col("h")
        x = F.least(F.greatest(low, o["ox"] + o["ow"] + gap), F.greatest(low, WIDTH - w - gap))
        touch = (F.least(x + w, o["ox"] + o["ow"]) > F.greatest(x, o["ox"])) & (F.least(at["y"] + h, o["oy"] + o["oh"]) > F.greatest(at["y"], o["oy"]))
        y = F.when(touch, F.least(F.greatest(low, o["oy"] + o["oh"] + gap), F.greatest(low, HEIGHT - h - gap))).otherwise(at["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    at = F.aggregate("others", F.struct(F.col("x").alias("x"), F.col("y").alias("y")), step)
    return df.select("slide_id", "pos", at.alias("at")).select("slide_id", "pos", F.col("at.x").alias("new_x"), F.col("at.y").alias("new_y"))


def repaired(elements: DataFrame, margin: float = 32.0) -> DataFrame:
    """``elements`` after the repair of every finding, in the order of the detectors.

    Text is cut to its capacity; of overlapping pairs the first moves; misplaced
    elements go to their expected place, if they have one; fonts and colours become
    the expected ones, colours else the nearest of the palette, and then the most
    common of their group; at last elements are held within the margin.
    """
    c = F.col
    df = elements.join(_flags(elements), ["slide_id", "pos"], "left").join(_moved_apart(elements), ["slide_id", "pos"], "left")
    flag = lambda name: F.coalesce(F.array_contains("flags", name), F.lit(False))
    held = capacity(c("capacity"), c("w"), c("h"), c("font"))
    over, off, edge = flag("overflow"), flag("alignment"), flag("margin")
    inside = lambda v, size, limit: F.least(F.greatest(v, F.lit(margin)), limit - margin - c(size))
    place = lambda n: F.when(off, F.coalesce(f"expected_{n}", f"new_{n}", n)).otherwise(F.coalesce(f"new_{n}", n))
    df = df.withColumns({"_x": place("x"), "_y": place("y")})
    brand = _palette_of(elements)
    most = _majority(elements)
    df = df.join(brand, ["slide_id", "pos"], "left").join(most, ["slide_id", "pos"], "left")
    new = {
        "text": F.when(over, F.substr("text", F.lit(1), held.cast("int"))).otherwise(c("text")),
        "measured_w": F.when(over, F.lit(None)).otherwise(c("measured_w")),
        "measured_h": F.when(over, F.lit(None)).otherwise(c("measured_h")),
        "x": F.when(edge, inside(c("_x"), "w", WIDTH)).otherwise(c("_x")),
        "y": F.when(edge, inside(c("_y"), "h", HEIGHT)).otherwise(c("_y")),
        "font": F.when(flag("font"), F.coalesce("expected_font", "font")).otherwise(c("font")),
        "expected_font": F.when(flag("font"), F.lit(None)).otherwise(c("expected_font")),
    }
    tinted = flag("palette")
    for name in _RGB:
        first = F.when(tinted, F.coalesce(f"e{name}", f"brand_{name}", name)).otherwise(c(name))
        new[name] = F.when(flag("color_group"), F.coalesce(F.when(~tinted, c(f"e{name}")), c(f"most_{name}"), first)).otherwise(first).cast("int")
    done = {f"e{name}": F.when(tinted | flag("color_group"), F.lit(None)).otherwise(c(f"e{name}")) for name in _RGB}
    kinds = dict(elements.dtypes)
    return df.select(*[{**new, **done}[n].cast(kinds[n]).alias(n) if n in new or n in done else c(n) for n in elements.columns])


def _palette_of(elements: DataFrame, palette: tuple = layout.PALETTE) -> DataFrame:
    """The nearest colour of the palette, the first of equal ones: brand_r, brand_g, brand_b."""
    table = with_lab(elements.select(*_RGB).distinct(), "own", *_RGB)
    near = F.array_min(F.array(*[F.struct(distance("own", lab_of(p)).alias("off"), F.lit(i).alias("i"), *[F.lit(v).alias(f"brand_{n}") for n, v in zip(_RGB, p, strict=True)]) for i, p in enumerate(palette)]))
    table = sized(stored(table.select(*_RGB, near.alias("n")).select(*_RGB, "n.brand_r", "n.brand_g", "n.brand_b"), "brand"))
    return elements.select("slide_id", "pos", *_RGB).join(table, list(_RGB)).drop(*_RGB)


def _majority(elements: DataFrame) -> DataFrame:
    """The most common colour of an element's group, of equal ones that which comes first: most_r, most_g, most_b."""
    own = elements.where(F.col("color_group").isNotNull()).select("slide_id", "pos", "color_group", *_RGB)
    counts = own.groupBy("slide_id", "color_group", *_RGB).agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    top = counts.groupBy("slide_id", "color_group").agg(F.max_by(F.struct(*[F.col(n).alias(f"most_{n}") for n in _RGB]), F.struct("c", -F.col("p"))).alias("m"))
    return own.select("slide_id", "pos", "color_group").join(top, ["slide_id", "color_group"]).select("slide_id", "pos", "m.*")


def repair_passes(elements: DataFrame) -> DataFrame:
    """slide_id, found and left (types before and after the repair) and passes: no type that was found is left."""
    types = lambda e, name: layout.lint(e).groupBy("slide_id").agg(F.array_sort(F.collect_set(F.when(F.col("detector").isin("palette", "color_group"), "color").otherwise(F.col("detector")))).alias(name))
    fixed = stored(repaired(elements), "repaired")
    none = F.array().cast("array<string>")
    df = elements.select("slide_id").distinct().join(types(elements, "found"), "slide_id", "left").join(types(fixed, "left"), "slide_id", "left")
    df = df.withColumns({n: F.coalesce(n, none) for n in ("found", "left")})
    return df.withColumn("passes", ~F.arrays_overlap("found", "left"))


# --- synthetic manifests ---------------------------------------------------------------------------------------------

#: The types in their order, with the severities of the grid.
GRID = {"G1": (8.0, 16.0, 32.0, 64.0), "G2": (0.05, 0.1, 0.2, 0.4), "G3": (4.0, 8.0, 16.0, 32.0), "G4": (1.0, 2.0, 4.0, 8.0), "G5": (3.0, 6.0, 12.0, 24.0), "G6": (4.0, 8.0, 16.0, 32.0), "S1": (1.0,), "S4": (60.0, 90.0, 120.0), "S6": (1.0,)}


def cells(spark, repetitions: int, slides: int, held_types: tuple[str, ...] = (), held_severities: tuple[float, ...] = (), grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """Every type, severity and repetition with the place of its base slide and its split."""
    rows = [(o, k, s, r, (r + int(s * 10)) % slides) for o, (k, severities) in enumerate(grid.items()) for s in severities for r in range(repetitions)]
    df = spark.createDataFrame(rows, "kind_order int, type string, severity double, repetition int, base int")
    bucket = (F.col("kind_order") + F.floor(F.col("severity") * 100)) % 10
    split = F.when(F.col("type").isin(*held_types), "ood_defect").when(F.col("severity").isin(*held_severities), "ood_severity").when(bucket < 7, "train").when(bucket < 9, "val").otherwise("test")
    return df.withColumn("split", split)


def synthetic_manifest(slides: DataFrame, elements: DataFrame, repetitions: int = 2, negative_ratio: float = 0.5, held_types: tuple[str, ...] = (), held_severities: tuple[float, ...] = ()) -> DataFrame:
    """sample_id, slide_id, type, severity, realized, split: a sample for each cell that its slide allows, then clean ones.

    Cells take slides by place in the order of their ids; only the first so many are
    read as there are places. Clean samples go round the slides.
    """
    n = slides.count()
    if not n:
        return slides.sparkSession.createDataFrame([], "sample_id string, slide_id long, type string, severity double, realized double, split string")
    plan = stored(cells(slides.sparkSession, repetitions, n, held_types, held_severities), "cells")
    most = plan.agg(F.max("base")).first()[0] + 1
    order = Window.orderBy("slide_id")
    used = stored(slides.select("slide_id").orderBy("slide_id").limit(max(most, plan.count())).withColumn("base", F.row_number().over(order) - 1), "bases")
    own = stored(elements.join(sized(used.select("slide_id")), "slide_id", "left_semi"), "base-elements")
    labels = slide_labels(own, [(k, s) for k, values in GRID.items() for s in values])
    labels = stored(labels.select("slide_id", "type", "level", F.col("severity").alias("realized")), "labels")
    based = plan.join(used, "base")
    got = based.join(labels.withColumnRenamed("level", "severity"), ["slide_id", "type", "severity"])
    name = F.concat(F.col("slide_id").cast("string"), F.lit("_"), "type", F.lit("_"), F.replace(F.col("severity").cast("string"), F.lit("."), F.lit("p")), F.lit("_"), F.lpad(F.col("repetition").cast("string"), 4, "0"))
    positives = stored(got.select(name.alias("sample_id"), "slide_id", "type", "severity", F.round("realized", 6).alias("realized"), "split"), "positives")
    clean = max(1, int(positives.count() * negative_ratio)) if negative_ratio > 0 else 0
    rounds = slides.sparkSession.range(clean).withColumn("base", (F.col("id") % min(n, max(most, plan.count()))).cast("int")) if clean else None
    if rounds is None:
        return positives
    zero = F.lit(0.0)
    negatives = rounds.join(used, "base").select(F.concat(F.col("slide_id").cast("string"), F.lit("_NO_DEFECT_"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("sample_id"), "slide_id", F.lit("NO_DEFECT").alias("type"), zero.alias("severity"), zero.alias("realized"), F.lit("train").alias("split"))
    return positives.unionByName(negatives)
