"""Layout detectors: each takes elements and returns findings.

A finding is (slide_id, detector, pos, severity); ``pos`` is the place of the element
at fault on its slide. Elements have slide_id, pos, etype, text, x, y, w, h, font and
what else a detector names. Thresholds are inclusive, but for the margin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckframe.functions.boxes import iou, text_overflow
from deckframe.functions.colors import distance, lab_of, with_lab
from deckframe.plans import sized, stored

MIN_OVERFLOW, MIN_IOU, MIN_OFFSET, MIN_FONT_DELTA, MIN_COLOR_DELTA, MARGIN = 1.0, 0.05, 4.0, 1.0, 1.5, 32.0
WIDTH, HEIGHT = 1920.0, 1080.0
#: Brand colours, as r, g, b.
PALETTE = ((0, 0, 0), (255, 255, 255), (31, 78, 121), (192, 0, 0))


def _found(df: DataFrame, detector: str, severity: Column) -> DataFrame:
    return df.select("slide_id", F.lit(detector).alias("detector"), "pos", severity.cast("double").alias("severity"))


def overlapping(elements: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """Pairs of elements of a slide, background aside, that overlap: slide_id, pos, other, iou.

    The slide is the join key; the overlap of both sides' intervals is a residual
    predicate that comes before the area is computed. The ratio must not be pushed into
    the join as a predicate: there it is written out so often that the generated method
    grows too large to be compiled. A value that depends on the row, and is never
    taken, keeps it in a projection.
    """
    front = elements.where(~F.col("etype").isin("background", "canvas")).select("slide_id", "pos", "x", "y", "w", "h")
    a, b = front.alias("a"), front.alias("b")
    touch = (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w")) & (F.col("a.y") < F.col("b.y") + F.col("b.h")) & (F.col("b.y") < F.col("a.y") + F.col("a.h"))
    pairs = a.join(b, (F.col("a.slide_id") == F.col("b.slide_id")) & (F.col("a.pos") < F.col("b.pos")) & touch)
    share = F.when(F.monotonically_increasing_id() < 0, 0.0).otherwise(iou("a", "b"))
    return pairs.select("a.slide_id", "a.pos", F.col("b.pos").alias("other"), share.alias("iou")).where(F.col("iou") >= min_iou)


def overlap_findings(elements: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    return _found(overlapping(elements, min_iou), "overlap", F.col("iou"))


def overflow_findings(elements: DataFrame, least: float = MIN_OVERFLOW) -> DataFrame:
    """Text beyond its box, in pixels."""
    c = F.col
    over = text_overflow(c("text"), c("capacity"), c("w"), c("h"), c("font"), c("measured_w"), c("measured_h"))
    texts = elements.where(F.col("etype").isin("title", "text", "bullet", "caption") | (F.length("text") > 0))
    return _found(texts.withColumn("over", over).where(F.col("over") >= least), "overflow", F.col("over"))


def _against_group(rest: DataFrame, group: str, value: str, members: int, least: float) -> DataFrame:
    """Deviations from the median of the group, of those left."""
    w = Window.partitionBy("slide_id", group)
    kept = rest.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    kept = kept.withColumn("n", F.count("*").over(w)).withColumn("off", F.abs(F.col(value) - F.median(value).over(w)))
    return kept.where((F.col("n") >= members) & (F.col("off") >= least))


def alignment_findings(elements: DataFrame, least: float = MIN_OFFSET) -> DataFrame:
    """Elements away from their expected place; of the others, those off the median x of their group of three or more."""
    off = F.greatest(F.abs(F.col("x") - F.col("expected_x")), F.abs(F.col("y") - F.col("expected_y")))
    flagged = F.coalesce(off >= least, F.lit(False))
    direct = elements.where(flagged)
    grouped = _against_group(elements.where(~flagged), "align_group", "x", 3, least)
    return _found(direct, "alignment", off).unionByName(_found(grouped, "alignment", F.col("off")))


def font_findings(elements: DataFrame, least: float = MIN_FONT_DELTA) -> DataFrame:
    """Fonts that differ from the expected size, or from the median of their group of two or more."""
    off = F.abs(F.col("font") - F.col("expected_font"))
    flagged = F.coalesce(off >= least, F.lit(False))
    grouped = _against_group(elements.where(~flagged), "font_group", "font", 2, least)
    return _found(elements.where(flagged), "font", off).unionByName(_found(grouped, "font", F.col("off")))


def _into_margin(margin: float = MARGIN, width: float = WIDTH, height: float = HEIGHT) -> Column:
    return F.greatest(margin - F.col("x"), margin - F.col("y"), F.col("x") + F.col("w") - (width - margin), F.col("y") + F.col("h") - (height - margin))


def margin_findings(elements: DataFrame, margin: float = MARGIN, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """How far an element reaches into the margin."""
    into = _into_margin(margin, width, height)
    return _found(elements.where(into > 0), "margin", into)


def _measured(df: DataFrame, colours: dict[str, tuple[str, str, str]], off: Column, name: str = "off") -> DataFrame:
    """``df`` with ``off``, which is worked out once for each combination of ``colours`` (names of three columns).

    There are few combinations beside the elements; they are broadcast if they are few, else joined by shuffle.
    """
    columns = [c for three in colours.values() for c in three]
    table = df.select(*columns).distinct()
    for colour, three in colours.items():
        table = with_lab(table, colour, *three)
    table = sized(stored(table.select(*columns, off.alias(name)).where(F.col(name).isNotNull()), "colours"))
    e, t = df.alias("e"), table.alias("t")
    same = reduce(lambda x, y: x & y, (F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns))
    return e.join(t, same, "left").select("e.*", f"t.{name}")


def _brand(elements: DataFrame, palette: tuple = PALETTE) -> DataFrame:
    offs = [distance("own", lab_of(p)) for p in palette]
    nearest = F.least(*offs) if len(offs) > 1 else offs[0] if offs else F.lit(None).cast("double")
    off = F.coalesce(distance("own", "want"), nearest)
    return _measured(elements, {"own": ("r", "g", "b"), "want": ("er", "eg", "eb")}, off, "brand_off")


def palette_findings(elements: DataFrame, least: float = MIN_COLOR_DELTA, palette: tuple = PALETTE) -> DataFrame:
    """Colours away from the expected one or, without one, from the nearest brand colour."""
    return _found(_brand(elements, palette).where(F.col("brand_off") >= least), "palette", F.round("brand_off", 6))


def color_group_findings(elements: DataFrame, least: float = MIN_COLOR_DELTA) -> DataFrame:
    """Colours away from the most common one of their group of three or more; of equally common ones that which comes first."""
    own = elements.where(F.col("color_group").isNotNull()).select("slide_id", "pos", "color_group", "r", "g", "b")
    counts = own.groupBy("slide_id", "color_group", "r", "g", "b").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    top = counts.groupBy("slide_id", "color_group").agg(F.sum("c").alias("n"), F.max_by(F.struct(F.col("r").alias("mr"), F.col("g").alias("mg"), F.col("b").alias("mb")), F.struct("c", -F.col("p"))).alias("m"))
    joined = own.join(top.where("n >= 3").select("slide_id", "color_group", "m.*"), ["slide_id", "color_group"])
    unlike = joined.where("not (r <=> mr and g <=> mg and b <=> mb)")
    off = with_lab(with_lab(unlike, "own", "r", "g", "b"), "most", "mr", "mg", "mb").withColumn("off", distance("own", "most"))
    return _found(off.where(F.col("off") >= least), "color_group", F.round("off", 6))


def _row_wise(elements: DataFrame, palette: tuple = PALETTE) -> DataFrame:
    """Overflow, palette and margin findings, which look at one element alone, out of one scan."""
    c = F.col
    over = text_overflow(c("text"), c("capacity"), c("w"), c("h"), c("font"), c("measured_w"), c("measured_h"))
    text = c("etype").isin("title", "text", "bullet", "caption") | (F.length("text") > 0)
    found = lambda name, ok, value: F.when(ok, F.struct(F.lit(name).alias("detector"), value.cast("double").alias("severity")))
    df = _brand(elements, palette).select("slide_id", "pos", F.when(text, over).alias("over"), "brand_off", _into_margin().alias("into"))
    each = [found("overflow", c("over") >= MIN_OVERFLOW, c("over")), found("palette", c("brand_off") >= MIN_COLOR_DELTA, F.round("brand_off", 6)), found("margin", c("into") > 0, c("into"))]
    return df.select("slide_id", "pos", F.explode(F.array_compact(F.array(*each))).alias("f")).select("slide_id", "f.detector", "pos", "f.severity")


DETECTORS = (overflow_findings, overlap_findings, alignment_findings, font_findings, palette_findings, color_group_findings, margin_findings)


def lint(elements: DataFrame, palette: tuple = PALETTE) -> DataFrame:
    """The findings of all detectors, repeated ones included; what needs one element alone comes from one scan."""
    groups = (overlap_findings, alignment_findings, font_findings, color_group_findings)
    return reduce(DataFrame.unionByName, (f(elements) for f in groups), _row_wise(elements, palette))


def lint_types(elements: DataFrame, min_iou: float = MIN_IOU, margin: float = MARGIN) -> DataFrame:
    """slide_id and types, the detectors that found something, at another overlap and margin; slides without findings have none."""
    rest = lint(elements).where(~F.col("detector").isin("overlap", "margin"))
    found = rest.unionByName(overlap_findings(elements, min_iou)).unionByName(margin_findings(elements, margin))
    each = found.groupBy("slide_id").agg(F.array_sort(F.collect_set("detector")).alias("types"))
    slides = elements.select("slide_id").distinct().join(each, "slide_id", "left")
    return slides.select("slide_id", F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def lint_scores(elements: DataFrame, each: float = 0.15, palette: tuple = PALETTE) -> DataFrame:
    """slide_id, n_findings and score, for every slide that has elements."""
    counts = lint(elements, palette).groupBy("slide_id").agg(F.count("*").alias("n"))
    slides = elements.select("slide_id").distinct().join(counts, "slide_id", "left")
    n = F.coalesce("n", F.lit(0))
    return slides.select("slide_id", n.alias("n_findings"), F.greatest(F.lit(0.0), 1 - each * n).alias("score"))


def cheats(elements: DataFrame, slides: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Tricks that hide content: slide_id, kind, pos, other (of a pair of elements) and severity; a whole slide has neither.

    Elements have a background colour br, bg, bb, or null; slides sr, sg, sb, or null.
    """
    text = F.length("text") > 0
    one = lambda df, kind, severity=None: df.select("slide_id", F.lit(kind).alias("kind"), "pos", F.lit(None).cast("long").alias("other"), (F.lit(1.0) if severity is None else severity).alias("severity"))
    outside = (F.col("x") + F.col("w") < 0) | (F.col("x") > width) | (F.col("y") + F.col("h") < 0) | (F.col("y") > height)
    behind = elements.where(text).join(slides.select("slide_id", "sr", "sg", "sb"), "slide_id", "left")
    own = F.col("br").isNotNull()
    behind = behind.withColumns({c: F.when(own, F.col(f"b{c[-1]}")).otherwise(F.col(f"s{c[-1]}")) for c in ("_r", "_g", "_b")})
    pale = _measured(behind, {"own": ("r", "g", "b"), "under": ("_r", "_g", "_b")}, distance("own", "under"), "contrast").where("contrast < 8")
    plain = elements.where((F.length("text") == 0) & (F.col("fill") | own)).select("slide_id", "pos")
    covered = overlapping(elements, 0.85)
    sides = covered.select("slide_id", "pos", "other", "iou", F.explode(F.array("pos", "other")).alias("side"))
    pairs = sides.join(plain.withColumnRenamed("pos", "side"), ["slide_id", "side"], "left_semi").select("slide_id", "pos", "other", "iou").distinct()
    parts = [
        one(elements.where(F.col("hidden") & text), "overflow_hidden"),
        one(elements.where(text & (F.col("font") < 6)), "tiny_text", 6 - F.col("font")),
        one(elements.where(text & (F.col("opacity") < 0.2)), "faint_text", 1 - F.col("opacity")),
        one(pale, "low_contrast", F.round(8 - F.col("contrast"), 6)),
        one(elements.where(outside), "off_canvas"),
        pairs.select("slide_id", F.lit("covering_overlay").alias("kind"), "pos", "other", F.col("iou").alias("severity")),
        one(slides.where("texture").select("slide_id", F.lit(None).cast("long").alias("pos")), "texture_background"),
    ]
    return reduce(DataFrame.unionByName, parts)


def legal_boxes(boxes: DataFrame, margin: float = 20.0, max_iou: float = 0.1, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Boxes within the margins that overlap no other box of their slide by more than ``max_iou``."""
    inside = (F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x1") <= width - margin) & (F.col("y1") <= height - margin)
    a, b = boxes.where(inside).alias("a"), boxes.alias("b")
    clash = (F.col("a.slide_id") == F.col("b.slide_id")) & (F.col("a.pos") != F.col("b.pos")) & (iou("a", "b") > max_iou)
    return a.join(b, clash, "left_anti")


def box_overflow(boxes: DataFrame, spans: DataFrame, tolerance: float = 2.0, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Rendered text past its box: slide_id, pos, bottom, right, v_over, h_over; a row for each box that owns a span.

    A box owns what starts between its top and the next box below in its columns, if
    the span's centre lies in these columns, and likewise to the right in its rows.
    """
    a, b = boxes.alias("a"), boxes.alias("b")
    c = F.col
    columns = (c("b.x1") > c("a.x")) & (c("b.x") < c("a.x1"))
    rows = (c("b.y1") > c("a.y")) & (c("b.y") < c("a.y1"))
    below, beside = columns & (c("b.y") >= c("a.y1") - tolerance), rows & (c("b.x") >= c("a.x1") - tolerance)
    near = a.join(b, (c("a.slide_id") == c("b.slide_id")) & (c("a.pos") != c("b.pos")) & (below | beside))
    limits = near.groupBy("a.slide_id", "a.pos").agg(F.min(F.when(below, c("b.y"))).alias("floor"), F.min(F.when(beside, c("b.x"))).alias("wall"))
    region = boxes.join(limits, ["slide_id", "pos"], "left").alias("r")
    s = spans.alias("s")
    within = lambda v, lo, hi: (v >= c(lo) - tolerance) & (v <= c(hi) + tolerance)
    down = within((c("s.x") + c("s.x1")) / 2, "r.x", "r.x1") & (c("s.y") >= c("r.y") - tolerance) & (c("s.y") < F.coalesce(c("r.floor"), F.lit(height)))
    across = within((c("s.y") + c("s.y1")) / 2, "r.y", "r.y1") & (c("s.x") >= c("r.x") - tolerance) & (c("s.x") < F.coalesce(c("r.wall"), F.lit(width)))
    owned = region.join(s, (c("r.slide_id") == c("s.slide_id")) & (down | across))
    ends = owned.groupBy("r.slide_id", "r.pos", "r.x1", "r.y1").agg(F.max(F.when(down, c("s.y1"))).alias("low"), F.max(F.when(across, c("s.x1"))).alias("far"))
    bottom, right = F.greatest("y1", "low"), F.greatest("x1", "far")
    return ends.select("slide_id", "pos", bottom.alias("bottom"), right.alias("right"), (bottom - c("y1")).alias("v_over"), (right - c("x1")).alias("h_over"))


def overflow_hits(boxes: DataFrame, spans: DataFrame, least: float = 3.0, share: float = 0.04, max_iou: float = 0.1, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Legal boxes whose text overflows by ``least`` and by ``share`` of the box, one way or the other, with page_over, collides and hard.

    A hit is hard if the box has no autofit, the text leaves the page, or it newly overlaps another box.
    """
    c = F.col
    over = legal_boxes(boxes, max_iou=max_iou, width=width, height=height).join(box_overflow(boxes, spans, width=width, height=height), ["slide_id", "pos"])
    part = lambda o, size: F.when(c(size) > 0, c(o) / c(size)).otherwise(0.0)
    hit = lambda o, size: (c(o) >= least) & (part(o, size) >= share)
    hits = over.where(hit("v_over", "h") | hit("h_over", "w")).withColumn("page_over", F.greatest(F.lit(0.0), c("bottom") - height, c("right") - width))
    grown = hits.select("slide_id", "pos", "x", "y", (c("right") - c("x")).alias("w"), (c("bottom") - c("y")).alias("h"), c("w").alias("w0"), c("h").alias("h0"))
    g, b = grown.alias("g"), boxes.alias("b")
    small = g.select(*[c(f"g.{n}") for n in ("slide_id", "pos", "x", "y")], c("g.w0").alias("w"), c("g.h0").alias("h"))
    other = (c("g.slide_id") == c("b.slide_id")) & (c("g.pos") != c("b.pos"))
    after = g.join(b, other & (iou("g", "b") > max_iou)).select("g.slide_id", "g.pos", c("b.pos").alias("other"))
    before = small.alias("g").join(b, other & (iou("g", "b") > max_iou)).select("g.slide_id", "g.pos", c("b.pos").alias("other"))
    new = after.join(before, ["slide_id", "pos", "other"], "left_anti").select("slide_id", "pos", F.lit(True).alias("collides")).distinct()
    out = hits.join(new, ["slide_id", "pos"], "left").withColumn("collides", F.coalesce("collides", F.lit(False)))
    hard = c("no_autofit") | (c("page_over") >= least) | c("collides")
    return out.select("slide_id", "deck_id", "pos", "v_over", "h_over", F.round(part("v_over", "h"), 6).alias("v_share"), F.round(part("h_over", "w"), 6).alias("h_share"), "page_over", "collides", hard.alias("hard"))
