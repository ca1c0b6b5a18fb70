"""Exams: findings and results out of labels, requests as messages, and records for training.

Labels have sample_id, type (G1 to G6, S1 to S6, NO_DEFECT), severity, targets and
``meta``, a map of what the injector noted. Elements are those of ``layout``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.functions.texts import general, quoted
from deckframe.operators.contract import severity_level
from deckframe.plans import running, stored

#: The dimension of each type, and the types of a deck's exam; the others are a page's.
DIMENSIONS = {"G1": "text_fit", "G2": "overlap", "G3": "alignment", "G4": "typography", "G5": "brand_color", "G6": "margins", "S1": "title_body", "S2": "narrative_order", "S3": "terminology", "S4": "density", "S5": "missing_section", "S6": "figure_text"}
DECK_TYPES = ("S2", "S3", "S5")
PAGE_TYPES = tuple(t for t in DIMENSIONS if t not in DECK_TYPES)
MAX_WORDS = 60.0


def level_of(kind: Column, severity: Column, meta: Column) -> Column:
    """minor, moderate or severe; density by its share over the limit, a level that the label has wins."""
    limit = F.coalesce(F.nullif(meta["max_words"].try_cast("double"), F.lit(0.0)), F.lit(MAX_WORDS))
    over = F.greatest(F.lit(0.0), (severity - limit) / limit)
    density = F.when(over <= 0.2, "minor").when(over <= 0.5, "moderate").otherwise("severe")
    given = F.nullif(meta["severity_level"], F.lit(""))
    return F.when(kind == "S4", F.coalesce(given, density)).otherwise(severity_level(kind, severity, given))


def _amount(value: Column, prefix: str = " by ", suffix: str = "") -> Column:
    number = value.try_cast("double")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(prefix), F.coalesce(general(number, 3), value), F.lit(suffix)))


def _maybe(value: Column, before: str, after: str = "") -> Column:
    return F.when(F.coalesce(F.length(value), F.lit(0)) > 0, F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def evidence(kind: Column, targets: Column, meta: Column, deck: Column) -> Column:
    """The sentence that says what is seen of a defect."""
    who = F.when(F.size(targets) > 0, F.array_join(targets, ", ")).otherwise(F.when(deck, "deck").otherwise("slide"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    words, limit, claim = meta["target_words"], meta["max_words"], meta["diagram_claim"]
    section = F.coalesce(F.nullif(meta["missing_section"], F.lit("")), F.get(targets, F.lit(0)), F.lit("required section"))
    said = {
        "S2": text("Page order is inconsistent around pages ", F.coalesce(meta["swapped_indices"], F.lit("None")), "; visible sequence includes ", who, "."),
        "S3": text("Terms ", quoted(meta["canonical"]), " and ", quoted(meta["variant"]), " both appear for the same entity", _maybe(meta["slide_id"], " on page "), "."),
        "S5": text("Required section ", quoted(section), " is absent from the visible deck outline."),
        "S4": F.when(words.isNotNull() & limit.isNotNull(), text("Element ", who, " has ", words, " visible words, above the ", limit, "-word scene density limit.")).otherwise(text("Element ", who, " has visible text above the scene density limit.")),
        "S6": F.when(F.length(claim) > 0, text("Diagram/text elements ", who, " conflict: diagram claim ", quoted(claim), " and body text disagree.")).otherwise(text("Diagram/text elements ", who, " conflict in the visible slide content.")),
        "S1": text("Title/body elements ", who, " describe different visible topics on the same slide."),
        "G1": text("Element ", who, " text overflows its bounding box", _amount(meta["overflow_px"], suffix=" px"), " on the page."),
        "G2": text("Elements ", who, " visibly overlap on the page", _amount(meta["iou"], " with IoU "), "."),
        "G3": text("Element ", who, " is offset from the visible alignment position", _amount(meta["offset_px"], suffix=" px"), _maybe(meta["axis"], " on the ", " axis"), "."),
        "G4": text("Element ", who, " font size differs from peer text", _amount(meta["delta_pt"], suffix=" pt"), "."),
        "G5": text("Element ", who, " uses visible color", _maybe(meta["actual_color"], " "), " outside the brand palette", _amount(meta["delta_e"], " by delta-E "), "."),
        "G6": text("Element ", who, " crosses the", _maybe(meta["side"], " "), " safe margin", _amount(meta["bleed_px"], suffix=" px"), "."),
    }
    out = text("Visible element ", who, " has a page-level layout problem in the rendered slide.")
    for k, v in said.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def fix(kind: Column, targets: Column, meta: Column, deck: Column) -> Column:
    """The sentence that says what to do about a defect."""
    who = F.when(F.size(targets) > 0, F.array_join(targets, ", ")).otherwise(F.when(deck, "deck").otherwise("slide"))
    section = F.coalesce(F.nullif(meta["missing_section"], F.lit("")), F.lit("missing required section"))
    around = {
        "G1": ("Shorten or resize text in ", " so it fits inside its bounding box."),
        "G2": ("Move or resize ", " so the elements no longer overlap."),
        "G3": ("Realign ", " to the slide grid or placeholder position."),
        "G4": ("Normalize font size for ", " against peer text elements."),
        "G5": ("Restore ", " to the approved brand/theme color."),
        "G6": ("Move ", " back inside the safe slide margin."),
    }
    out = F.concat(F.lit("Revise "), who, F.lit(" so the slide content matches the requested narrative and visible evidence."))
    for k, (before, after) in around.items():
        out = F.when(kind == k, F.concat(F.lit(before), who, F.lit(after))).otherwise(out)
    plain = {"S2": F.lit("Reorder the affected pages so the story follows the required background, problem, solution, and validation flow."), "S3": F.lit("Replace terminology variants with one canonical term across all affected pages."), "S5": F.concat(F.lit("Add a page or section covering "), quoted(section), F.lit("."))}
    for k, v in plain.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def findings(labels: DataFrame) -> DataFrame:
    """Each label but NO_DEFECT as a finding: sample_id, type, level (page or deck), severity, element_id, related, evidence, fix."""
    deck = F.col("type").isin(*DECK_TYPES)
    none = F.array().cast("array<string>")
    df = labels.where(F.col("type") != "NO_DEFECT")
    return df.select(
        "sample_id",
        "type",
        F.when(deck, "deck").otherwise("page").alias("level"),
        level_of(F.col("type"), F.col("severity"), F.col("meta")).alias("severity"),
        F.when(~deck, F.get("targets", F.lit(0))).alias("element_id"),
        F.when(deck, F.col("targets")).otherwise(none).alias("related"),
        evidence(F.col("type"), F.col("targets"), F.col("meta"), deck).alias("evidence"),
        fix(F.col("type"), F.col("targets"), F.col("meta"), deck).alias("fix"),
    )


def results(labels: DataFrame, level: str = "page") -> DataFrame:
    """By sample: findings, has_defect and the dimensions of the exam's types that no label names, in the order of types."""
    scope = PAGE_TYPES if level == "page" else DECK_TYPES
    found = findings(labels).withColumn("f", F.struct("type", "severity", "element_id", "related", "evidence", "fix")).groupBy("sample_id").agg(F.array_sort(F.collect_list("f")).alias("findings"), F.collect_set("type").alias("active"))
    df = labels.select("sample_id").distinct().join(found, "sample_id", "left")
    names = F.create_map(*[F.lit(x) for k in scope for x in (k, DIMENSIONS[k])])
    none = F.array().cast("array<string>")
    clean = F.transform(F.array_except(F.array(*[F.lit(t) for t in scope]), F.coalesce("active", none)), lambda t: names[t])
    return df.select("sample_id", F.coalesce(F.size("findings") > 0, F.lit(False)).alias("has_defect"), "findings", clean.alias("clean_dimensions"))


def valid(results_: DataFrame) -> DataFrame:
    """``results_`` with ``valid``: the flag agrees with the findings."""
    return results_.withColumn("valid", F.col("has_defect") == (F.coalesce(F.size("findings"), F.lit(0)) > 0))


# --- requests -------------------------------------------------------------------------------------------------------


def _line(role: Column) -> Column:
    box = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), general(F.col(c))) for n, c in zip(("x", "y", "w", "h"), "xywh", strict=True)])
    hexed = F.format_string("#%02x%02x%02x", *[F.col(c).cast("int") for c in "rgb"])
    font = F.regexp_replace(F.col("font").cast("string"), r"E\d+$", "")
    return F.concat(
        F.lit("[e"), F.col("pos").cast("string"), F.lit("] type="), F.col("etype"), F.lit(" bbox=("), box, F.lit(") font="), font, F.lit("pt color="), hexed, F.lit(" fill=None role="), role, F.lit(" z="), F.col("pos").cast("string"), F.lit(" text="), quoted(F.nullif("text", F.lit(""))), F.lit(" summary=None")
    )


def serialized(elements: DataFrame) -> DataFrame:
    """By slide: its elements as lines in the order of their ids as text, its title, its visible text and what its figures say."""
    name = F.concat(F.lit("e"), F.col("pos").cast("string"))
    df = elements.withColumn("line", F.struct(name.alias("k"), _line(F.when(F.col("etype") == "title", "title").otherwise("None")).alias("line")))
    text = F.when(F.length("text") > 0, F.struct("pos", "text"))
    figure = F.when(F.col("etype").isin("image", "chart", "diagram") & (F.length("text") > 0), F.struct("pos", "text"))
    title = F.min_by("text", F.when(F.col("etype") == "title", F.col("pos")))
    each = df.groupBy("slide_id").agg(F.array_sort(F.collect_list("line")).alias("l"), title.alias("title"), F.count_if(F.col("etype") == "title").alias("titles"), F.array_sort(F.collect_list(text)).alias("t"), F.array_sort(F.collect_list(figure)).alias("g"))
    told = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "\n")
    return each.select("slide_id", told("l", "line").alias("elements"), F.when(F.col("titles") > 0, F.nullif("title", F.lit(""))).alias("title"), told("t", "text").alias("visible_text"), F.transform("g", lambda x: x["text"]).alias("figures"))


def page_messages(slides: DataFrame, elements: DataFrame, modality: str = "C", scope: tuple[str, ...] = PAGE_TYPES, width: int = 1920, height: int = 1080) -> DataFrame:
    """slide_id and the user's instruction of a page's exam; A has no structure, B no image, and B_prime neither but a caption."""
    page = serialized(elements)
    df = slides.join(page, "slide_id", "left").withColumn("elements", F.coalesce("elements", F.lit("")))
    structure = F.concat(F.lit("ELEMENTS:\n"), F.col("elements"), F.lit("\n")) if modality in ("B", "C") else F.lit("")
    caption = F.concat(F.lit("CAPTION (natural-language description of the rendered slide):\n"), F.coalesce("visible_text", F.lit("")), F.lit("\n")) if modality == "B_prime" else F.lit("")
    instruction = F.concat(F.lit("PAGE_ID: "), F.col("slide_id").cast("string"), F.lit(f"\nrender={width}x{height} scale=(1,1) dpi=None renderer=None\n"), structure, caption, F.lit("SCENE: full_proposal\nTEMPLATE_ID: None\nPAGE_INDEX: "), F.col("slide_index").cast("string"), F.lit("\nTASK_BRIEF: None\nCHECK_SCOPE: ["), F.lit(", ".join(f"'{t}'" for t in scope)), F.lit("]\n"))
    return df.select("slide_id", F.lit(modality).alias("modality"), F.lit(modality in ("A", "C")).alias("has_image"), instruction.alias("instruction"))


def deck_messages(slides: DataFrame, elements: DataFrame, modality: str = "C") -> DataFrame:
    """deck_id, its pages in order, and the blocks that say what each shows: title, text, figures and, but for captions, elements."""
    page = slides.join(serialized(elements), "slide_id", "left")
    none = lambda c: F.coalesce(c, F.lit("None"))
    shown = F.concat(F.lit("[]")) if modality == "A" else F.when(F.coalesce(F.size("figures"), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(F.transform("figures", quoted), ", "), F.lit("]"))).otherwise("[]")
    head = F.concat(F.lit("PAGE "), F.col("slide_index").cast("string"), F.lit(" id="), F.col("slide_id").cast("string"))
    body = F.concat(F.lit("\nTITLE: "), none("title"), F.lit("\nVISIBLE_TEXT: "), F.coalesce("visible_text", F.lit("")), F.lit("\nKEY_TERMS: []\nFIGURES: "), shown)
    structure = F.when(F.length("elements") > 0, F.concat(F.lit("\nELEMENTS:\n"), F.col("elements"))).otherwise("") if modality in ("B", "C") else F.lit("")
    block = head if modality == "A" else F.concat(head, body, structure)
    each = page.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide_index", block.alias("block")))).alias("b"))
    return each.select("deck_id", F.size("b").alias("pages"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("blocks"))


def request_problems(requests: DataFrame) -> DataFrame:
    """Of requests (modality, level, has_image, has_structure, scope): what makes each invalid, an empty list if nothing does."""
    image, structure = F.col("modality").isin("A", "C"), F.col("modality").isin("B", "C")
    page = F.array(*[F.lit(t) for t in PAGE_TYPES])
    deck = F.array(*[F.lit(t) for t in DECK_TYPES])
    outside = F.size(F.array_except("scope", F.when(F.col("level") == "deck", deck).otherwise(page))) > 0
    checks = [F.when(image & ~F.col("has_image"), "image"), F.when(structure & ~F.col("has_structure"), "structure"), F.when(outside, "scope"), F.when(~F.col("modality").isin("A", "B", "C", "B_prime"), "modality")]
    return requests.withColumn("problems", F.array_compact(F.array(*checks)))


# --- training records -------------------------------------------------------------------------------------------------


def ceil_share(n: Column, share: float) -> Column:
    return F.when((n > 0) & F.lit(share > 0), F.ceil(n * share)).otherwise(0).cast("long")


def assign_modalities(samples: DataFrame, image_share: float = 0.3, structure: float = 0.35, both: float = 0.35, order: str = "ord") -> DataFrame:
    """Of samples (level, has_image, ord): modality. In each level the first ceil(share * n) samples with an image are A.

    Of all others the first with an image, up to the share of C among B and C, are C, the rest B.
    Places are counted over sorted ranges, so no task holds a level.
    """
    if not 0 <= image_share <= 1 or structure < 0 or both < 0 or structure + both <= 0:
        raise ValueError("shares must be within 0 and 1, and B or C must have one")
    one = stored(samples.withColumn("_image", F.col("has_image").cast("long")), "exam-samples")
    sizes = one.groupBy("level").agg(ceil_share(F.count("*"), image_share).alias("_first"), F.sum("_image").alias("_have"))
    short = sizes.where("_have < _first").head(1)
    if short:
        raise ValueError(f"level {short[0]['level']} has {short[0]['_have']} samples with an image and needs {short[0]['_first']}")
    placed = running(one, ["level"], [order], "_image", "exam-levels").withColumnRenamed("upto", "_place").join(F.broadcast(sizes.select("level", "_first")), "level")
    a = (F.col("_image") == 1) & (F.col("_place") <= F.col("_first"))
    marked = stored(placed.withColumn("modality", F.when(a, "A")).drop("_place", "_first"), "exam-a")
    rest = marked.where("modality is null")
    n, have = rest.agg(F.count("*"), F.coalesce(F.sum("_image"), F.lit(0))).first()
    quota = min(have, round(n * both / (structure + both)))
    queued = running(rest, [], [order], "_image", "exam-rest")
    c = (F.col("_image") == 1) & (F.col("upto") <= quota)
    rest = queued.withColumn("modality", F.when(c, "C").otherwise("B")).select(*marked.columns)
    return marked.where("modality is not null").unionByName(rest).drop("_image")


def training_records(samples: DataFrame, results_: DataFrame, mode: str = "pointwise") -> DataFrame:
    """Of samples (sample_id, modality, level, image, clean_image, instruction): sample_id, exam_level, modality, images, user, answer.

    The answer is the result as JSON; in pairs the clean side comes first, and the answer is A, or tie for a clean sample.
    """
    r = results_.select("sample_id", "has_defect", F.to_json(F.struct("has_defect", "findings", "clean_dimensions")).alias("_answer"))
    df = samples.drop("has_defect").join(r, "sample_id")
    if mode == "pairwise":
        choice = F.when(F.col("has_defect"), "A").otherwise("tie")
        reason = F.when(F.col("has_defect"), "A is the clean/reference candidate; B contains the injected defect.").otherwise("Both candidates are clean.")
        answer = F.to_json(F.struct("level", F.col("sample_id").cast("string").alias("subject_id"), choice.alias("better"), reason.alias("reason")))
        images = F.filter(F.array("clean_image", "image"), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)
        return df.select("sample_id", F.lit("PairwiseResult").alias("exam_level"), F.lit("A").alias("modality"), images.alias("images"), "instruction", answer.alias("answer"))
    images = F.when(F.col("modality").isin("A", "C"), F.filter(F.array("image"), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("level") == "deck", "DeckExamResult").otherwise("PageExamResult")
    return df.select("sample_id", kind.alias("exam_level"), "modality", images.alias("images"), "instruction", F.col("_answer").alias("answer"))


def shared_chat(records: DataFrame) -> DataFrame:
    """Records with an image as one user and one assistant turn; the user's text begins with a mark for the image unless it has one."""
    df = records.where(F.size("images") > 0)
    user = F.when(F.col("instruction").contains("<image>"), F.col("instruction")).otherwise(F.concat(F.lit("<image>\n"), "instruction"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return df.select("sample_id", F.array(turn("user", user), turn("assistant", F.col("answer"))).alias("messages"), "images")


_ANSWER = "struct<better:string,has_defect:boolean,findings:array<struct<type:string,severity:string>>,clean_dimensions:array<string>>"


def parsed_answers(records: DataFrame) -> DataFrame:
    """``records`` with ``parsed`` (pairwise, result or null) and ``types``, read back from the answer."""
    a = F.from_json("answer", _ANSWER)
    kind = F.when(a["better"].isNotNull(), "pairwise").when(a["has_defect"].isNotNull(), "result")
    return records.withColumn("parsed", kind).withColumn("types", F.coalesce(F.transform(a["findings"], lambda f: f["type"]), F.array().cast("array<string>")))


def dataset_entry(name: str, file_name: str) -> dict:
    """What a trainer's registry of datasets says of a chat file."""
    return {name: {"file_name": file_name, "formatting": "sharegpt", "columns": {"messages": "messages", "images": "images"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"}}}


def composition(records: DataFrame) -> DataFrame:
    """Counts by exam level, by modality and of all, and how many answers read back."""
    df = parsed_answers(records)
    sets = df.groupingSets([[F.col("exam_level")], [F.col("modality")], []], "exam_level", "modality")
    return sets.agg(F.count("*").alias("n"), F.count("parsed").alias("parsed"), F.sum(F.size("images")).alias("images"))


def kept_negatives(records: DataFrame, max_negatives: int, order: str = "sample_id") -> DataFrame:
    """Records with a defect, and the first ``max_negatives`` without one."""
    few = records.where("not has_defect").orderBy(order).limit(max_negatives)
    return records.where("has_defect").unionByName(few)


def geometry_share(records: DataFrame, share: float, order: str = "sample_id") -> DataFrame:
    """All semantic records, and of the others the first so many that they make up ``share`` of the whole."""
    semantic = records.where("semantic")
    cap = int(semantic.count() * share / (1 - share))
    return semantic.unionByName(records.where("not semantic").orderBy(order).limit(cap))

