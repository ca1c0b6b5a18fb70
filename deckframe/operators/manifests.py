"""Manifests: clean corpora, clean twins, strata, counterparts, pairs in both orders, payloads, caches and plans."""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.functions.texts import safe_id
from deckframe.operators.simulate import unique_ids
from deckframe.plans import sized

CLEAN = "NO_DEFECT"


# --- clean corpora --------------------------------------------------------------------------------------------------


def clean_manifest(decks: DataFrame, slides: DataFrame, source: str, version: str | None = None, pages: bool = True) -> DataFrame:
    """Accepted decks (ord, deck_id, path) and, if asked, their slides (deck_id, slide_id, slide_index) as clean samples.

    Ids are made safe and unique in the order of ``ord``: sample_id, level, deck, slide_id, page_index, deck_ir_path, source_name, source_version, split, label.
    """
    named = unique_ids(decks.select("ord", "deck_id", "path", safe_id(F.col("deck_id").cast("string")).alias("base"))).withColumnRenamed("unique_id", "deck")
    common = [F.concat(F.lit("ir/"), "deck", F.lit(".json")).alias("deck_ir_path"), F.lit(source).alias("source_name"), F.lit(version).cast("string").alias("source_version"), F.lit("clean_candidate").alias("split"), F.lit(CLEAN).alias("label")]
    nothing = F.lit(None)
    rows = named.select(F.concat("deck", F.lit("_deck_clean")).alias("sample_id"), F.lit("deck").alias("level"), "deck", nothing.cast("long").alias("slide_id"), nothing.cast("long").alias("page_index"), *common)
    if not pages:
        return rows
    each = slides.select("deck_id", "slide_id", (F.col("slide_index") + 1).alias("page_index")).join(named, "deck_id")
    number = F.lpad(F.col("page_index").cast("string"), F.greatest(F.lit(4), F.length(F.col("page_index").cast("string"))), F.lit("0"))
    return rows.unionByName(each.select(F.concat("deck", F.lit("_p"), number, F.lit("_clean")).alias("sample_id"), F.lit("page").alias("level"), "deck", "slide_id", "page_index", *common))


def rejections(reasons: DataFrame, most: int = 50, order: str = "deck_id") -> tuple[DataFrame, DataFrame]:
    """Counts by reason, and the first ``most`` rejected decks."""
    bad = reasons.where("reason is not null")
    return bad.groupBy("reason").agg(F.count("*").alias("n")), bad.select(order, "reason").orderBy(order).limit(most)


def structure(value: Column) -> Column:
    """Of a task's structure as text: struct(value, error): an object out of JSON or, failing that, a Python literal, as JSON; null for none."""

    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if t is None or t == "":
                out.append((None, None))
                continue
            try:
                v = json.loads(t)
            except ValueError:
                try:
                    v = ast.literal_eval(t)
                except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
                    out.append((None, type(e).__name__))
                    continue
            out.append((json.dumps(v, sort_keys=True, ensure_ascii=False, default=str), None) if isinstance(v, dict) else (None, f"Expected dict structure, got {type(v).__name__}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return F.pandas_udf(read, "value string, error string")(value)


def task_rows(rows: DataFrame, subset: str | None = None) -> DataFrame:
    """Of benchmark rows (index, hash, category, json_data, json_content, image_path): id, task_subset, structure, error and picture."""
    name = F.coalesce(F.nullif("hash", F.lit("")), F.lpad(F.col("index").cast("string"), F.greatest(F.lit(6), F.length(F.col("index").cast("string"))), F.lit("0")))
    part = F.lit(subset) if subset else F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))
    df = rows.withColumn("task_subset", part).withColumn("s", structure(F.coalesce("json_data", "json_content")))
    return df.select("index", safe_id(F.concat(F.lit("pptbench_"), "task_subset", F.lit("_"), name)).alias("id"), "task_subset", F.when(F.col("json_data").isNotNull(), "json_data").otherwise("json_content").alias("field"), F.col("s.value").alias("structure"), F.col("s.error").alias("error"), "image_path")


def task_row_counts(tasks: DataFrame) -> DataFrame:
    """By subset: records, structures read, structures that failed, and pictures."""
    return tasks.groupBy("task_subset").agg(F.count("*").alias("records"), F.count("structure").alias("structures"), F.count("error").alias("failures"), F.count("image_path").alias("images"))


# --- variants and strata ----------------------------------------------------------------------------------------------


def clean_variants(samples: DataFrame) -> DataFrame:
    """The clean twin of each sample that has a clean image (clean_image, else meta_clean_image): no labels, an id that ends in __CLEAN."""
    image = F.coalesce(F.nullif("clean_image", F.lit("")), F.nullif("meta_clean_image", F.lit("")))
    df = samples.withColumn("image", image).where(F.col("image").isNotNull())
    return df.withColumn("sample_id", F.concat(F.col("sample_id").cast("string"), F.lit("__CLEAN"))).withColumn("labels", F.array().cast("array<string>"))


def attached_controls(positives: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls whose id without __CLEAN is that of a positive."""
    base = controls.withColumn("_base", F.regexp_replace("sample_id", "__CLEAN$", ""))
    return base.join(positives.select(F.col("sample_id").cast("string").alias("_base")).distinct(), "_base", "left_semi").drop("_base")


def defect_of(labels: Column) -> Column:
    """The first label, NO_DEFECT without one."""
    return F.coalesce(F.get(labels, F.lit(0)), F.lit(CLEAN))


def is_template(condition: Column, image: Column) -> Column:
    """A render of the master: by its own condition, where that is missing by its path."""
    path = F.coalesce(image, F.lit(""))
    return F.when(condition.isNotNull(), condition == "template").otherwise(path.contains("__template") | path.contains("/template/"))


def stratum_of(kind: Column, offset: Column, delta: Column, x: Column) -> Column:
    """The name of a label's magnitude: pixels of an offset, three levels of a distance, a gap or its closing; null for other types."""
    d = F.bround(F.coalesce(delta, F.lit(0.0)), 1)
    level = F.when(d < 5, 3).when(d < 18, 12).otherwise(24)
    gap = F.when(x == 0, "flush(x->0)").when(x.isNotNull(), F.concat(F.lit("gap(x->"), x.cast("int").cast("string"), F.lit(")")))
    return F.when(kind == "G3", F.concat(F.coalesce(offset, F.lit(0.0)).cast("int").cast("string"), F.lit("px"))).when(kind == "G5", F.concat(F.lit("ΔE≈"), level.cast("string"))).when(kind == "G6", gap)


def counts_of(recall: Column, specificity: Column, n_pos: Column, n_neg: Column) -> Column:
    """Counts (tp, n_pos, tn, n_neg) out of rates; rates were rounded, so the counts are the nearest."""
    whole = lambda rate, n: F.bround(F.coalesce(rate, F.lit(0.0)) * F.coalesce(n, F.lit(0))).cast("long")
    return F.struct(whole(recall, n_pos).alias("tp"), F.coalesce(n_pos, F.lit(0)).alias("n_pos"), whole(specificity, n_neg).alias("tn"), F.coalesce(n_neg, F.lit(0)).alias("n_neg"))


def slide_words(elements: DataFrame) -> DataFrame:
    """By slide: its titles on a line, its other texts below each other, and its first title or "(untitled)"."""
    text = F.trim("text")
    title = F.lower("etype").contains("title")
    df = elements.where(F.length(text) > 0).withColumns({"t": text, "is_title": title})
    listed = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "t")))), lambda x: x["t"])
    each = df.groupBy("slide_id").agg(listed(F.col("is_title")).alias("a"), listed(~F.col("is_title")).alias("b"))
    slides = elements.select("slide_id").distinct().join(each, "slide_id", "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return slides.select("slide_id", F.array_join(a, " ").alias("title"), F.array_join(b, "\n").alias("body"), F.coalesce(F.get(a, F.lit(0)), F.lit("(untitled)")).alias("heading"))


def scaled(elements: DataFrame, width: float, frame: float = 960.0) -> DataFrame:
    """True boxes in a frame of another width."""
    s = frame / width
    return elements.select("slide_id", "pos", "etype", *[(F.col(c) * s).alias(c) for c in "xywh"])


def changed_as_labelled(pairs: DataFrame) -> DataFrame:
    """Of labelled elements and their clean twins (kind, offset, x0, y0, w0, h0, text0, colour0 and the same with 1): is the change that the label says there, and what changed.

    An offset must be met within half a pixel, a colour or a margin must differ, others must differ in anything.
    """
    differ = lambda *names: ~F.struct(*[F.col(f"{n}0") for n in names]).eqNullSafe(F.struct(*[F.col(f"{n}1").alias(f"{n}0") for n in names]))
    box, text, style = differ("x", "y", "w", "h"), differ("text"), differ("colour")
    told = F.when(F.col("kind") == "G3", F.abs(F.col("x1") - F.col("x0") - F.coalesce("offset", F.lit(0.0))) < 0.5).when(F.col("kind") == "G5", style).when(F.col("kind") == "G6", box).otherwise(text | box | style)
    parts = F.array_join(F.array_compact(F.array(F.when(text, "text"), F.when(box, "bbox"), F.when(style, "style"))), ",")
    return pairs.withColumns({"present": told, "changed": parts})


def gate(samples: DataFrame) -> DataFrame:
    """Of samples (kind, mode, has_image, severity, hit, clean_hit): is a regenerated set fit: only internal contrasts, all images, no clean twin that fires, no clear defect missed."""
    graded = F.col("kind").isin("G3", "G5")
    clear = (F.col("kind") == "G3") & (F.col("severity") >= 8)
    df = samples.agg(
        F.count("*").alias("records"), F.count_if(graded & (F.col("mode") != "internal")).alias("other_modes"), F.count_if("has_image").alias("images"), F.count_if(clear).alias("clear"), F.count_if(clear & F.col("hit")).alias("clear_hits"), F.count_if(graded & F.col("clean_hit")).alias("false_fires")
    )
    ok = (F.col("other_modes") == 0) & (F.col("images") == F.col("records")) & (F.col("false_fires") == 0)
    return df.withColumns({"fit": ok, "warn": F.col("clear") != F.col("clear_hits")})


# --- pairs and counterparts -------------------------------------------------------------------------------------------


def both_orders(pairs: DataFrame) -> DataFrame:
    """Of pairs (pair, defective, clean): both orders: turn 0 shows the defective side first, and expects a."""
    turn = F.explode(F.array(F.lit(0), F.lit(1)))
    df = pairs.withColumn("turn", turn)
    first = F.col("turn") == 0
    return df.select("pair", "turn", F.when(first, F.col("defective")).otherwise(F.col("clean")).alias("a"), F.when(first, F.col("clean")).otherwise(F.col("defective")).alias("b"), F.when(first, "a").otherwise("b").alias("expect"))


def topic_pairs(samples: DataFrame) -> DataFrame:
    """Of samples (topic, ord, is_clean, image): every defective sample with the first clean one of its topic."""
    clean = samples.where("is_clean").groupBy("topic").agg(F.min_by("image", "ord").alias("clean"))
    bad = samples.where("not is_clean").select("topic", F.col("ord").alias("pair"), F.col("image").alias("defective"))
    return bad.join(clean, "topic")


def counterparts(samples: DataFrame, old: str = "__freeform", new: str = "__template") -> DataFrame:
    """Free renders (sample_id, image, changed) with what their counterpart under the master changed, null without one."""
    free = samples.where(F.col("image").contains(old)).select("sample_id", "image", F.col("changed").alias("free"), F.replace("image", F.lit(old), F.lit(new)).alias("twin"))
    held = samples.select(F.col("image").alias("twin"), F.col("changed").alias("held"))
    return free.join(held, "twin", "left").select("sample_id", "free", "held")


def recoverable(generic: DataFrame, probes: DataFrame, type_: str, low: float = 0.6) -> DataFrame:
    """Scorers of one type (scorer, defect, preference): generic against defect-aware elicitation, and whether the latter recovers what the former misses."""
    g = generic.where(F.col("defect") == type_).select("scorer", F.col("preference").alias("generic"))
    p = probes.where(F.col("defect") == type_).select("scorer", F.col("preference").alias("probe"))
    return g.join(p, "scorer").withColumn("recovered", (F.col("generic") < low) & (F.col("probe") >= low))


def native_and_recovered(rows: DataFrame) -> DataFrame:
    """Of rows (kind, is_clean, native, recovered): cells of both linters on the same samples, and the samples that only one gets right."""
    right = lambda c: F.col(c) != F.col("is_clean")
    cell = lambda c: [F.count_if(~F.col("is_clean") & F.col(c)).alias(f"{c}_tp"), F.count_if(F.col("is_clean") & F.col(c)).alias(f"{c}_fp")]
    return rows.groupBy("kind").agg(F.count_if(~F.col("is_clean")).alias("n_pos"), F.count_if("is_clean").alias("n_neg"), *cell("native"), *cell("recovered"), F.count_if(right("native") & ~right("recovered")).alias("only_native"), F.count_if(~right("native") & right("recovered")).alias("only_recovered"))


# --- payloads, caches, documents, plans ---------------------------------------------------------------------------------

INSTRUCTIONS = {"T1": "Detect defects.", "T2": "Rank the candidates.", "T3": "Propose repairs."}


def probe_payload(samples: DataFrame, instructions: dict[str, str] = INSTRUCTIONS) -> DataFrame:
    """Of samples (sample_id, modality, task, image, structure, caption): what a judge is given: the image in A and C, the structure in B and C, the caption in B_prime, and a prompt that names them."""
    has = lambda *m: F.col("modality").isin(*m)
    df = samples.withColumns({"image": F.when(has("A", "C"), F.col("image")), "structure": F.when(has("B", "C"), F.col("structure")), "caption": F.when(has("B_prime"), F.coalesce("caption", F.lit("")))})
    told = F.coalesce(*[F.when(F.col("task") == t, F.lit(text)) for t, text in instructions.items()])
    seen = lambda c, text: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, text)
    parts = [told, seen("structure", "Use the structured slide oracle for geometry and text."), seen("caption", "Use the natural-language caption as the perception oracle."), seen("image", "Inspect the rendered slide image.")]
    return df.withColumn("prompt", F.concat_ws("\n", *parts))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "image") -> DataFrame:
    """Keys that are asked for and not cached, each once: what a detector still has to do."""
    return wanted.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


def skill_sections(documents: DataFrame, names: Sequence[str], defaults: dict[str, str], text: str = "text") -> DataFrame:
    """Sections of a Markdown document by their ``## name`` heads, each trimmed; a missing or blank one has its default, of heads that repeat the last counts."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n")), r"\n##[ \t]+(?=[A-Za-z0-9_]+[ \t]*\n)")
    heads = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("name"), F.regexp_replace(F.substr(p, F.instr(p, "\n")), r"^\s+|\s+$", "").alias("body")))
    pick = lambda n: F.coalesce(F.nullif(F.try_element_at(F.filter(heads, lambda h: h["name"] == n), F.lit(-1))["body"], F.lit("")), F.lit(defaults.get(n, "")))
    return documents.select(*[c for c in documents.columns if c != text], *[pick(n).alias(n) for n in names])


def condition_plan(spark, conditions: Sequence[str], seeds: Sequence[int], budget: int) -> DataFrame:
    """Every condition and seed with its rollouts: a dry run."""
    rows = [(c, s, budget) for c in conditions for s in seeds]
    return spark.createDataFrame(rows, "condition string, seed int, rollouts int")


def chained_hash(rows: DataFrame, order: str) -> DataFrame:
    """One hash of all rows in order, as of their JSON lines with sorted keys; for tables of plans and tasks, which stand on one executor."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    each = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("v"), F.count("*").alias("records"))
    return each.select("records", F.sha2(F.array_join(F.transform("v", lambda x: F.concat(x["l"], F.lit("\n"))), ""), 256).alias("sha256"))


def report(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """Small tables as a Markdown report, each sorted as text and cut at ``most`` rows."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        df = sized(df).limit(most)
        rows = sorted((["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()), key=lambda r: r)
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows), ""]
    return "\n".join(lines)
