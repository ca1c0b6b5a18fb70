"""Queries of manifests, of their twins and strata, and of what is sent to judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.operators import corpus, inject, manifests
from deckframe.queries import _REASONS, SQL
from deckframe.registry import query


def _accepted(decks: DataFrame, slides: DataFrame, elements: DataFrame) -> DataFrame:
    reasons = corpus.reject_reasons(decks, slides, elements, min_slides=3, max_findings=40)
    ok = reasons.where("reason is null").select(F.col("deck_id").alias("ord"), "deck_id", F.concat(F.lit("raw/"), F.col("deck_id").cast("string")).alias("path"))
    return manifests.clean_manifest(ok, slides, "zoo", "v1")


_OK = _REASONS.replace("slides < 2", "slides < 3").replace("findings > 3", "findings > 40")
query("clean_manifest", "decks slides elements", _accepted, f"""WITH a AS (SELECT CAST(deck_id AS VARCHAR) AS deck, deck_id FROM ({_OK}) r WHERE reason IS NULL)
    SELECT deck || '_deck_clean' AS sample_id, 'deck' AS level, deck, CAST(NULL AS BIGINT) AS slide_id, CAST(NULL AS BIGINT) AS page_index, 'ir/' || deck || '.json' AS deck_ir_path, 'zoo' AS source_name, 'v1' AS source_version, 'clean_candidate' AS split, 'NO_DEFECT' AS label FROM a
    UNION ALL SELECT deck || '_p' || lpad(CAST(slide_index + 1 AS VARCHAR), 4, '0') || '_clean', 'page', deck, slide_id, slide_index + 1, 'ir/' || deck || '.json', 'zoo', 'v1', 'clean_candidate', 'NO_DEFECT' FROM a JOIN {{slides}} s ON a.deck_id = s.deck_id""")
query("first_rejections", "decks slides elements", lambda d, s, e: manifests.rejections(corpus.reject_reasons(d, s, e, max_findings=3))[1], f"SELECT deck_id, reason FROM ({_REASONS}) r WHERE reason IS NOT NULL ORDER BY deck_id LIMIT 50")
_BENCH = """event_id AS index, CASE WHEN event_id % 5 > 0 THEN 'h/' || CAST(event_id AS STRING) ELSE '' END AS hash, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS category, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{''a'': (1, None)}' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{broken' WHEN 4 THEN '' END AS json_data,
    CASE WHEN event_id % 2 = 1 THEN '{"from": "content"}' END AS json_content, CASE WHEN event_id % 3 = 0 THEN 'i.png' END AS image_path"""
_TASKS = f"""SELECT index, 'pptbench_' || subset || '_' || CASE WHEN hash = '' THEN lpad(CAST(index AS VARCHAR), CAST(greatest(6, length(CAST(index AS VARCHAR))) AS INT), '0') ELSE replace(hash, '/', '_') END AS id, subset AS task_subset, CASE WHEN json_data IS NULL THEN 'json_content' ELSE 'json_data' END AS field,
    CASE index % 6 WHEN 0 THEN json_data WHEN 1 THEN '{{"a": [1, null]}}' WHEN 5 THEN json_content END AS structure, CASE index % 6 WHEN 2 THEN 'Expected dict structure, got list' WHEN 3 THEN 'SyntaxError' END AS error, image_path FROM (SELECT *, coalesce(nullif(category, ''), 'unknown') AS subset FROM (SELECT {_BENCH} FROM events) e) q"""


def _tasks(events: DataFrame) -> DataFrame:
    from deckframe.study_queries import _split

    return manifests.task_rows(events.selectExpr(*_split(_BENCH)))


query("task_rows", "events", _tasks, _TASKS)
query("task_row_counts", "events", lambda e: manifests.task_row_counts(_tasks(e)), f"SELECT task_subset, count(*) AS records, count(structure) AS structures, count(error) AS failures, count(image_path) AS images FROM ({_TASKS}) t GROUP BY task_subset")

# --- twins, strata, counterparts ----------------------------------------------------------------------------------------


def _samples(probe: DataFrame) -> DataFrame:
    labels = F.when(F.col("expected").isNull(), F.array().cast("array<string>")).otherwise(F.array("expected"))
    return probe.select(F.col("ord").alias("sample_id"), labels.alias("labels"), F.when(F.col("ord") % 3 == 0, F.lit("c.png")).when(F.col("ord") % 3 == 1, F.lit("")).alias("clean_image"), F.when(F.col("ord") % 2 == 0, F.lit("m.png")).alias("meta_clean_image"))


_TWINS = "SELECT ord || '__CLEAN' AS sample_id, CASE ord % 3 WHEN 0 THEN 'c.png' ELSE 'm.png' END AS image, 'NO_DEFECT' AS defect FROM {probe} WHERE ord % 3 = 0 OR ord % 2 = 0"
query("clean_variants", "probe", lambda p: manifests.clean_variants(_samples(p)).select("sample_id", "image", manifests.defect_of(F.col("labels")).alias("defect")), _TWINS)
query("attached_controls", "probe", lambda p: manifests.attached_controls(_samples(p).where("size(labels) > 0"), manifests.clean_variants(_samples(p))).select("sample_id"), "SELECT ord || '__CLEAN' AS sample_id FROM {probe} WHERE (ord % 3 = 0 OR ord % 2 = 0) AND expected IS NOT NULL")
_RENDER = "CASE WHEN ord % 4 = 0 THEN template END AS condition, CASE ord % 5 WHEN 0 THEN 'a/template/x.png' WHEN 1 THEN 'x__template.png' WHEN 2 THEN 'x__freeform.png' END AS image"
query("freeform_only", "probe", lambda p: p.selectExpr("ord", "CASE WHEN ord % 4 = 0 THEN template END AS condition", "CASE ord % 5 WHEN 0 THEN 'a/template/x.png' WHEN 1 THEN 'x__template.png' WHEN 2 THEN 'x__freeform.png' END AS image").where(~manifests.is_template(F.col("condition"), F.col("image"))).select("ord"), f"""
    SELECT ord FROM (SELECT ord, {_RENDER} FROM {{probe}}) q WHERE NOT CASE WHEN condition IS NOT NULL THEN condition = 'template' ELSE contains(coalesce(image, ''), '__template') OR contains(coalesce(image, ''), '/template/') END""")
query("strata", "probe", lambda p: p.select("ord", manifests.stratum_of(F.col("expected"), F.col("severity") + 0.5, F.col("severity") * 1.1, F.when(F.col("ord") % 3 == 0, 0.0).when(F.col("ord") % 3 == 1, F.col("severity") + 0.75)).alias("stratum")), """SELECT ord, CASE expected WHEN 'G3' THEN CAST(floor(severity + 0.5) AS INT) || 'px'
    WHEN 'G5' THEN 'ΔE≈' || CASE WHEN round(severity * CAST(1.1 AS DOUBLE), 1) < 5 THEN 3 WHEN round(severity * CAST(1.1 AS DOUBLE), 1) < 18 THEN 12 ELSE 24 END WHEN 'G6' THEN CASE ord % 3 WHEN 0 THEN 'flush(x->0)' WHEN 1 THEN 'gap(x->' || CAST(floor(severity + 0.75) AS INT) || ')' END END AS stratum FROM {probe}""")
query("slide_words", "elements", manifests.slide_words, """SELECT slide_id, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE etype = 'title' AND text <> ''), '') AS title, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE etype <> 'title' AND text <> ''), '') AS body,
    coalesce(arg_min(text, pos) FILTER (WHERE etype = 'title' AND text <> ''), '(untitled)') AS heading FROM {elements} GROUP BY slide_id""")


def _twin_elements(bullets: DataFrame) -> DataFrame:
    """The element that a shift or a colour changes, with its clean twin."""
    offset, colour = inject.alignment_offset(bullets), inject.brand_colour(bullets)
    hexed = F.format_string("#%02x%02x%02x", *[F.col(c).cast("int") for c in "rgb"])
    clean = bullets.select("slide_id", "pos", *[F.col(c).alias(f"{c}0") for c in "xywh"], F.col("text").alias("text0"), hexed.alias("colour0"))
    same = [F.col(f"{c}0").alias(f"{c}1") for c in "ywh"] + [F.col("text0").alias("text1")]
    moved = clean.join(offset.select("slide_id", "pos", F.col("x").alias("x1")), ["slide_id", "pos"]).select("slide_id", F.lit("G3").alias("kind"), F.lit(16.0).alias("offset"), *[f"{c}0" for c in "xywh"], "text0", "colour0", "x1", *same, F.col("colour0").alias("colour1"))
    tinted = clean.join(colour.select("slide_id", "pos", hexed.alias("colour1")), ["slide_id", "pos"]).select("slide_id", F.lit("G5").alias("kind"), F.lit(None).cast("double").alias("offset"), *[f"{c}0" for c in "xywh"], "text0", "colour0", F.col("x0").alias("x1"), *same, "colour1")
    return moved.unionByName(tinted)


query("changed_as_labelled", "bullets", lambda b: manifests.changed_as_labelled(_twin_elements(b)).groupBy("kind", "present", "changed").agg(F.count("*").alias("n")), f"""
    SELECT 'G3' AS kind, TRUE AS present, 'bbox' AS changed, count(*) AS n FROM ({SQL["inject_offset"]}) o UNION ALL
    SELECT 'G5', c.r <> e.r OR c.g <> e.g OR c.b <> e.b, CASE WHEN c.r <> e.r OR c.g <> e.g OR c.b <> e.b THEN 'style' ELSE '' END, count(*) FROM ({SQL["inject_colour"]}) c JOIN {{bullets}} e ON c.slide_id = e.slide_id AND c.pos = e.pos GROUP BY 1, 2, 3""")


def _regenerated(bullets: DataFrame) -> DataFrame:
    labels = inject.alignment_offset(bullets).select("slide_id", "mode", "severity")
    return labels.select(F.lit("G3").alias("kind"), "mode", (F.col("slide_id") % 50 > 0).alias("has_image"), "severity", (F.col("slide_id") % 3 > 0).alias("hit"), (F.col("slide_id") % 97 == 0).alias("clean_hit"))


query("regenerated_gate", "bullets", lambda b: manifests.gate(_regenerated(b)), f"""SELECT *, other_modes = 0 AND images = records AND false_fires = 0 AS fit, clear <> clear_hits AS warn FROM (SELECT count(*) AS records, count(*) FILTER (WHERE mode <> 'internal') AS other_modes, count(*) FILTER (WHERE slide_id % 50 > 0) AS images, count(*) AS clear,
    count(*) FILTER (WHERE slide_id % 3 > 0) AS clear_hits, count(*) FILTER (WHERE slide_id % 97 = 0) AS false_fires FROM ({SQL["inject_offset"]}) o) q""")
_TOPICS = "l_orderkey * 1001 + l_linenumber * 31 + l_partkey % 31 AS ord, l_partkey % 40 AS topic, l_returnflag = 'N' AS is_clean, 'i' || CAST(l_suppkey AS STRING) AS image"


def _topic_orders(lineitem: DataFrame) -> DataFrame:
    from deckframe.study_queries import _split

    rows = lineitem.selectExpr(*_split(_TOPICS)).groupBy("topic", "ord", "is_clean").agg(F.min("image").alias("image"))
    return manifests.both_orders(manifests.topic_pairs(rows)).groupBy("turn", "expect").agg(F.count("*").alias("n"), F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"))


query("topic_orders", "lineitem", _topic_orders, f"""WITH s AS (SELECT topic, ord, is_clean, min(image) AS image FROM (SELECT {_TOPICS} FROM lineitem) r GROUP BY ALL), c AS (SELECT topic, arg_min(image, ord) AS clean FROM s WHERE is_clean GROUP BY topic),
    p AS (SELECT s.image AS defective, c.clean FROM s JOIN c ON s.topic = c.topic WHERE NOT s.is_clean)
    SELECT 0 AS turn, 'a' AS expect, count(*) AS n, count(DISTINCT defective) AS a, count(DISTINCT clean) AS b FROM p UNION ALL SELECT 1, 'b', count(*), count(DISTINCT clean), count(DISTINCT defective) FROM p""")
query("counterparts", "orders", lambda o: manifests.counterparts(o.selectExpr("o_orderkey AS sample_id", "'r/' || CAST(o_orderkey - o_orderkey % 2 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '__freeform' ELSE '__template' END || '.png' AS image", "o_totalprice AS changed")), """
    SELECT f.o_orderkey AS sample_id, f.o_totalprice AS free, t.o_totalprice AS held FROM orders f LEFT JOIN orders t ON t.o_orderkey = f.o_orderkey + 1 WHERE f.o_orderkey % 2 = 0""")


def _recoverable(pairs: DataFrame) -> DataFrame:
    from deckframe.operators import audits

    rows = audits.reward_preference(pairs)
    return manifests.recoverable(rows.withColumn("preference", F.col("preference") - 0.2), rows, "G3", 0.4)


query("recoverable", "reward_pairs", _recoverable, f"SELECT scorer, preference - CAST(0.2 AS DOUBLE) AS generic, preference AS probe, preference - CAST(0.2 AS DOUBLE) < CAST(0.4 AS DOUBLE) AND preference >= CAST(0.4 AS DOUBLE) AS recovered FROM ({SQL['reward_preference']}) r WHERE defect = 'G3'")
query("native_and_recovered", "elicit", lambda e: manifests.native_and_recovered(e.select(F.col("defect").alias("kind"), "is_clean", F.col("has_defect").alias("native"), F.col("named_target").alias("recovered"))), """SELECT defect AS kind, count(*) FILTER (WHERE NOT is_clean) AS n_pos, count(*) FILTER (WHERE is_clean) AS n_neg, count(*) FILTER (WHERE NOT is_clean AND has_defect) AS native_tp, count(*) FILTER (WHERE is_clean AND has_defect) AS native_fp,
    count(*) FILTER (WHERE NOT is_clean AND named_target) AS recovered_tp, count(*) FILTER (WHERE is_clean AND named_target) AS recovered_fp, count(*) FILTER (WHERE has_defect <> is_clean AND named_target = is_clean) AS only_native, count(*) FILTER (WHERE has_defect = is_clean AND named_target <> is_clean) AS only_recovered FROM {elicit} GROUP BY defect""")

# --- payloads, caches, documents, plans ---------------------------------------------------------------------------------

query("probe_payloads", "probe", lambda p: manifests.probe_payload(p.select("ord", F.when(F.col("raw_modality") == "Bprime", "B_prime").otherwise(F.col("raw_modality")).alias("modality"), "task", F.when(F.col("ord") % 5 > 0, F.lit("i.png")).alias("image"), F.lit("{}").alias("structure"), F.when(F.col("ord") % 7 > 0, F.lit("a slide")).alias("caption"))).select("ord", "image", "structure", "caption", F.md5("prompt").alias("prompt")), """
    SELECT ord, image, structure, caption, md5(concat_ws(chr(10), CASE task WHEN 'T1' THEN 'Detect defects.' ELSE 'Propose repairs.' END, CASE WHEN structure IS NOT NULL THEN 'Use the structured slide oracle for geometry and text.' END, CASE WHEN caption <> '' THEN 'Use the natural-language caption as the perception oracle.' END, CASE WHEN image IS NOT NULL THEN 'Inspect the rendered slide image.' END)) AS prompt
    FROM (SELECT ord, task, CASE WHEN raw_modality IN ('A', 'C') AND ord % 5 > 0 THEN 'i.png' END AS image, CASE WHEN raw_modality IN ('B', 'C') THEN '{}' END AS structure, CASE WHEN raw_modality = 'Bprime' THEN CASE WHEN ord % 7 > 0 THEN 'a slide' ELSE '' END END AS caption FROM {probe}) q""")
query("cache_misses", "lineitem orders", lambda l, o: manifests.cache_misses(l.select(F.col("l_orderkey").alias("image")), o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("image"))), "SELECT DISTINCT l_orderkey AS image FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)")
_SKILL = "'# Doc' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '## scenario' || chr(10) || ' ' || o_orderpriority || chr(10) || '### deeper' || chr(10) ELSE '' END || '## other stuff' || chr(10) || 'x' || chr(10) || '## checklist ' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'do' || chr(10) || 'it' || chr(10) END || chr(10) || '## unknown' || chr(10) || 'y'"
query("skill_sections", "orders", lambda o: manifests.skill_sections(o.selectExpr("o_orderkey", _SKILL.replace("chr(10)", "'\\n'") + " AS text"), ("scenario", "checklist"), {"scenario": "none", "checklist": "all"}), """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || chr(10) || '### deeper' || chr(10) || '## other stuff' || chr(10) || 'x' ELSE 'none' END AS scenario, CASE WHEN o_orderkey % 3 = 0 THEN 'all' ELSE 'do' || chr(10) || 'it' END AS checklist FROM orders""")
query("condition_plan", "nation", lambda n: manifests.condition_plan(n.sparkSession, ("linter", "zero_shot", "finetuned", "hybrid", "none"), (0, 1, 2), 24), "SELECT condition, seed, 24 AS rollouts FROM (VALUES ('linter'), ('zero_shot'), ('finetuned'), ('hybrid'), ('none')) c(condition), (VALUES (0), (1), (2)) s(seed)")
query("chained_hash", "nation", lambda n: manifests.chained_hash(n.select("n_nationkey", "n_name"), "n_nationkey"), """SELECT count(*) AS records, sha256(string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation""")
