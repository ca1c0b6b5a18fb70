"""Queries of raw records, exams, training records and recovered boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.functions import recover, texts
from deckframe.operators import exams, judging, records, vision
from deckframe.registry import query

_list = lambda c: F.array_join(c, ",")

# --- records --------------------------------------------------------------------------------------------------------

_OUT = "CASE WHEN json_type(r, '$.output') IS NULL OR json_type(r, '$.output') = 'NULL' THEN r->'$.parsed' ELSE r->'$.output' END"
_FACTS = f"""(SELECT ord, r->>'$.sample_id' AS sample_id, coalesce(r->>'$.model', r->>'$.adapter', r->>'$.payload.model') AS model,
      replace(coalesce(r->>'$.modality', r->>'$.payload.modality'), 'Bprime', 'B_prime') AS modality, r->>'$.task' AS task, expected_types, predicted_types, severity, coalesce(CAST(coalesce(r->>'$.severity_grid_value', r->>'$.metadata.severity_grid_value', r->>'$.payload.metadata.severity_grid_value') AS DOUBLE), severity) AS grid,
      coalesce(r->>'$.template_condition', r->>'$.metadata.template_condition', r->>'$.payload.metadata.template_condition') AS template, CAST(coalesce(r->>'$.resolution', r->>'$.metadata.resolution', r->>'$.payload.metadata.resolution') AS INT) AS resolution,
      CAST(r->>'$.repair_passed' AS BOOLEAN) AS repaired, score, CASE WHEN len(expected_types) = 0 THEN len(predicted_types) = 0 ELSE list_has_all(predicted_types, expected_types) END AS correct, expected_types[1] AS expected FROM (
        SELECT *, list_filter(types, lambda t: t <> 'NO_DEFECT') AS expected_types, coalesce(CAST(r->>'$.severity' AS DOUBLE), sev) AS severity,
          CASE WHEN o IS NULL THEN CAST([] AS VARCHAR[]) WHEN json_type(o, '$.findings') IS NOT NULL THEN json_extract_string(o, '$.findings[*].type')
            ELSE coalesce(list_transform(list_filter(json_extract(o, '$.defects[*]'), lambda d: coalesce(d->>'$.present', 'true') <> 'false' AND coalesce(d->>'$.type', 'UNKNOWN') <> 'UNKNOWN'), lambda d: d->>'$.type'), CAST([] AS VARCHAR[])) END AS predicted_types,
          CASE WHEN o IS NULL THEN NULL WHEN json_type(o, '$.findings') IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 1 - CAST(0.2 AS DOUBLE) * 3 * json_array_length(o, '$.findings'))
            ELSE coalesce(CAST(o->>'$.overall_score' AS DOUBLE), CASE WHEN coalesce(json_array_length(o, '$.defects'), 0) > 0 THEN 0 ELSE 1 END) END AS score FROM (
          SELECT ord, r, {_OUT} AS o, CASE WHEN json_type(r, '$.labels') IS NOT NULL THEN json_extract_string(r, '$.labels[*].type') WHEN json_type(r, '$.payload.expected_labels') IS NOT NULL THEN json_extract_string(r, '$.payload.expected_labels[*].type')
              ELSE coalesce(json_extract_string(r, '$.label_types[*]'), CAST([] AS VARCHAR[])) END AS types,
            CASE WHEN json_type(r, '$.labels') IS NOT NULL THEN CAST(r->>'$.labels[0].severity' AS DOUBLE) WHEN json_type(r, '$.payload.expected_labels') IS NOT NULL THEN CAST(r->>'$.payload.expected_labels[0].severity' AS DOUBLE) END AS sev
          FROM (SELECT ord, CAST(record AS JSON) AS r FROM {{records}}) a) b) c)"""
query("classified_records", "records", lambda r: records.classified(r).withColumns({"expected_types": _list("expected_types"), "predicted_types": _list("predicted_types"), "score": F.round("score", 9)}), f"SELECT * REPLACE (array_to_string(expected_types, ',') AS expected_types, array_to_string(predicted_types, ',') AS predicted_types, round(score, 9) AS score) FROM {_FACTS} f")
query("probe_summary", "records", lambda r: records.summary(records.classified(r)), f"""SELECT count(*) AS records, count(*) FILTER (WHERE len(expected_types) = 0) AS clean, count(DISTINCT model) AS models, count(DISTINCT sample_id) AS samples, count(*) FILTER (WHERE correct) AS correct,
    CAST(sum(len(predicted_types)) AS BIGINT) AS predicted, CAST(sum(len(list_filter(list_distinct(predicted_types), lambda t: NOT list_contains(expected_types, t)))) AS BIGINT) AS wrong_types, count(repaired) AS repairs, round(avg(score), 6) AS mean_score FROM {_FACTS} f""")
query("record_metrics", "records", lambda r: judging.aggregate_metrics(records.classified(r)).select("model", "modality", "task", "type", "template", "resolution", "n", "accuracy", "recall", "fp"), f"""
    SELECT c.model, c.modality, c.task, c.type, c.template, c.resolution, n, CAST(k AS DOUBLE) / n AS accuracy, CASE WHEN c.type = 'NO_DEFECT' THEN 0 ELSE CAST(tp AS DOUBLE) / n END AS recall, coalesce(fp, 0) AS fp
    FROM (SELECT model, modality, task, type, template, resolution, count(*) AS n, count(*) FILTER (WHERE correct) AS k, count(*) FILTER (WHERE list_contains(predicted_types, type)) AS tp FROM (
        SELECT *, unnest(CASE WHEN len(expected_types) = 0 THEN ['NO_DEFECT'] ELSE list_distinct(expected_types) END) AS type FROM {_FACTS} f) q GROUP BY ALL) c
      LEFT JOIN (SELECT model, modality, task, type, count(*) AS fp FROM (SELECT *, unnest(list_filter(list_distinct(predicted_types), lambda t: NOT list_contains(expected_types, t))) AS type FROM {_FACTS} f) w GROUP BY ALL) w
      ON c.model = w.model AND c.modality = w.modality AND c.task = w.task AND c.type = w.type""")
query("model_view", "artifacts", lambda a: a.select("slide_id", "pos", F.to_json(records.model_view(F.from_json("deck", records.DECK))).alias("visible")), """SELECT slide_id, pos, replace(replace(replace(replace(replace(replace(replace(deck, ', "required_sections": "a,b", "canonical_term": "x"', ''),
    '"missing_section": "y", ', ''), '"expected_color": "#ffffff", ', ''), '"max_words": "50", ', ''), '": ', '":'), ', "', ',"'), ', {', ',{') AS visible FROM {artifacts}""")
_SAFE = lambda x: f"coalesce(nullif(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_'), ''), 'artifact')"
_FIRST = lambda keys: "coalesce(" + ", ".join(f"nullif(r->>'$.{k}', '')" for k in keys) + ")"
_TASKS = f"""SELECT ord, name AS sample_id, 'bench' AS source_name, coalesce({_FIRST(records.TASK_KEYS)}, 'unknown') AS task_subset, array_to_string(list_sort(list_filter(json_keys(r), lambda k: k NOT IN ({", ".join(f"'{k}'" for k in records.BLOCKED)}))), ',') AS task_keys, artifact,
    CASE WHEN artifact IS NOT NULL THEN {_SAFE("name")} || '_deck.json' END AS deck_ir_path, CASE WHEN artifact IS NULL THEN path END AS source_artifact_path, artifact IS NULL AND path IS NOT NULL AS requires_artifact FROM (
      SELECT ord, r, coalesce({_FIRST(("sample_id", "id"))}, 'bench_' || lpad(CAST(ord AS VARCHAR), CAST(greatest(6, length(CAST(ord AS VARCHAR))) AS INT), '0')) AS name, {_FIRST(records.PATH_KEYS)} AS path,
        CASE WHEN json_type(r, '$.deck') = 'OBJECT' THEN 'deck' WHEN json_type(r, '$.slide') IS NOT NULL THEN 'slide' WHEN json_type(r, '$.slides') IS NOT NULL THEN 'slides' END AS artifact FROM (SELECT ord, CAST(record AS JSON) AS r FROM {{task_records}}) j) q"""
query("benchmark_tasks", "task_records", lambda t: records.benchmark_tasks(t, "Bench").withColumn("task_keys", _list("task_keys")), _TASKS)
query("benchmark_summary", "task_records", lambda t: records.task_summary(records.benchmark_tasks(t, "Bench")), f"SELECT task_subset, count(*) AS records, count(artifact) AS converted_ir, count(*) FILTER (WHERE requires_artifact) AS missing_artifacts FROM ({_TASKS}) t GROUP BY task_subset")
_KINDS = (("low_contrast", "G5"), ("brand_colors", "G5"), ("overlapping", "G2"))
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _KINDS)
_ANNOTATED = f"""SELECT sample_id, coalesce(list_sort(list(DISTINCT type) FILTER (WHERE type IS NOT NULL AND strong AND response)), []) AS labels, coalesce(list_sort(list(DISTINCT type) FILTER (WHERE type IS NOT NULL AND strong AND NOT response)), []) AS confident_absent
    FROM {{answers}} a LEFT JOIN (VALUES {_VALUES}) k(deficiency, type) ON a.deficiency = k.deficiency GROUP BY sample_id"""


def _annotated(answers: DataFrame) -> DataFrame:
    return records.annotated_manifest(answers, answers.sparkSession.createDataFrame(_KINDS, "deficiency string, type string"))


query("annotated_manifest", "answers", lambda a: _annotated(a).withColumns({"labels": _list("labels"), "confident_absent": _list("confident_absent")}), f"SELECT sample_id, array_to_string(labels, ',') AS labels, array_to_string(confident_absent, ',') AS confident_absent FROM ({_ANNOTATED}) q")
query("source_registry", "nation region", lambda n, r: records.registry(n.select(F.col("n_name").alias("name"), F.concat(F.lit("file/"), "n_name").alias("url"), F.col("n_regionkey").cast("string").alias("version")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.lit("over").alias("url"), F.lit(None).cast("string").alias("version")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("new").alias("url"), F.lit("1").alias("version")))), """
    SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'over' ELSE 'file/' || n_name END AS url, CAST(n_regionkey AS VARCHAR) AS version FROM nation UNION ALL SELECT r_name, 'new', '1' FROM region""")

# --- exams ----------------------------------------------------------------------------------------------------------


def _labels(rows: DataFrame) -> DataFrame:
    targets = F.when(F.col("bare"), F.array().cast("array<string>")).when(F.col("type").isin("G2", "S1", "S6"), F.array("target", F.lit("e0"))).otherwise(F.array("target"))
    return rows.select("sample_id", "type", "severity", targets.alias("targets"), F.from_json("meta", "map<string,string>").alias("meta"))


_DECKS = "('S2', 'S3', 'S5')"
_WHO = f"CASE WHEN bare THEN CASE WHEN type IN {_DECKS} THEN 'deck' ELSE 'slide' END WHEN type IN ('G2', 'S1', 'S6') THEN target || ', e0' ELSE target END"
_G = lambda key, before=" by ", after="": f"coalesce('{before}' || coalesce(format('{{:.3g}}', TRY_CAST(m->>'$.{key}' AS DOUBLE)), m->>'$.{key}') || '{after}', '')"
_OPT = lambda key, before, after="": f"CASE WHEN coalesce(m->>'$.{key}', '') <> '' THEN '{before}' || (m->>'$.{key}') || '{after}' ELSE '' END"
_EVIDENCE = f"""CASE type WHEN 'G1' THEN 'Element ' || who || ' text overflows its bounding box' || {_G("overflow_px", after=" px")} || ' on the page.' WHEN 'G2' THEN 'Elements ' || who || ' visibly overlap on the page' || {_G("iou", " with IoU ")} || '.'
      WHEN 'G3' THEN 'Element ' || who || ' is offset from the visible alignment position' || {_G("offset_px", after=" px")} || {_OPT("axis", " on the ", " axis")} || '.' WHEN 'G4' THEN 'Element ' || who || ' font size differs from peer text' || {_G("delta_pt", after=" pt")} || '.'
      WHEN 'G5' THEN 'Element ' || who || ' uses visible color' || {_OPT("actual_color", " ")} || ' outside the brand palette' || {_G("delta_e", " by delta-E ")} || '.' WHEN 'G6' THEN 'Element ' || who || ' crosses the' || {_OPT("side", " ")} || ' safe margin' || {_G("bleed_px", after=" px")} || '.'
      WHEN 'S1' THEN 'Title/body elements ' || who || ' describe different visible topics on the same slide.' WHEN 'S2' THEN 'Page order is inconsistent around pages ' || coalesce(m->>'$.swapped_indices', 'None') || '; visible sequence includes ' || who || '.'
      WHEN 'S3' THEN 'Terms ''the Platform'' and "O''Hare" both appear for the same entity' || {_OPT("slide_id", " on page ")} || '.'
      WHEN 'S4' THEN CASE WHEN m->>'$.target_words' IS NULL THEN 'Element ' || who || ' has visible text above the scene density limit.' ELSE 'Element ' || who || ' has ' || (m->>'$.target_words') || ' visible words, above the ' || (m->>'$.max_words') || '-word scene density limit.' END
      WHEN 'S5' THEN 'Required section ''validation'' is absent from the visible deck outline.' ELSE CASE WHEN m->>'$.diagram_claim' IS NULL THEN 'Diagram/text elements ' || who || ' conflict in the visible slide content.' ELSE 'Diagram/text elements ' || who || ' conflict: diagram claim ''' || (m->>'$.diagram_claim') || ''' and body text disagree.' END END"""
_FIX = """CASE type WHEN 'G1' THEN 'Shorten or resize text in ' || who || ' so it fits inside its bounding box.' WHEN 'G2' THEN 'Move or resize ' || who || ' so the elements no longer overlap.' WHEN 'G3' THEN 'Realign ' || who || ' to the slide grid or placeholder position.'
      WHEN 'G4' THEN 'Normalize font size for ' || who || ' against peer text elements.' WHEN 'G5' THEN 'Restore ' || who || ' to the approved brand/theme color.' WHEN 'G6' THEN 'Move ' || who || ' back inside the safe slide margin.'
      WHEN 'S2' THEN 'Reorder the affected pages so the story follows the required background, problem, solution, and validation flow.' WHEN 'S3' THEN 'Replace terminology variants with one canonical term across all affected pages.'
      WHEN 'S5' THEN 'Add a page or section covering ''validation''.' ELSE 'Revise ' || who || ' so the slide content matches the requested narrative and visible evidence.' END"""
_CUT = lambda a, b: f"CASE WHEN severity <= CAST({a} AS DOUBLE) THEN 'minor' WHEN severity <= CAST({b} AS DOUBLE) THEN 'moderate' ELSE 'severe' END"
_LIMIT = "coalesce(CAST(m->>'$.max_words' AS DOUBLE), 60)"
_SEVERITY = f"""CASE type WHEN 'G1' THEN {_CUT(8, 32)} WHEN 'G2' THEN {_CUT(0.05, 0.2)} WHEN 'G3' THEN {_CUT(4, 16)} WHEN 'G4' THEN coalesce(nullif(m->>'$.severity_level', ''), {_CUT(1, 4)}) WHEN 'G5' THEN {_CUT(3, 12)} WHEN 'G6' THEN {_CUT(8, 16)}
      WHEN 'S4' THEN CASE WHEN greatest(0, (severity - {_LIMIT}) / {_LIMIT}) <= CAST(0.2 AS DOUBLE) THEN 'minor' WHEN greatest(0, (severity - {_LIMIT}) / {_LIMIT}) <= CAST(0.5 AS DOUBLE) THEN 'moderate' ELSE 'severe' END ELSE 'moderate' END"""
_FINDINGS = f"""SELECT sample_id, type, CASE WHEN type IN {_DECKS} THEN 'deck' ELSE 'page' END AS level, {_SEVERITY} AS severity, CASE WHEN type NOT IN {_DECKS} AND NOT bare THEN target END AS element_id,
    CASE WHEN type IN {_DECKS} AND NOT bare THEN target ELSE '' END AS related, {_EVIDENCE} AS evidence, {_FIX} AS fix FROM (SELECT *, CAST(meta AS JSON) AS m, {_WHO} AS who FROM {{label_rows}}) q WHERE type <> 'NO_DEFECT'"""
query("label_findings", "label_rows", lambda r: exams.findings(_labels(r)).withColumn("related", _list("related")), _FINDINGS)
_DIMS = "{" + ", ".join(f"'{k}': '{v}'" for k, v in exams.DIMENSIONS.items()) + "}"


def _results_sql(scope: tuple[str, ...]) -> str:
    names = ", ".join(f"CASE WHEN NOT list_contains(active, '{t}') THEN '{exams.DIMENSIONS[t]}' END" for t in scope)
    return f"""SELECT sample_id, len(active) > 0 AS has_defect, n, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS clean_dimensions FROM (
      SELECT sample_id, coalesce(list(DISTINCT type) FILTER (WHERE type <> 'NO_DEFECT'), []) AS active, CAST(count(*) FILTER (WHERE type <> 'NO_DEFECT') AS INT) AS n FROM {{label_rows}} GROUP BY sample_id) q"""


for _level, _scope in (("page", exams.PAGE_TYPES), ("deck", exams.DECK_TYPES)):
    query(f"{_level}_results", "label_rows", lambda r, level=_level: exams.results(_labels(r), level).select("sample_id", "has_defect", F.coalesce(F.size("findings"), F.lit(0)).alias("n"), _list("clean_dimensions").alias("clean_dimensions")), _results_sql(_scope))
_HEX = "printf('#%02x%02x%02x', r, g, b)"
_NUM = lambda c: f"format('{{:g}}', {c})"
_LINE = f"""'[e' || pos || '] type=' || etype || ' bbox=(x=' || {_NUM("x")} || ' y=' || {_NUM("y")} || ' w=' || {_NUM("w")} || ' h=' || {_NUM("h")} || ') font=' || CAST(font AS VARCHAR) || 'pt color=' || {_HEX} || ' fill=None role=' || CASE etype WHEN 'title' THEN 'title' ELSE 'None' END
    || ' z=' || pos || ' text=' || CASE WHEN text = '' THEN 'None' ELSE '''' || text || '''' END || ' summary=None'"""
_SERIAL = f"""(SELECT slide_id, string_agg({_LINE}, chr(10) ORDER BY 'e' || pos) AS elements, nullif(arg_min(text, pos) FILTER (WHERE etype = 'title'), '') AS title, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE length(text) > 0), '') AS visible_text,
    coalesce(list(text ORDER BY pos) FILTER (WHERE etype IN ('image', 'chart', 'diagram') AND length(text) > 0), []) AS figures FROM {{bullets}} GROUP BY slide_id)"""
query("serialized_elements", "bullets", lambda e: exams.serialized(e).withColumn("figures", _list("figures")), f"SELECT * REPLACE (array_to_string(figures, ',') AS figures) FROM {_SERIAL} s")
_SCOPE = ", ".join(f"''{t}''" for t in exams.PAGE_TYPES)
query("page_messages", "slides bullets", lambda s, e: exams.page_messages(s, e).select("slide_id", "modality", "has_image", F.md5("instruction").alias("instruction")), f"""SELECT p.slide_id, 'C' AS modality, TRUE AS has_image, md5('PAGE_ID: ' || p.slide_id || chr(10) || 'render=1920x1080 scale=(1,1) dpi=None renderer=None' || chr(10) || 'ELEMENTS:' || chr(10) || coalesce(elements, '') || chr(10)
    || 'SCENE: full_proposal' || chr(10) || 'TEMPLATE_ID: None' || chr(10) || 'PAGE_INDEX: ' || slide_index || chr(10) || 'TASK_BRIEF: None' || chr(10) || 'CHECK_SCOPE: [{_SCOPE}]' || chr(10)) AS instruction FROM {{slides}} p LEFT JOIN {_SERIAL} s ON p.slide_id = s.slide_id""")
query("deck_messages", "slides bullets", lambda s, e: exams.deck_messages(s, e).select("deck_id", "pages", F.md5("blocks").alias("blocks")), f"""SELECT deck_id, CAST(count(*) AS INT) AS pages, md5(string_agg('PAGE ' || slide_index || ' id=' || p.slide_id || chr(10) || 'TITLE: ' || coalesce(title, 'None') || chr(10) || 'VISIBLE_TEXT: ' || coalesce(visible_text, '') || chr(10) || 'KEY_TERMS: []' || chr(10)
    || 'FIGURES: [' || coalesce(array_to_string(list_transform(figures, lambda f: '''' || f || ''''), ', '), '') || ']' || CASE WHEN elements IS NULL THEN '' ELSE chr(10) || 'ELEMENTS:' || chr(10) || elements END, chr(10) || chr(10) ORDER BY slide_index)) AS blocks FROM {{slides}} p LEFT JOIN {_SERIAL} s ON p.slide_id = s.slide_id GROUP BY deck_id""")


def _requests(probe: DataFrame) -> DataFrame:
    mode = F.when(F.col("raw_modality") == "Bprime", "B_prime").otherwise(F.col("raw_modality"))
    scope = F.array(F.coalesce("expected", F.lit("G1")), F.when(F.col("ord") % 3 == 0, "S2").otherwise("G2"))
    return probe.select("ord", mode.alias("modality"), F.when(F.col("model") == 0, "deck").otherwise("page").alias("level"), (F.col("resolution") != 512).alias("has_image"), (F.col("resolution") != 1024).alias("has_structure"), scope.alias("scope"))


query("request_problems", "probe", lambda p: exams.request_problems(_requests(p)).select("ord", _list("problems").alias("problems")), f"""SELECT ord, concat_ws(',', CASE WHEN raw_modality IN ('A', 'C') AND resolution = 512 THEN 'image' END, CASE WHEN raw_modality IN ('B', 'C') AND resolution = 1024 THEN 'structure' END,
    CASE WHEN NOT list_has_all(CASE WHEN model = 0 THEN {list(exams.DECK_TYPES)} ELSE {list(exams.PAGE_TYPES)} END, [coalesce(expected, 'G1'), CASE WHEN ord % 3 = 0 THEN 'S2' ELSE 'G2' END]) THEN 'scope' END) AS problems FROM {{probe}}""")
_ASSIGNED = """(WITH a AS (SELECT *, CASE WHEN has_image AND sum(CAST(has_image AS INT)) OVER (PARTITION BY level ORDER BY ord ROWS UNBOUNDED PRECEDING) <= ceil(CAST(0.3 AS DOUBLE) * count(*) OVER (PARTITION BY level)) THEN 'A' END AS m FROM {exam_samples}),
    b AS (SELECT *, sum(CAST(has_image AND m IS NULL AS INT)) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k, least(count(*) FILTER (WHERE m IS NULL AND has_image) OVER (), round_even(count(*) FILTER (WHERE m IS NULL) OVER () * CAST(0.35 AS DOUBLE) / CAST(0.7 AS DOUBLE), 0)) AS quota FROM a)
    SELECT ord, sample_id, level, has_image, has_defect, image, coalesce(m, CASE WHEN has_image AND k <= quota THEN 'C' ELSE 'B' END) AS modality FROM b)"""
query("exam_modalities", "exam_samples", lambda s: exams.assign_modalities(s).select("ord", "level", "modality"), f"SELECT ord, level, modality FROM {_ASSIGNED} q")
query("modality_quota", "exam_samples", lambda s: exams.assign_modalities(s).groupBy("level", "modality").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")), f"SELECT level, modality, count(*) AS n, min(ord) AS first_ord FROM {_ASSIGNED} q GROUP BY ALL")


def _training(samples: DataFrame, labels: DataFrame, mode: str = "pointwise") -> DataFrame:
    rows = exams.assign_modalities(samples).withColumn("clean_image", F.concat(F.lit("clean/"), F.col("sample_id").cast("string"))).withColumn("instruction", F.lit("look"))
    return exams.training_records(rows, exams.results(_labels(labels)), mode)


query("training_composition", "exam_samples label_rows", lambda s, r: exams.composition(_training(s, r)), f"""SELECT exam_level, modality, count(*) AS n, count(*) AS parsed, CAST(sum(CASE WHEN modality IN ('A', 'C') AND image IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS images FROM (
      SELECT CASE level WHEN 'deck' THEN 'DeckExamResult' ELSE 'PageExamResult' END AS exam_level, modality, image FROM {_ASSIGNED} a WHERE sample_id IN (SELECT sample_id FROM {{label_rows}})) q GROUP BY GROUPING SETS ((exam_level), (modality), ())""")
query("pairwise_records", "exam_samples label_rows", lambda s, r: exams.parsed_answers(_training(s, r, "pairwise")).groupBy("exam_level", F.get_json_object("answer", "$.better").alias("better"), "parsed").agg(F.count("*").alias("n"), F.sum(F.size("images")).alias("images")), """
    SELECT 'PairwiseResult' AS exam_level, CASE WHEN d.bad THEN 'A' ELSE 'tie' END AS better, 'pairwise' AS parsed, count(*) AS n, CAST(sum(1 + CASE WHEN image IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS images FROM {exam_samples} s
    JOIN (SELECT sample_id, bool_or(type <> 'NO_DEFECT') AS bad FROM {label_rows} GROUP BY sample_id) d ON s.sample_id = d.sample_id GROUP BY 2""")
query("shared_chat", "exam_samples label_rows", lambda s, r: exams.shared_chat(_training(s, r)).select("sample_id", F.col("messages")[0]["content"].alias("user"), F.from_json(F.col("messages")[1]["content"], exams._ANSWER)["has_defect"].alias("has_defect"), F.size("images").alias("images")), f"""
    SELECT a.sample_id, '<image>' || chr(10) || 'look' AS user, d.bad AS has_defect, 1 AS images FROM {_ASSIGNED} a JOIN (SELECT sample_id, bool_or(type <> 'NO_DEFECT') AS bad FROM {{label_rows}} GROUP BY sample_id) d ON a.sample_id = d.sample_id WHERE modality IN ('A', 'C') AND image IS NOT NULL""")
query("negative_cap", "exam_samples", lambda s: exams.geometry_share(exams.kept_negatives(s, 50, "ord").withColumn("semantic", F.col("level") == "deck"), 0.4, "ord").groupBy("has_defect", "semantic").agg(F.count("*").alias("n"), F.max("ord").alias("last")), """
    WITH k AS (SELECT *, level = 'deck' AS semantic FROM {exam_samples} WHERE has_defect UNION ALL SELECT *, level = 'deck' FROM (SELECT * FROM {exam_samples} WHERE NOT has_defect ORDER BY ord LIMIT 50) n),
    g AS (SELECT *, row_number() OVER (PARTITION BY semantic ORDER BY ord) AS i, count(*) FILTER (WHERE semantic) OVER () AS s FROM k)
    SELECT has_defect, semantic, count(*) AS n, max(ord) AS last FROM g WHERE semantic OR i <= floor(s * CAST(0.4 AS DOUBLE) / (1 - CAST(0.4 AS DOUBLE))) GROUP BY ALL""")

# --- text out of models -----------------------------------------------------------------------------------------------

_RAW = """CASE event_id % 7 WHEN 0 THEN '```json' || chr(10) || '{"score": ' || CAST(event_id % 130 AS STRING) || '}' || chr(10) || '```' WHEN 1 THEN 'Score: -3.5 of 10' WHEN 2 THEN 'I give 87.5 points' WHEN 3 THEN '' WHEN 4 THEN '{"score": "' || CAST(event_id % 90 AS STRING) || '"}' WHEN 5 THEN 'none at all' ELSE 'SCORE=12' END"""
query("judge_scores", "events", lambda e: e.select("event_id", texts.score(F.expr(_RAW)).alias("score")), """SELECT event_id, CASE event_id % 7 WHEN 0 THEN least(CAST(100 AS DOUBLE), CAST(event_id % 130 AS DOUBLE)) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(87.5 AS DOUBLE)
    WHEN 4 THEN CAST(event_id % 90 AS DOUBLE) WHEN 6 THEN CAST(12 AS DOUBLE) END AS score FROM events""")
_PICK = """CASE event_id % 6 WHEN 0 THEN 'So {"better": " A "}' WHEN 1 THEN '{"better": "tie", "reason": "x"}' WHEN 2 THEN '{"better": "neither"}' WHEN 3 THEN 'b' WHEN 4 THEN '{"x": 1}' ELSE '{bad} {"better": "B"}' END"""
query("better_picks", "events", lambda e: e.select("event_id", texts.better(recover.recover_json(F.expr(_PICK))).alias("pick")), "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'tie' WHEN 5 THEN 'b' END AS pick FROM events")
query("safe_ids", "part", lambda p: p.select("p_partkey", texts.safe_id(F.concat(F.lit("_"), "p_name", F.lit(" é/#"))).alias("id"), texts.safe_id(F.lit("..")).alias("none")), "SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') || '_é' AS id, 'artifact' AS none FROM part")
query("run_names", "supplier", lambda s: s.select("s_suppkey", texts.run_name(F.concat(F.lit("runs/p1e1_m-"), F.col("s_suppkey").cast("string"), F.lit("_geo_C0_named"), F.when(F.col("s_suppkey") % 2 == 0, "_rows.jsonl").otherwise(".json")), "p1e1").alias("n")).select("s_suppkey", "n.*"), "SELECT s_suppkey, 'm-' || s_suppkey AS model, 'geo' AS tag, 'C0_named' AS condition FROM supplier")
query("page_order", "part", lambda p: p.select("p_partkey", texts.page_number(F.concat(F.lit("deck-v2/page-"), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".jpg").otherwise(".png"))).alias("page"), F.concat_ws("|", *texts.sort_key(F.when(F.col("p_size") > 9, F.col("p_size")), F.col("p_partkey"))).alias("key")), """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 50 END AS page, coalesce(CASE WHEN p_size > 9 THEN CAST(p_size AS VARCHAR) END, '') || '|' || p_partkey AS key FROM part""")
query("yes_no", "orders", lambda o: o.select("o_orderkey", texts.yes(F.element_at(F.array(*[F.lit(x) for x in ("yes", "n", "", "1", "false", "maybe")]), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("said")), "SELECT o_orderkey, [TRUE, FALSE, NULL, TRUE, FALSE, NULL][o_orderkey % 6 + 1] AS said FROM orders")
query("localized", "elements", lambda e: e.select("slide_id", "pos", texts.named_in(F.concat(F.lit("The "), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("box E"), F.col("pos").cast("string"))).otherwise(F.element_at(F.split("text", " "), 1)), F.lit(" is off")), F.concat(F.lit("e"), F.col("pos").cast("string")), F.col("text")).alias("named")), """
    SELECT slide_id, pos, pos % 2 = 0 OR (len(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 3)) > 0 AND len(list_filter(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 3)[1:6], lambda w: contains('the ' || lower(string_split(text, ' ')[1]) || ' is off', w))) >= greatest(1, len(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 3)[1:6]) // 3)) AS named FROM {elements}""")

# --- boxes of images ----------------------------------------------------------------------------------------------------

_SIZED = "(SELECT slide_id, pos, etype, x, y, x + w AS x1, y + h AS y1, CAST(1500 + slide_id % 3 * 250 AS BIGINT) AS img_w, CAST(1125 + slide_id % 2 AS BIGINT) AS img_h FROM {elements})"


def _detected(elements: DataFrame) -> DataFrame:
    size = elements.withColumns({"img_w": 1500 + F.col("slide_id") % 3 * 250, "img_h": 1125 + F.col("slide_id") % 2})
    return size.select("slide_id", "pos", F.concat(F.col("etype"), F.lit("_figure")).alias("label"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "img_w", "img_h")


query("recovered_boxes", "elements", lambda e: vision.recovered(_detected(e)), f"""SELECT slide_id, pos, 'rec_' || pos AS element_id, 'image' AS etype, round(x * 960 / CAST(img_w AS DOUBLE), 6) AS x, round(y * 960 / CAST(img_w AS DOUBLE), 6) AS y, round(greatest(0, x1 - x) * 960 / CAST(img_w AS DOUBLE), 6) AS w, round(greatest(0, y1 - y) * 960 / CAST(img_w AS DOUBLE), 6) AS h, 960 AS width,
    CAST(round_even(img_h * (960 / CAST(img_w AS DOUBLE)), 0) AS INT) AS height FROM {_SIZED} s""")
query("render_specs", "elements", lambda e: vision.in_pixels(e, 1000), """SELECT slide_id, pos, CAST(1000 AS INT) AS image_width, CAST(round_even(1080 * (CAST(1000 AS DOUBLE) / 1920), 0) AS INT) AS image_height, round(x * (CAST(1000 AS DOUBLE) / 1920), 6) AS x, round(y * (round_even(1080 * (CAST(1000 AS DOUBLE) / 1920), 0) / CAST(1080 AS DOUBLE)), 6) AS y,
    round(w * (CAST(1000 AS DOUBLE) / 1920), 6) AS w, round(h * (round_even(1080 * (CAST(1000 AS DOUBLE) / 1920), 0) / CAST(1080 AS DOUBLE)), 6) AS h FROM {elements}""")
