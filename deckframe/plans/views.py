"""Layouts, judge records and trajectories as deterministic views of the driver's tables.

The text of a view is SQL that Spark and DuckDB read alike; a name in braces is a
base table or another view. Only integer arithmetic is used, then casts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from deckframe.plans.tables import stored

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "elements": """
        SELECT slide_id, deck_id, pos, CASE WHEN size % 7 = 0 THEN 'title' WHEN size % 7 = 1 THEN 'image' WHEN size % 7 = 2 THEN 'shape'
            WHEN size % 41 = 3 THEN 'background' ELSE 'text' END AS etype,
          CASE WHEN size % 7 = 1 THEN '' ELSE name END AS text,
          x, y, w, h, font, pos AS z,
          CASE WHEN k % 5 = 0 THEN x + CAST((k % 4) * 3 AS DOUBLE) END AS expected_x,
          CASE WHEN k % 5 = 0 THEN y - CAST((k % 3) * 2 AS DOUBLE) END AS expected_y,
          CASE WHEN k % 6 = 0 THEN font + CAST(k % 4 AS DOUBLE) * 0.5 END AS expected_font,
          CASE WHEN k % 3 > 0 THEN line % 2 END AS align_group,
          CASE WHEN k % 4 > 0 THEN line % 2 END AS font_group,
          CASE WHEN k % 4 < 3 THEN 1 END AS color_group,
          r, g, b, CASE WHEN k % 7 = 0 THEN (r + k) % 256 END AS er, CASE WHEN k % 7 = 0 THEN g END AS eg, CASE WHEN k % 7 = 0 THEN b END AS eb,
          CASE WHEN k % 9 = 0 THEN k % 12 END AS capacity,
          CASE WHEN k % 8 = 0 THEN w + CAST(k % 30 - 15 AS DOUBLE) END AS measured_w,
          CASE WHEN k % 8 = 0 THEN h - 2 END AS measured_h,
          k % 13 = 0 AS hidden, CAST(k % 10 AS DOUBLE) / 10 AS opacity, k % 2 = 0 AS fill,
          CASE WHEN k % 11 = 0 THEN r + k % 3 WHEN k % 11 = 1 THEN 255 - r END AS br, CASE WHEN k % 11 < 2 THEN g END AS bg, CASE WHEN k % 11 < 2 THEN b END AS bb
        FROM (SELECT l.l_orderkey AS slide_id, o.o_custkey AS deck_id,
            CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS BIGINT) AS pos,
            CAST(l.l_linenumber AS BIGINT) AS line, l.l_partkey * 7 + l.l_suppkey AS k, p.p_size AS size, p.p_name AS name,
            CAST(24 + (l.l_partkey * 37 + l.l_suppkey * 101) % 1700 + CASE WHEN l.l_partkey % 97 = 0 THEN 1896 - (l.l_partkey * 37 + l.l_suppkey * 101) % 1700 + l.l_suppkey % 2 ELSE 0 END AS DOUBLE) AS x,
            CAST(16 + (l.l_partkey * 53 + l.l_linenumber * 131) % 980 AS DOUBLE) AS y,
            CAST(80 + (l.l_partkey % 9) * 40 AS DOUBLE) AS w, CAST(24 + (p.p_size % 6) * 20 AS DOUBLE) AS h,
            CAST(4 + (p.p_size % 11) * 2 AS DOUBLE) AS font,
            (p.p_partkey * 31) % 256 AS r, (p.p_partkey * 17) % 256 AS g, (p.p_partkey * 7) % 256 AS b
          FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey) q""",
    "bullets": """
        SELECT slide_id, deck_id, pos, etype, text, CASE WHEN etype = 'text' THEN CAST(96 + 500 * (slide_id % 2) AS DOUBLE) + CAST(pos % 3 AS DOUBLE) / 8 ELSE x END AS x, y, w, h, font,
          expected_x, expected_y, expected_font, r, g, b FROM {elements}""",
    "slides": """
        SELECT o_orderkey AS slide_id, o_custkey AS deck_id,
          CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS slide_index,
          o_orderpriority AS section, o_orderkey % 11 = 0 AS texture,
          CASE o_orderkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 31 END AS sr, CASE o_orderkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 17 END AS sg, CASE o_orderkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 7 END AS sb FROM {orders}""",
    "decks": "SELECT c_custkey AS deck_id, CAST(1 + c_custkey % 20 AS BIGINT) AS target_slides FROM {customer}",
    "probe": """
        SELECT l.l_orderkey * 1001 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS ord,
          l.l_orderkey AS sample_id, CAST(s.s_nationkey % 3 AS BIGINT) AS model,
          CASE l.l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'Bprime' END AS raw_modality,
          CASE WHEN l.l_partkey % 5 = 0 THEN 'T3' ELSE 'T1' END AS task,
          CASE WHEN l.l_orderkey % 4 = 0 THEN NULL ELSE CASE WHEN l.l_orderkey % 7 < 2 THEN 'S' ELSE 'G' END || CAST(l.l_orderkey % 6 + 1 AS VARCHAR(2)) END AS expected,
          CASE l.l_returnflag WHEN 'R' THEN CASE WHEN l.l_orderkey % 7 < 2 THEN 'S' ELSE 'G' END || CAST(l.l_orderkey % 6 + 1 AS VARCHAR(2)) WHEN 'A' THEN 'G' || CAST(l.l_partkey % 6 + 1 AS VARCHAR(2)) END AS predicted,
          CAST(4 * (1 + l.l_orderkey % 4) AS DOUBLE) AS severity, CASE WHEN l.l_partkey % 3 > 0 THEN CAST(8 * (1 + l.l_orderkey % 2) AS DOUBLE) END AS grid,
          CASE WHEN l.l_suppkey % 2 = 0 THEN 'template' ELSE 'freeform' END AS template,
          CAST(512 * (1 + l.l_suppkey % 3) AS BIGINT) AS resolution, CASE WHEN l.l_partkey % 5 = 0 THEN l.l_linestatus = 'F' END AS repaired
        FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "records": """
        SELECT ord, '{"task": "' || task || '", "sample_id": "s' || CAST(sample_id AS STRING) || '"' || CASE WHEN ord % 5 = 4 THEN '' ELSE ', "modality": "' || raw_modality || '"' END
          || CASE ord % 3 WHEN 0 THEN ', "model": "m' || CAST(model AS STRING) || '"' WHEN 1 THEN ', "adapter": "m' || CAST(model AS STRING) || '"' ELSE '' END
          || CASE ord % 4 WHEN 0 THEN ', "labels": ' || lab WHEN 2 THEN ', "label_types": [' || CASE WHEN expected IS NULL THEN '' ELSE '"' || expected || '"' END || ']' WHEN 3 THEN ', "labels": []' ELSE '' END
          || CASE ord % 6 WHEN 0 THEN ', "output": {"defects": [' || d || ']}' WHEN 1 THEN ', "output": null, "parsed": {"defects": [' || d || '], "overall_score": 0.25}' WHEN 2 THEN ''
            WHEN 3 THEN ', "output": {"findings": [' || f || '], "better": "a"}' WHEN 4 THEN ', "output": {"defects": [{"type": "G1", "present": false}, {"severity": 2.5}' || CASE WHEN predicted IS NULL THEN '' ELSE ', ' || d END || ']}' ELSE ', "output": {}' END
          || CASE WHEN ord % 7 = 0 THEN ', "severity": ' || CAST(severity + 1 AS STRING) ELSE '' END || CASE ord % 3 WHEN 0 THEN meta WHEN 1 THEN ', "metadata": {"x": 1' || meta || '}' ELSE '' END
          || CASE WHEN repaired IS NULL THEN '' WHEN repaired THEN ', "repair_passed": true' ELSE ', "repair_passed": false' END
          || ', "payload": {"modality": "' || raw_modality || '", "model": "m' || CAST(model AS STRING) || '"' || CASE WHEN ord % 2 = 1 THEN ', "expected_labels": ' || lab ELSE '' END || CASE WHEN ord % 3 = 2 THEN ', "metadata": {"x": 1' || meta || '}' ELSE '' END || '}}' AS record
        FROM (SELECT *, CASE WHEN expected IS NULL THEN '[{"type": "NO_DEFECT"}]' ELSE '[{"type": "' || expected || '", "severity": ' || CAST(severity AS STRING) || ', "target_element_ids": ["e1"]}]' END AS lab,
            ', "resolution": ' || CAST(resolution AS STRING) || ', "template_condition": "' || template || '"' || CASE WHEN grid IS NULL THEN '' ELSE ', "severity_grid_value": ' || CAST(grid AS STRING) END AS meta,
            CASE WHEN predicted IS NULL THEN '' ELSE '{"type": "' || predicted || '", "severity": "minor", "element_ids": ["e2"]}' END AS d,
            CASE WHEN predicted IS NULL THEN '' ELSE '{"type": "' || predicted || '", "severity": "severe", "locator": {"element_id": "e3", "related_page_ids": ["p1", "p2"]}, "evidence": "x"}' END AS f FROM {probe}) q""",
    "label_rows": """
        SELECT sample_id, CASE WHEN n = 0 THEN 'NO_DEFECT' WHEN n <= 6 THEN 'G' || CAST(n AS STRING) ELSE 'S' || CAST(n - 6 AS STRING) END AS type, CASE WHEN n = 10 THEN 40 + severity * 3 ELSE severity END AS severity,
          'e' || CAST(pos AS STRING) AS target, pos % 6 = 5 AS bare, CASE n WHEN 1 THEN '{"overflow_px": "' || CAST(severity / 3 AS STRING) || '"}' WHEN 2 THEN '{"iou": "0.12345"}' WHEN 3 THEN CASE WHEN pos % 2 = 0 THEN '{"offset_px": "16.0", "axis": "x"}' ELSE '{"offset_px": "1234.5"}' END
            WHEN 4 THEN '{"delta_pt": "4.0", "severity_level": "' || CASE WHEN pos % 2 = 0 THEN 'severe' ELSE '' END || '"}' WHEN 5 THEN '{"delta_e": "24.04", "actual_color": "#cb2429"}' WHEN 6 THEN '{"bleed_px": "much", "side": "left"}' WHEN 8 THEN '{"swapped_indices": "[0, 1]"}'
            WHEN 9 THEN '{"canonical": "the Platform", "variant": "O''Hare", "slide_id": "s' || CAST(pos AS STRING) || '"}' WHEN 10 THEN CASE WHEN pos % 2 = 0 THEN '{"max_words": "50", "target_words": "90"}' ELSE '{}' END
            WHEN 11 THEN '{"missing_section": "validation"}' WHEN 12 THEN CASE WHEN pos % 2 = 0 THEN '{"diagram_claim": "two tiers"}' ELSE '{}' END ELSE '{}' END AS meta
        FROM (SELECT l_orderkey AS sample_id, CAST(l_partkey % 13 AS BIGINT) AS n, CAST(4 * (1 + l_suppkey % 12) AS DOUBLE) AS severity,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos FROM {lineitem}) q""",
    "artifacts": """
        SELECT slide_id, pos, '{"deck_id": "d' || CAST(deck_id AS STRING) || '", "metadata": {"topic": "t", "required_sections": "a,b", "canonical_term": "x"}, "slides": [{"slide_id": "s' || CAST(slide_id AS STRING) || '", "metadata": {"missing_section": "y", "section": "'
          || etype || '"}, "elements": [{"element_id": "e' || CAST(pos AS STRING) || '", "type": "' || etype || '", "text": "' || text || '", "metadata": {' || CASE WHEN pos % 2 = 0 THEN '"expected_color": "#ffffff", ' ELSE '' END || '"max_words": "50", "role": "body"}}]}]}' AS deck FROM {elements}""",
    "task_records": """
        SELECT o_orderkey AS ord, '{' || CASE o_orderkey % 3 WHEN 0 THEN '"id": "t ' || CAST(o_orderkey AS STRING) || '", ' WHEN 1 THEN '"sample_id": "", "id": "u/' || CAST(o_orderkey AS STRING) || '", ' ELSE '' END
          || CASE o_orderkey % 4 WHEN 0 THEN '"task_subset": "", "task": "layout", ' WHEN 1 THEN '"subset": "qa", ' ELSE '' END
          || CASE o_custkey % 5 WHEN 0 THEN '"deck": {"deck_id": "d"}, ' WHEN 1 THEN '"slides": [], "deck_path": "x.json", ' WHEN 2 THEN '"pptx_path": "p/a.pptx", "slide_path": "q", ' WHEN 3 THEN '"deck": null, "source_artifact_path": "z", ' ELSE '' END
          || '"question": "' || o_orderpriority || '"}' AS record FROM {orders}""",
    "exam_samples": """
        SELECT ord, sample_id, CASE WHEN model = 0 THEN 'deck' ELSE 'page' END AS level, resolution <> 1024 AS has_image, expected IS NOT NULL AS has_defect, CASE WHEN resolution <> 1024 THEN 'img/' || CAST(ord AS STRING) || '.png' END AS image FROM {probe}""",
    "answers": """
        SELECT l_orderkey AS sample_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS n, CASE l_partkey % 4 WHEN 0 THEN 'low_contrast' WHEN 1 THEN 'overlapping' WHEN 2 THEN 'brand_colors' ELSE 'other' END AS deficiency,
          l_suppkey % 3 > 0 AS strong, l_returnflag = 'R' AS response FROM {lineitem}""",
    "elicit": """
        SELECT l.l_orderkey * 8 + l.l_linenumber AS sample_id, CAST(l.l_suppkey % 6 AS BIGINT) AS model, CASE l.l_partkey % 3 WHEN 0 THEN 'C0' WHEN 1 THEN 'C3' ELSE 'NAMED' END AS cond,
          'G' || CAST(l.l_orderkey % 7 + 1 AS VARCHAR(2)) AS defect, l.l_linestatus = 'F' AS is_clean, l.l_returnflag = 'R' AS has_defect,
          l.l_returnflag = 'R' AND l.l_partkey % 4 > 0 AS named_target, l.l_quantity > 48 AS failure,
          'band' || CAST(CAST(l.l_quantity AS BIGINT) % 5 AS VARCHAR(2)) AS stratum
        FROM {lineitem} l""",
    "afc": """
        SELECT 'G' || CAST(l_orderkey % 7 + 1 AS VARCHAR(2)) AS defect, CASE WHEN l_partkey % 3 = 0 THEN 'clean' ELSE 'paired' END AS mode,
          CASE l_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'tie' WHEN 2 THEN 'b' ELSE 'a' END AS pick0,
          CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'tie' WHEN 2 THEN 'a' WHEN 3 THEN 'a' ELSE 'b' END AS pick1
        FROM {lineitem}""",
    "trials": """
        SELECT model, defect, pair, turn, pick, CASE WHEN turn = 0 THEN 'a' ELSE 'b' END AS expect FROM (SELECT CAST(l_suppkey % 4 AS BIGINT) AS model, 'G' || CAST(l_orderkey % 7 + 1 AS VARCHAR(2)) AS defect, l_orderkey AS pair,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) % 2 AS BIGINT) AS turn, CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'tie' WHEN 2 THEN 'b' WHEN 3 THEN 'b' ELSE 'a' END AS pick FROM {lineitem}) q""",
    "ratings": """
        SELECT l_orderkey AS sample_id, CAST(l_linenumber AS BIGINT) AS judge, CAST((l_partkey + l_suppkey) % 11 AS DOUBLE) / 10 AS score,
          CASE WHEN l_linenumber % 3 = 0 THEN 'api' ELSE 'human' END AS source,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord
        FROM {lineitem}""",
    "reward_pairs": """
        SELECT 'scorer' || CAST(l_suppkey % 4 AS VARCHAR(2)) AS scorer, CASE WHEN l_suppkey % 4 < 2 THEN 'general' ELSE 'probe' END AS category,
          'G' || CAST(l_orderkey % 7 + 1 AS VARCHAR(2)) AS defect, l_extendedprice AS clean,
          l_extendedprice + CAST((l_partkey * 7 + l_suppkey * 3) % 5 - (2 + l_suppkey % 4) AS DOUBLE) AS defective
        FROM {lineitem}""",
    "rollouts": """
        SELECT 'cond' || CAST(user_id % 5 AS VARCHAR(2)) AS cond, user_id AS run,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n, least(value / 200, CAST(1 AS DOUBLE)) AS score
        FROM {events}""",
    "boxes": """
        SELECT slide_id, deck_id, pos, x, y, x + w AS x1, y + h AS y1, w, h, k % 5 = 0 AS no_autofit
        FROM (SELECT *, slide_id + pos * 3 AS k FROM {elements}) q WHERE etype <> 'background'""",
    "spans": """
        SELECT slide_id, pos, x + 2 AS x, y + 1 AS y, x + w + CAST(((slide_id + pos * 7) % 8) * 6 - 24 AS DOUBLE) AS x1, y + h + CAST(((slide_id + pos * 5) % 9) * 3 - 6 AS DOUBLE) AS y1
        FROM {elements} WHERE etype = 'text'""",
}


def with_views(sql: str) -> str:
    """DuckDB SQL that defines what ``sql`` names in braces before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def _there(spark: SparkSession, df: DataFrame) -> bool:
    """Are the files of a written table still where they were?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Views that joins and detectors read many times; written once for a session and folder.
WRITTEN = frozenset({"elements"})
_written: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in WRITTEN:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _written or not _there(spark, _written[key]):
            _written[key] = stored(_plain(spark, sf_dir, name), name)
        return _written[key]
    return _plain(spark, sf_dir, name)


def _plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    text = re.sub(r"\{(\w+)\}|([{}])", lambda m: f"{{t_{m[1]}}}" if m[1] else m[2] * 2, VIEWS[name])  # other braces are text
    return spark.sql(text, **{f"t_{n}": view(spark, sf_dir, n) for n in names})
