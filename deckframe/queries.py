"""Registry of the engine's own queries and of their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.functions.colors import lab_of
from deckframe.functions.stats import Z95, tail_sql
from deckframe.functions.recover import recover_json
from deckframe.operators import audits, contract, corpus, judging, layout, simulate, vision
from deckframe.operators import text as wording
from deckframe.registry import QUERIES, SQL, query
from deckframe.sources import html_elements
from deckframe.streaming import twins

# --- layout ---------------------------------------------------------------------------------------------------------

_IOU = """greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
    / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"""
_FRONT = "etype NOT IN ('background', 'canvas')"
_PAIRS = f"""SELECT a.slide_id, a.pos, b.pos AS other, {_IOU} AS iou FROM {{elements}} a JOIN {{elements}} b ON a.slide_id = b.slide_id AND a.pos < b.pos
    WHERE a.{_FRONT} AND b.{_FRONT}"""
_OVERFLOW = """CASE WHEN coalesce(measured_w, 0) <> 0 OR coalesce(measured_h, 0) <> 0
      THEN greatest(CASE WHEN measured_w <> 0 THEN greatest(0, measured_w - w) ELSE 0 END, CASE WHEN measured_h <> 0 THEN greatest(0, measured_h - h) ELSE 0 END)
    ELSE greatest(0, length(text) - coalesce(CASE WHEN capacity IS NOT NULL THEN greatest(0, capacity) END, greatest(1, floor(w / greatest(1, font * CAST(0.55 AS DOUBLE)))) * greatest(1, floor(h / greatest(1, font * CAST(1.25 AS DOUBLE))))))
      * font * CAST(0.55 AS DOUBLE) END"""


def _labs(source: str, **colors: str) -> str:
    """SQL of ``source`` with columns name_l, name_a, name_b for each name and its three columns."""
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    lin = lambda c: f"CASE WHEN {c} <= {d(0.04045 * 255)} THEN {c} / {d(255.0)} / {d(12.92)} ELSE pow(({c} / {d(255.0)} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END"
    bend = lambda t: f"CASE WHEN {t} > {d(216.0 / 24389.0)} THEN pow({t}, {d(1.0 / 3.0)}) ELSE ({t} * {d(24389.0 / 27.0)} + 16) / {d(116.0)} END"
    rows = (("0.4124564", "0.3575761", "0.1804375", "0.95047"), ("0.2126729", "0.7151522", "0.0721750", "1.0"), ("0.0193339", "0.1191920", "0.9503041", "1.08883"))
    for n, c in colors.items():
        source = f"SELECT *, {', '.join(f'{lin(x)} AS {n}_{i}' for i, x in enumerate(c.split()))} FROM ({source}) q"
        xyz = [f"({n}_0 * CAST({p} AS DOUBLE) + {n}_1 * CAST({q} AS DOUBLE) + {n}_2 * CAST({r} AS DOUBLE)) / CAST({w} AS DOUBLE)" for p, q, r, w in rows]
        source = f"SELECT *, {', '.join(f'{x} AS {n}_x{i}' for i, x in enumerate(xyz))} FROM ({source}) q"
        source = f"SELECT *, {', '.join(f'{bend(f'{n}_x{i}')} AS {n}_f{i}' for i in range(3))} FROM ({source}) q"
        source = f"SELECT *, 116 * {n}_f1 - 16 AS {n}_l, 500 * ({n}_f0 - {n}_f1) AS {n}_a, 200 * ({n}_f1 - {n}_f2) AS {n}_b FROM ({source}) q"
    return source


def _distance(own: str, other: str | tuple[float, float, float]) -> str:
    theirs = [f"{other}_{c}" for c in "lab"] if isinstance(other, str) else [f"CAST({v!r} AS DOUBLE)" for v in other]
    return "sqrt(" + " + ".join(f"pow({own}_{c} - {t}, 2)" for c, t in zip("lab", theirs, strict=True)) + ")"


_NEAREST = "least(" + ", ".join(_distance("own", lab_of(p)) for p in layout.PALETTE) + ")"


def _group_findings(detector: str, off: str, group: str, value: str, members: int, least: float) -> str:
    return f"""SELECT slide_id, '{detector}' AS detector, pos, CAST({off} AS DOUBLE) AS severity FROM {{elements}} WHERE {off} >= {least}
      UNION ALL SELECT slide_id, '{detector}', pos, off FROM (SELECT slide_id, pos, count(*) OVER w AS n, abs({value} - median({value}) OVER w) AS off
        FROM {{elements}} WHERE coalesce({off} < {least}, TRUE) AND {group} IS NOT NULL WINDOW w AS (PARTITION BY slide_id, {group})) q WHERE n >= {members} AND off >= {least}"""


_OFFSET = "greatest(abs(x - expected_x), abs(y - expected_y))"
_MARGIN = "greatest(32 - x, 32 - y, x + w - 1888, y + h - 1048)"
#: The most common colour of a group, of equal ones that which comes first: fewest others before it in (count down, place up).
_MAJORITY = """SELECT e.slide_id, e.pos, e.r, e.g, e.b, m.r AS mr, m.g AS mg, m.b AS mb FROM {elements} e JOIN (
      SELECT *, sum(c) OVER (PARTITION BY slide_id, color_group) AS n, row_number() OVER (PARTITION BY slide_id, color_group ORDER BY c DESC, p) AS place FROM (
        SELECT slide_id, color_group, r, g, b, count(*) AS c, min(pos) AS p FROM {elements} WHERE color_group IS NOT NULL GROUP BY ALL) x) m
    ON e.slide_id = m.slide_id AND e.color_group = m.color_group WHERE m.place = 1 AND m.n >= 3"""
FINDINGS = {
    "overflow": f"SELECT slide_id, 'overflow' AS detector, pos, CAST({_OVERFLOW} AS DOUBLE) AS severity FROM {{elements}} WHERE (etype IN ('title', 'text', 'bullet', 'caption') OR length(text) > 0) AND {_OVERFLOW} >= 1",
    "overlap": f"SELECT slide_id, 'overlap' AS detector, pos, iou AS severity FROM ({_PAIRS}) q WHERE iou >= CAST(0.05 AS DOUBLE)",
    "alignment": _group_findings("alignment", _OFFSET, "align_group", "x", 3, 4),
    "font": _group_findings("font", "abs(font - expected_font)", "font_group", "font", 2, 1),
    "palette": f"""SELECT slide_id, 'palette' AS detector, pos, round(off, 6) AS severity
        FROM (SELECT slide_id, pos, coalesce({_distance("own", "want")}, {_NEAREST}) AS off FROM ({_labs("SELECT * FROM {elements}", own="r g b", want="er eg eb")}) l) q WHERE off >= 1.5""",
    "color_group": f"""SELECT slide_id, 'color_group' AS detector, pos, round(off, 6) AS severity FROM (
          SELECT slide_id, pos, {_distance("own", "most")} AS off FROM ({_labs(_MAJORITY, own="r g b", most="mr mg mb")}) l) q WHERE off >= 1.5""",
    "margin": f"SELECT slide_id, 'margin' AS detector, pos, {_MARGIN} AS severity FROM {{elements}} WHERE {_MARGIN} > 0",
}
for _name, _function in zip(FINDINGS, (layout.overflow_findings, layout.overlap_findings, layout.alignment_findings, layout.font_findings, layout.palette_findings, layout.color_group_findings, layout.margin_findings), strict=True):
    query(f"{_name}_findings", "elements", _function, FINDINGS[_name])
_ALL = " UNION ALL ".join(f"SELECT * FROM ({x}) {n}_q" for n, x in FINDINGS.items())
query("lint_summary", "elements", lambda e: layout.lint(e).groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("slide_id").alias("slides"), F.round(F.max("severity"), 6).alias("worst")), f"SELECT detector, count(*) AS n, count(DISTINCT slide_id) AS slides, round(max(severity), 6) AS worst FROM ({_ALL}) a GROUP BY detector")
query("linter_score", "elements", layout.lint_scores, f"""SELECT s.slide_id, coalesce(n, 0) AS n_findings, greatest(CAST(0 AS DOUBLE), 1 - CAST(0.15 AS DOUBLE) * coalesce(n, 0)) AS score
    FROM (SELECT DISTINCT slide_id FROM {{elements}}) s LEFT JOIN (SELECT slide_id, count(*) AS n FROM ({_ALL}) a GROUP BY slide_id) f ON s.slide_id = f.slide_id""")
_CONTRAST = _labs("SELECT e.*, CASE WHEN br IS NULL THEN sr ELSE br END AS ur, CASE WHEN br IS NULL THEN sg ELSE bg END AS ug, CASE WHEN br IS NULL THEN sb ELSE bb END AS ub FROM {elements} e LEFT JOIN {slides} s ON e.slide_id = s.slide_id", own="r g b", below="ur ug ub")
_CHEATS = f"""SELECT slide_id, 'overflow_hidden' AS kind, pos, CAST(NULL AS BIGINT) AS other, CAST(1 AS DOUBLE) AS severity FROM {{elements}} WHERE hidden AND length(text) > 0
    UNION ALL SELECT slide_id, 'tiny_text', pos, NULL, 6 - font FROM {{elements}} WHERE length(text) > 0 AND font < 6
    UNION ALL SELECT slide_id, 'faint_text', pos, NULL, 1 - opacity FROM {{elements}} WHERE length(text) > 0 AND opacity < CAST(0.2 AS DOUBLE)
    UNION ALL SELECT slide_id, 'low_contrast', pos, NULL, round(8 - off, 6) FROM (SELECT *, {_distance("own", "below")} AS off FROM ({_CONTRAST}) l) m WHERE length(text) > 0 AND off < 8
    UNION ALL SELECT slide_id, 'off_canvas', pos, NULL, 1 FROM {{elements}} WHERE x > 1920 OR y > 1080 OR x + w < 0 OR y + h < 0
    UNION ALL SELECT p.slide_id, 'covering_overlay', p.pos, p.other, p.iou FROM ({_PAIRS}) p JOIN {{elements}} a ON p.slide_id = a.slide_id AND p.pos = a.pos JOIN {{elements}} b ON p.slide_id = b.slide_id AND p.other = b.pos
      WHERE p.iou >= CAST(0.85 AS DOUBLE) AND ((length(a.text) = 0 AND (a.fill OR a.br IS NOT NULL)) OR (length(b.text) = 0 AND (b.fill OR b.br IS NOT NULL)))
    UNION ALL SELECT slide_id, 'texture_background', NULL, NULL, 1 FROM {{slides}} WHERE texture"""
query("cheat_flags", "elements slides", layout.cheats, _CHEATS)
query("hacking_score", "elements slides", lambda e, s: layout.cheats(e, s).groupBy("slide_id").agg(F.count("*").alias("n")).select("slide_id", "n", F.greatest(F.lit(0.0), 1 - 0.2 * F.col("n")).alias("score")), f"SELECT slide_id, count(*) AS n, greatest(CAST(0 AS DOUBLE), 1 - CAST(0.2 AS DOUBLE) * count(*)) AS score FROM ({_CHEATS}) c GROUP BY slide_id")
_BOX_IOU = _IOU
_LEGAL = f"""SELECT a.* FROM {{boxes}} a WHERE a.x >= 20 AND a.y >= 20 AND a.x1 <= 1900 AND a.y1 <= 1060
    AND NOT EXISTS (SELECT 1 FROM {{boxes}} b WHERE a.slide_id = b.slide_id AND a.pos <> b.pos AND {_BOX_IOU} > CAST(0.1 AS DOUBLE))"""
query("legal_boxes", "boxes", layout.legal_boxes, _LEGAL)
_OVER = """SELECT slide_id, pos, greatest(y1, coalesce(low, y1)) AS bottom, greatest(x1, coalesce(far, x1)) AS right, greatest(y1, coalesce(low, y1)) - y1 AS v_over, greatest(x1, coalesce(far, x1)) - x1 AS h_over FROM (
      SELECT slide_id, pos, x1, y1, max(sy1) FILTER (WHERE down) AS low, max(sx1) FILTER (WHERE across) AS far FROM (
        SELECT r.slide_id, r.pos, r.x1, r.y1, s.x1 AS sx1, s.y1 AS sy1,
          (s.x + s.x1) / 2 BETWEEN r.x - 2 AND r.x1 + 2 AND s.y >= r.y - 2 AND s.y < coalesce(r.lowest, 1080) AS down,
          (s.y + s.y1) / 2 BETWEEN r.y - 2 AND r.y1 + 2 AND s.x >= r.x - 2 AND s.x < coalesce(r.wall, 1920) AS across
        FROM (SELECT a.slide_id, a.pos, a.x, a.x1, a.y, a.y1, min(b.y) FILTER (WHERE b.x1 > a.x AND b.x < a.x1 AND b.y >= a.y1 - 2) AS lowest, min(b.x) FILTER (WHERE b.y1 > a.y AND b.y < a.y1 AND b.x >= a.x1 - 2) AS wall
          FROM {boxes} a LEFT JOIN {boxes} b ON a.slide_id = b.slide_id AND a.pos <> b.pos GROUP BY ALL) r
        JOIN {spans} s ON r.slide_id = s.slide_id) q WHERE down OR across GROUP BY ALL) t"""
query("box_overflow", "boxes spans", layout.box_overflow, _OVER)
_GROWN_IOU = _BOX_IOU.replace("a.x + a.w", "a.x + a.gw").replace("a.y + a.h", "a.y + a.gh").replace("a.w * a.h", "a.gw * a.gh")
_HITS = f"""SELECT a.slide_id, a.deck_id, a.pos, v_over, h_over, round(vs, 6) AS v_share, round(hs, 6) AS h_share, page_over, coalesce(c.collides, FALSE) AS collides, no_autofit OR page_over >= 3 OR coalesce(c.collides, FALSE) AS hard FROM hits a
    LEFT JOIN (SELECT a.slide_id, a.pos, TRUE AS collides FROM hits a JOIN {{boxes}} b ON a.slide_id = b.slide_id AND a.pos <> b.pos WHERE {_GROWN_IOU} > CAST(0.1 AS DOUBLE) AND {_BOX_IOU} <= CAST(0.1 AS DOUBLE) GROUP BY a.slide_id, a.pos) c
    ON a.slide_id = c.slide_id AND a.pos = c.pos"""
_HITS_CTE = f"""hits AS (SELECT l.*, o.v_over, o.h_over, o.right - l.x AS gw, o.bottom - l.y AS gh, CASE WHEN h > 0 THEN v_over / h ELSE 0 END AS vs, CASE WHEN w > 0 THEN h_over / w ELSE 0 END AS hs, greatest(0, o.bottom - 1080, o.right - 1920) AS page_over
    FROM ({_LEGAL}) l JOIN ({_OVER}) o ON l.slide_id = o.slide_id AND l.pos = o.pos
    WHERE (v_over >= 3 AND CASE WHEN h > 0 THEN v_over / h ELSE 0 END >= CAST(0.04 AS DOUBLE)) OR (h_over >= 3 AND CASE WHEN w > 0 THEN h_over / w ELSE 0 END >= CAST(0.04 AS DOUBLE)))"""
query("overflow_hits", "boxes spans", layout.overflow_hits, f"WITH {_HITS_CTE} {_HITS}")


def _prevalence(boxes: DataFrame, spans: DataFrame) -> DataFrame:
    """Legal boxes and those with overflow, all and hard, by slide, by deck and over all: a rollup."""
    hits = layout.overflow_hits(boxes, spans).select("slide_id", "pos", F.lit(True).alias("hit"), "hard")
    df = layout.legal_boxes(boxes).join(hits, ["slide_id", "pos"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("hit", "hard")})
    slide = lambda c: F.countDistinct(F.when(F.col(c), F.col("slide_id")))
    return df.rollup("deck_id").agg(F.count("*").alias("boxes"), F.count_if("hit").alias("hits"), F.count_if("hard").alias("hard_hits"), F.countDistinct("slide_id").alias("slides"), slide("hit").alias("slides_hit"), slide("hard").alias("slides_hard"))


query("prevalence_rollup", "boxes spans", _prevalence, f"""WITH {_HITS_CTE}, found AS ({_HITS}) SELECT l.deck_id, count(*) AS boxes, count(f.pos) AS hits, count(*) FILTER (WHERE f.hard) AS hard_hits,
    count(DISTINCT l.slide_id) AS slides, count(DISTINCT f.slide_id) AS slides_hit, count(DISTINCT CASE WHEN f.hard THEN f.slide_id END) AS slides_hard
    FROM ({_LEGAL}) l LEFT JOIN found f ON l.slide_id = f.slide_id AND l.pos = f.pos GROUP BY ROLLUP (l.deck_id)""")

# --- judges ---------------------------------------------------------------------------------------------------------

_facts = judging.classify
_FACTS = """(SELECT *, CASE raw_modality WHEN 'Bprime' THEN 'B_prime' ELSE raw_modality END AS modality, coalesce(expected, 'NO_DEFECT') AS type,
    CASE WHEN expected IS NULL THEN predicted IS NULL ELSE predicted IS NOT DISTINCT FROM expected END AS correct FROM {probe})"""
_Z = f"CAST({Z95!r} AS DOUBLE)"


def _low(k: str, n: str, sign: str) -> str:
    edge = "greatest(0, " if sign == "-" else "least(1, "
    rest = "0" if sign == "-" else "1"
    p, m = f"({k}) / CAST(nullif({n}, 0) AS DOUBLE)", f"CAST(nullif({n}, 0) AS DOUBLE)"
    return f"coalesce({edge}({p} + {_Z} * {_Z} / (2 * {m}) {sign} {_Z} * sqrt({p} * (1 - {p}) / {m} + {_Z} * {_Z} / (4 * {m} * {m}))) / (1 + {_Z} * {_Z} / {m})), {rest})"


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


_RATES = f"""{_div("tp", "n_pos")} AS recall, {_div("(n_neg - tn)", "n_neg")} AS fpr, {_div("tp", "(tp + n_neg - tn)")} AS precision,
    coalesce(2 * {_div("tp", "(tp + n_neg - tn)")} * {_div("tp", "n_pos")} / nullif({_div("tp", "(tp + n_neg - tn)")} + {_div("tp", "n_pos")}, 0), 0) AS f1,
    ({_div("tp", "n_pos")} + {_div("tn", "n_neg")}) / 2 AS bal_acc, round(({_low("tp", "n_pos", "-")} + {_low("tn", "n_neg", "-")}) / 2, 9) AS ba_low,
    round(({_low("tp", "n_pos", "+")} + {_low("tn", "n_neg", "+")}) / 2, 9) AS ba_high"""


def _counts(hit: str = "has_defect") -> str:
    return f"""count(*) FILTER (WHERE NOT is_clean AND {hit}) AS tp, count(*) FILTER (WHERE NOT is_clean) AS n_pos,
      count(*) FILTER (WHERE is_clean AND NOT {hit}) AS tn, count(*) FILTER (WHERE is_clean) AS n_neg"""


_METRICS = f"""SELECT c.model, c.modality, c.task, c.type, c.template, c.resolution, n, {_div("k", "n")} AS accuracy, CASE WHEN c.type = 'NO_DEFECT' THEN 0 ELSE {_div("tp", "n")} END AS recall,
      CASE WHEN c.type = 'NO_DEFECT' THEN 0 ELSE {_div("tp", "(tp + coalesce(fp, 0))")} END AS precision,
      CASE WHEN c.type = 'NO_DEFECT' OR tp = 0 THEN 0 ELSE 2 * ({_div("tp", "(tp + coalesce(fp, 0))")}) * ({_div("tp", "n")}) / (({_div("tp", "(tp + coalesce(fp, 0))")}) + ({_div("tp", "n")})) END AS f1, coalesce(fp, 0) AS fp
    FROM (SELECT model, modality, task, type, template, resolution, count(*) AS n, count(*) FILTER (WHERE correct) AS k, count(*) FILTER (WHERE predicted = type) AS tp FROM {_FACTS} f GROUP BY ALL) c
    LEFT JOIN (SELECT model, modality, task, predicted AS type, count(*) AS fp FROM {_FACTS} f WHERE predicted IS NOT NULL AND predicted IS DISTINCT FROM expected GROUP BY ALL) w
    ON c.model = w.model AND c.modality = w.modality AND c.task = w.task AND c.type = w.type"""
query("probe_metrics", "probe", lambda p: judging.aggregate_metrics(_facts(p)), _METRICS)
query("attribution", "probe", lambda p: judging.attribute_failures(_facts(p)), f"""
    WITH f AS (SELECT * FROM {_FACTS} q), a AS (SELECT model, sample_id, arg_max(type, ord) AS type, arg_max(template, ord) AS template, arg_max(correct, ord) AS a FROM f WHERE task = 'T1' AND modality = 'A' GROUP BY 1, 2),
    b AS (SELECT model, sample_id, arg_max(correct, ord) AS b FROM f WHERE task = 'T1' AND modality = 'B' GROUP BY 1, 2),
    r AS (SELECT model, sample_id, arg_max(repaired, ord) AS repaired FROM f WHERE task = 'T3' AND modality = 'A' AND repaired IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT a.model, a.type, a.template, a.a, b.b, r.repaired FROM a JOIN b ON a.model = b.model AND a.sample_id = b.sample_id LEFT JOIN r ON a.model = r.model AND a.sample_id = r.sample_id),
    g AS (SELECT model, type, template, count(*) AS n, count(*) FILTER (WHERE NOT a AND b) AS perception, count(*) FILTER (WHERE NOT a AND NOT b) AS reasoning, count(*) FILTER (WHERE a) AS image_success,
      count(*) FILTER (WHERE a AND NOT coalesce(repaired, TRUE)) AS execution FROM j GROUP BY model, type, template)
    SELECT *, {_div("perception", "n")} AS perception_rate, {_div("reasoning", "n")} AS reasoning_rate, {_div("execution", "n")} AS execution_rate, {_div("image_success", "n")} AS image_success_rate FROM g""")
_GAPS = f"""SELECT model, type, template, n_left, n_right, {_div("h_left", "n_left")} AS left_accuracy, {_div("h_right", "n_right")} AS right_accuracy, {_div("h_right", "n_right")} - {_div("h_left", "n_left")} AS gap
    FROM (SELECT model, type, template, count(*) FILTER (WHERE modality = 'A') AS n_left, count(*) FILTER (WHERE modality = 'B') AS n_right, count(*) FILTER (WHERE modality = 'A' AND correct) AS h_left,
      count(*) FILTER (WHERE modality = 'B' AND correct) AS h_right FROM {_FACTS} f WHERE task = 'T1' GROUP BY ALL) q WHERE n_left > 0 AND n_right > 0"""
query("modality_gaps", "probe", lambda p: judging.modality_gaps(_facts(p)), _GAPS)
_FREE, _HELD = _div("fw", "n_free"), _div("tw", "n_held")
_COLLAPSE = f"""SELECT model, modality, task, type, n_free, n_held, {_FREE} AS freeform_error, {_HELD} AS template_error, {_FREE} - {_HELD} AS reduction, coalesce(({_FREE} - {_HELD}) / nullif({_FREE}, 0), 0) AS relative_reduction
    FROM (SELECT model, modality, task, type, count(*) FILTER (WHERE template = 'freeform' AND NOT correct) AS fw, count(*) FILTER (WHERE template = 'freeform') AS n_free,
      count(*) FILTER (WHERE template = 'template' AND NOT correct) AS tw, count(*) FILTER (WHERE template = 'template') AS n_held FROM {_FACTS} f GROUP BY ALL) q WHERE n_free > 0 AND n_held > 0"""
query("template_collapse", "probe", lambda p: judging.template_collapse(_facts(p)), _COLLAPSE)
query("variance_gates", "probe", lambda p: judging.variance_gates(_facts(p)).withColumn("effect", F.round("effect", 9)).withColumn("sigma", F.round("sigma", 9)), f"""
    SELECT model, task, type, template, na AS "n_A", nb AS "n_B", round(mb - ma, 9) AS effect, round(s, 9) AS sigma, CASE WHEN CASE WHEN s = 0 THEN mb <> ma ELSE abs(mb - ma) >= 2 * s END THEN 'conclusive' ELSE 'inconclusive' END AS verdict
    FROM (SELECT *, sqrt(ma * (1 - ma) / na + mb * (1 - mb) / nb) AS s FROM (SELECT model, task, type, template, count(*) FILTER (WHERE modality = 'A') AS na, count(*) FILTER (WHERE modality = 'B') AS nb,
      avg(CAST(correct AS INT)) FILTER (WHERE modality = 'A') AS ma, avg(CAST(correct AS INT)) FILTER (WHERE modality = 'B') AS mb FROM {_FACTS} f GROUP BY ALL) q WHERE na > 0 AND nb > 0) r""")
_POINTS = f"""SELECT model, modality, task, type, coalesce(grid, severity) AS bin, avg(severity) AS realized, count(*) AS n, CAST(count(*) FILTER (WHERE predicted = expected) AS DOUBLE) / count(*) AS rate
      FROM {_FACTS} f WHERE expected IS NOT NULL AND coalesce(grid, severity) IS NOT NULL GROUP BY ALL"""
query("psychometric_points", "probe", lambda p: judging.psychometric_points(_facts(p)), _POINTS)
query("psychometric", "probe", lambda p: judging.psychometric(_facts(p)), f"SELECT model, modality, task, type, min(CASE WHEN rate >= 0.5 THEN bin END) AS threshold, count(*) AS n_bins, max(rate) AS best_rate FROM ({_POINTS}) q GROUP BY ALL")
query("repair_rates", "probe", lambda p: judging.repair_rates(_facts(p)), f"SELECT model, type, template, count(*) AS n, avg(CAST(repaired AS INT)) AS pass_rate FROM {_FACTS} f WHERE task = 'T3' AND repaired IS NOT NULL GROUP BY ALL")
query("distribution", "probe", lambda p: judging.distribution(_facts(p)), f"""
    SELECT type, task, template, count(*) AS n, avg(severity) AS mean_severity, min(severity) AS min_severity, max(severity) AS max_severity FROM {_FACTS} f GROUP BY GROUPING SETS ((type), (task), (template), ())""")
query("hypotheses", "probe", lambda p: judging.hypotheses(judging.modality_gaps(_facts(p)), judging.template_collapse(_facts(p))), f"""
    SELECT 'H1' AS hypothesis, CASE WHEN min(gap) FILTER (WHERE type LIKE 'G%') IS NULL THEN 'inconclusive' WHEN min(gap) FILTER (WHERE type LIKE 'G%') >= 0.2 AND coalesce(max(abs(gap)) FILTER (WHERE type LIKE 'S%'), 0) <= CAST(0.1 AS DOUBLE) THEN 'pass' ELSE 'fail' END AS verdict,
      min(gap) FILTER (WHERE type LIKE 'G%') AS least, coalesce(max(abs(gap)) FILTER (WHERE type LIKE 'S%'), 0) AS semantic FROM ({_GAPS}) g
    UNION ALL SELECT 'H1_tpl', CASE WHEN min(relative_reduction) IS NULL THEN 'inconclusive' WHEN min(relative_reduction) >= 0.5 THEN 'pass' ELSE 'fail' END, min(relative_reduction), NULL FROM ({_COLLAPSE}) c WHERE type IN ('G3', 'G4', 'G5', 'G6')""")
_CELLS = f"SELECT *, {_RATES} FROM (SELECT model, cond, defect, {_counts()} FROM {{elicit}} WHERE NOT failure GROUP BY ALL) q"
query("confusion_cells", "elicit", judging.confusion_cells, _CELLS)
query("confusion_cells_miss", "elicit", lambda e: judging.confusion_cells(e, "miss", "named_target"), f"SELECT *, {_RATES} FROM (SELECT model, cond, defect, {_counts('(named_target AND NOT failure)')} FROM {{elicit}} GROUP BY ALL) q")
query("stratum_rollup", "elicit", judging.stratum_cells, f"""SELECT *, {_RATES} FROM (SELECT defect, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, {_counts()} FROM {{elicit}} WHERE NOT failure
    GROUP BY GROUPING SETS ((defect), (defect, stratum))) q""")
query("micro_macro", "elicit", lambda e: judging.micro_macro(judging.confusion_cells(e)).withColumn("macro", F.round("macro", 9)), f"""SELECT model, cond, round(avg(bal_acc), 9) AS macro, (coalesce(sum(tp) / nullif(sum(n_pos), 0), 0) + coalesce(sum(tn) / nullif(sum(n_neg), 0), 0)) / 2 AS micro
    FROM ({_CELLS}) c GROUP BY model, cond""")
query("best_cells", "elicit", lambda e: judging.best_cells(judging.confusion_cells(e)), f"SELECT model, defect, cond, bal_acc FROM (SELECT *, row_number() OVER (PARTITION BY model, defect ORDER BY bal_acc DESC, cond) AS r FROM ({_CELLS}) c) q WHERE r = 1")
_OK = "bal_acc >= CAST({0} AS DOUBLE) AND precision >= CAST({0} AS DOUBLE)"
query("coverage_configs", "elicit", lambda e: judging.coverage(judging.confusion_cells(e), 0.45).withColumn("covered_types", F.array_join("covered_types", ",")).withColumn("mean_bal_acc", F.round("mean_bal_acc", 9)), f"""SELECT model, cond, count(*) FILTER (WHERE {_OK.format(0.45)}) AS covered, count(*) AS types, round(avg(bal_acc), 9) AS mean_bal_acc,
    coalesce(string_agg(CASE WHEN {_OK.format(0.45)} THEN defect END, ',' ORDER BY defect), '') AS covered_types FROM ({_CELLS}) c GROUP BY model, cond""")
_AFC_RIGHT = "(pick0 = 'a' AND pick1 = 'b')"
_AFC_BOTH = "(pick0 IN ('a', 'b') AND pick1 IN ('a', 'b'))"
query("afc_metrics", "afc", judging.afc_metrics, f"""SELECT *, {_div("strict_hits", "decisive")} AS strict, {_div("probe", "judgements")} AS loose, {_div("first_picks", "(probe + partner)")} AS pick_first,
    {_div("ties", "judgements")} AS tie_rate, CASE WHEN mode = 'clean' THEN {_div("alike", "n_pairs")} END AS invention FROM (
    SELECT defect, mode, count(*) AS n_pairs, count(pick0) + count(pick1) AS judgements, count(*) FILTER (WHERE pick0 = 'a') + count(*) FILTER (WHERE pick1 = 'b') AS probe,
      count(*) FILTER (WHERE pick0 = 'b') + count(*) FILTER (WHERE pick1 = 'a') AS partner, count(*) FILTER (WHERE pick0 = 'tie') + count(*) FILTER (WHERE pick1 = 'tie') AS ties,
      count(*) FILTER (WHERE pick0 = 'a') + count(*) FILTER (WHERE pick1 = 'a') AS first_picks, count(*) FILTER (WHERE {_AFC_BOTH}) AS decisive, count(*) FILTER (WHERE {_AFC_RIGHT}) AS strict_hits,
      count(*) FILTER (WHERE {_AFC_BOTH} AND pick0 <> pick1) AS alike FROM {{afc}} GROUP BY defect, mode) q""")
_AFC_BAL = f"""SELECT defect, tp, n_pos, tn, n_neg, {_RATES} FROM (SELECT defect, tp, n_pos, CASE WHEN n_clean > 0 THEN quiet ELSE n_pos END AS tn, CASE WHEN n_clean > 0 THEN n_clean ELSE n_pos END AS n_neg FROM (
      SELECT defect, count(*) FILTER (WHERE mode = 'paired' AND {_AFC_RIGHT}) AS tp, count(*) FILTER (WHERE mode = 'paired') AS n_pos,
        count(*) FILTER (WHERE mode <> 'paired' AND NOT coalesce({_AFC_BOTH} AND pick0 <> pick1, FALSE)) AS quiet, count(*) FILTER (WHERE mode <> 'paired') AS n_clean FROM {{afc}} GROUP BY defect) c WHERE n_pos > 0) q"""
query("afc_balanced", "afc", judging.afc_balanced, f"SELECT * EXCLUDE (fpr, precision, f1) FROM ({_AFC_BAL}) q")
query("decomposition", "elicit afc", lambda e, a: judging.decompose(judging.confusion_cells(e), judging.afc_balanced(a)), f"""
    WITH s AS (SELECT defect, cond, (coalesce(sum(tp) / nullif(sum(n_pos), 0), 0) + coalesce(sum(tn) / nullif(sum(n_neg), 0), 0)) / 2 AS ba FROM ({_CELLS}) c GROUP BY defect, cond),
    w AS (SELECT defect, max(ba) FILTER (WHERE cond = 'C0') AS c0, max(ba) FILTER (WHERE cond = 'NAMED') AS named FROM s GROUP BY defect),
    j AS (SELECT w.defect, c0, named, a.bal_acc AS afc, named - c0 AS naming, a.bal_acc - named AS pairing FROM w JOIN ({_AFC_BAL}) a ON w.defect = a.defect)
    SELECT *, CASE WHEN greatest(naming, pairing) <= 0 THEN 'none' WHEN naming >= pairing THEN 'naming' ELSE 'pairing' END AS gate FROM j""")
_DISCORDANT = """SELECT x.defect, count(*) FILTER (WHERE NOT x.ok AND y.ok) AS b, count(*) FILTER (WHERE x.ok AND NOT y.ok) AS c FROM
    (SELECT defect, sample_id, bool_and(has_defect <> is_clean) AS ok FROM {elicit} WHERE NOT failure AND cond = 'C0' GROUP BY ALL) x JOIN
    (SELECT defect, sample_id, bool_and(has_defect <> is_clean) AS ok FROM {elicit} WHERE NOT failure AND cond = 'C3' GROUP BY ALL) y ON x.defect = y.defect AND x.sample_id = y.sample_id GROUP BY x.defect"""
_EXACT = """CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(CAST(0.5 AS DOUBLE)))))) END"""
_MCNEMAR = f"SELECT *, round({_EXACT}, 6) AS p FROM ({_DISCORDANT}) d"
query("mcnemar_exact", "elicit", judging.paired_mcnemar, _MCNEMAR.replace("lgamma(i + 1)", "lgamma(CAST(i + 1 AS DOUBLE))"))
query("mcnemar_stratified", "elicit", lambda e: audits.stratified_mcnemar(judging.paired_mcnemar(e)).withColumn("p", F.round("p", 9)), f"""
    WITH s AS (SELECT CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, max(c) AS max_reversal FROM ({_DISCORDANT}) d), z AS (SELECT *, {_div("(b - c) * (b - c)", "(b + c)")} AS chi2, sqrt({_div("(b - c) * (b - c)", "(b + c)")}) AS z FROM s)
    SELECT b, c, max_reversal, chi2, round(least(1, 2 * ({tail_sql("z")})), 9) AS p FROM z""")
_FAMILY = f"SELECT model, defect, tp, n_pos, n_neg - tn AS fp, n_neg, row_number() OVER (ORDER BY model, cond, defect) AS ord, cond FROM ({_CELLS}) c"


def _family(elicit: DataFrame) -> DataFrame:
    """Tests of a cell's hit rate against its false alarms, in order."""
    from pyspark.sql import Window

    cells = judging.confusion_cells(elicit).select("model", "cond", "defect", "tp", "n_pos", (F.col("n_neg") - F.col("tn")).alias("fp"), "n_neg")
    cells = cells.withColumn("ord", F.row_number().over(Window.orderBy("model", "cond", "defect")))
    return audits.two_proportion_z(cells, "tp", "n_pos", "fp", "n_neg").withColumn("z", F.round("z", 9)).withColumn("p", F.round("p", 9))


_POOL = "(CAST(tp + fp AS DOUBLE) / (n_pos + n_neg))"
_ZTEST = f"""SELECT *, round(least(1, 2 * ({tail_sql("z0")})), 9) AS p, round(z0, 9) AS z FROM (SELECT *, coalesce((CAST(tp AS DOUBLE) / nullif(n_pos, 0) - CAST(fp AS DOUBLE) / nullif(n_neg, 0))
    / nullif(sqrt({_POOL} * (1 - {_POOL}) * (CAST(1 AS DOUBLE) / nullif(n_pos, 0) + CAST(1 AS DOUBLE) / nullif(n_neg, 0))), 0), 0) AS z0 FROM ({_FAMILY}) f) g"""
query("two_prop_z", "elicit", _family, f"SELECT * EXCLUDE (z0) FROM ({_ZTEST}) t")
query("holm", "elicit", lambda e: audits.holm(_family(e)).select("ord", "p", F.round("holm", 9).alias("holm"), "holm_reject"), f"""
    SELECT ord, p, round(h, 9) AS holm, h <= 0.05 AS holm_reject FROM (SELECT ord, p, max(raw) OVER (ORDER BY p, ord ROWS UNBOUNDED PRECEDING) AS h FROM (
      SELECT ord, p, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, ord) + 1) * p) AS raw FROM ({_ZTEST}) t) q) r""")
query("benjamini_hochberg", "elicit", lambda e: audits.benjamini_hochberg(_family(e)).select("ord", "p", F.round("bh", 9).alias("bh"), "bh_reject"), f"""
    SELECT ord, p, round(h, 9) AS bh, h <= 0.05 AS bh_reject FROM (SELECT ord, p, min(raw) OVER (ORDER BY p DESC, ord DESC ROWS UNBOUNDED PRECEDING) AS h FROM (
      SELECT ord, p, least(1, p * count(*) OVER () / row_number() OVER (ORDER BY p, ord)) AS raw FROM ({_ZTEST}) t) q) r""")
query("wilson_shares", "elicit", lambda e: judging.shares(e, ["defect", "cond"], "named_target"), f"""SELECT defect, cond, n, k, CAST(k AS DOUBLE) / n AS share, round({_low("k", "n", "-")}, 9) AS low, round({_low("k", "n", "+")}, 9) AS high
    FROM (SELECT defect, cond, count(*) AS n, count(*) FILTER (WHERE named_target) AS k FROM {{elicit}} GROUP BY ALL) q""")

# --- audits ---------------------------------------------------------------------------------------------------------

query("panel_summary", "ratings", lambda r: audits.panel_summary(r).withColumn("sources", F.array_join("sources", ",")), """
    SELECT sample_id, count(*) AS n, round(avg(score), 9) AS mean_score, round(stddev_pop(score), 9) AS sd, count(*) FILTER (WHERE score >= 0.5) AS passes,
      string_agg(DISTINCT source, ',' ORDER BY source) AS sources, 2 * count(*) FILTER (WHERE score >= 0.5) >= count(*) AS majority FROM {ratings} GROUP BY sample_id""")
query("kappa", "ratings", audits.agreement, """
    WITH v AS (SELECT sample_id, list(score >= 0.5 ORDER BY ord) AS v FROM {ratings} WHERE source = 'human' GROUP BY sample_id),
    c AS (SELECT len(v) AS n, len(list_filter(v, lambda x: x)) AS y, v FROM v),
    s AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, CAST(sum((y * (y - 1) + (n - y) * (n - y - 1)) // 2) AS BIGINT) AS alike, count(*) FILTER (WHERE n = 2) AS m,
      count(*) FILTER (WHERE n = 2 AND v[1] = v[2]) AS same, count(*) FILTER (WHERE n = 2 AND v[1]) AS fy, count(*) FILTER (WHERE n = 2 AND v[2]) AS sy FROM c),
    e AS (SELECT *, CAST(fy AS DOUBLE) / m * sy / m + (1 - CAST(fy AS DOUBLE) / m) * (1 - CAST(sy AS DOUBLE) / m) AS pe FROM s)
    SELECT pairs, CAST(alike AS DOUBLE) / pairs AS agreement, m AS two_rater_samples, round(CASE WHEN pe = 1 THEN 1 ELSE (CAST(same AS DOUBLE) / m - pe) / (1 - pe) END, 9) AS kappa FROM e""")
_REWARD = f"""SELECT *, CAST(wins AS DOUBLE) / n AS preference, round({_low("wins", "n", "-")}, 9) AS low, round({_low("wins", "n", "+")}, 9) AS high FROM (
    SELECT scorer, category, defect, count(*) AS n, count(*) FILTER (WHERE gap > 0) AS wins, count(*) FILTER (WHERE gap = 0) AS ties, round(avg(gap), 6) AS mean_gap,
      list_sort(list(gap))[count(*) // 2 + 1] AS upper_median FROM (SELECT *, round(clean - defective, 6) AS gap FROM {{reward_pairs}}) p GROUP BY ALL) q"""
query("reward_preference", "reward_pairs", audits.reward_preference, _REWARD)
query("reward_categories", "reward_pairs", lambda r: audits.reward_categories(audits.reward_preference(r)), f"""SELECT *, CASE WHEN above = scorers THEN 'all_detect' WHEN above = 0 THEN 'all_blind' ELSE 'split' END AS verdict FROM (
    SELECT category, defect, count(*) AS scorers, count(*) FILTER (WHERE low > 0.5) AS above, count(*) FILTER (WHERE high < 0.5) AS below FROM ({_REWARD}) r GROUP BY category, defect HAVING count(*) >= 2) q""")
_RUNS = """SELECT cond, run, count(*) AS rollouts, min(CASE WHEN best >= 0.8 THEN n END) AS reached, arg_min(score, n) AS first, arg_max(score, n) AS last, max(score) AS best,
      arg_max(score, n) - arg_min(score, n) AS gain, max(score) - arg_min(score, n) AS best_gain FROM (
    SELECT cond, run, n, score, greatest(0, max(score) OVER (PARTITION BY cond, run ORDER BY n ROWS UNBOUNDED PRECEDING)) AS best FROM {rollouts}) q GROUP BY cond, run"""
query("rollouts_to_threshold", "rollouts", audits.rollouts_to_threshold, _RUNS)
_MEANS = f"""SELECT cond, count(*) AS runs, count(reached) AS n_reached, avg(reached) AS mean_reached, avg(coalesce(reached, budget)) AS mean_censored, round(avg(gain), 9) AS mean_gain, round(avg(best_gain), 9) AS mean_best_gain,
    round(coalesce((count(*) * sum(first * best_gain) - sum(first) * sum(best_gain)) / nullif(sqrt((count(*) * sum(first * first) - sum(first) * sum(first)) * (count(*) * sum(best_gain * best_gain) - sum(best_gain) * sum(best_gain))), 0), 0), 6) AS r_first_gain
    FROM (SELECT *, max(rollouts) OVER () AS budget FROM ({_RUNS}) r) q GROUP BY cond"""
query("censored_means", "rollouts", lambda r: audits.censored_means(audits.rollouts_to_threshold(r)), _MEANS)
query("regime", "rollouts", lambda r: audits.regime(audits.censored_means(audits.rollouts_to_threshold(r))).withColumn("spread", F.round("spread", 9)), f"""
    SELECT max(mean_best_gain) AS top, round(max(mean_best_gain) - min(mean_best_gain), 9) AS spread, (SELECT cond FROM ({_MEANS}) n ORDER BY mean_best_gain DESC, cond DESC LIMIT 1) AS best_cond FROM ({_MEANS}) m""")

# --- text -----------------------------------------------------------------------------------------------------------


def _as_slides(documents: DataFrame) -> DataFrame:
    """Documents as decks and their lines as slides."""
    return documents.select(F.col("doc_id").alias("deck"), F.posexplode(F.split("text", "\n", -1)).alias("slide", "text"))


_SLIDES = "(SELECT doc_id AS deck, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS slide, unnest(string_split(text, chr(10))) AS text FROM documents)"
_TERMS = f"""SELECT deck, term, count(DISTINCT slide) AS slides, CAST(min(slide) AS INT) AS first_slide FROM (
    SELECT deck, slide, trim(regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '{wording.TERM}')), '\\s+', ' ', 'g')) AS term FROM {_SLIDES} s) q GROUP BY deck, term"""
query("term_occurrences", "documents", lambda d: wording.occurrences(_as_slides(d)), _TERMS.replace("{2,}", "<2,>"))
SQL["term_occurrences"] = SQL["term_occurrences"].replace("<2,>", "{2,}")
query("term_variants", "documents", lambda d: wording.variants(wording.occurrences(_as_slides(d))))
query("deck_caption", "elements", wording.captions, """SELECT slide_id, string_agg(etype || ' e' || pos || ' at (' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(w AS BIGINT) AS VARCHAR) || ',' ||
    CAST(CAST(h AS BIGINT) AS VARCHAR) || '): ' || substring(text, 1, 120), ' | ' ORDER BY pos) AS caption FROM {elements} GROUP BY slide_id""")
query("density", "documents", lambda d: wording.density(_as_slides(d)), f"""SELECT deck, slide, words, CASE WHEN words <= 300 THEN 'none' WHEN (words - 300) / CAST(300 AS DOUBLE) <= 0.2 THEN 'minor' WHEN (words - 300) / CAST(300 AS DOUBLE) <= 0.5 THEN 'moderate' ELSE 'severe' END AS level
    FROM (SELECT deck, CAST(slide AS INT) AS slide, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS words FROM {_SLIDES} s) q""")
query("chat_messages", "conversations", lambda c: contract.messages(c).select("conv_id", "n_turns", "answer"), """SELECT conv_id, CAST(count(*) AS INT) AS n_turns,
    arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id""")
query("severity_levels", "probe", lambda p: p.groupBy(contract.severity_level(F.col("expected"), F.col("severity"), F.lit(None).cast("string")).alias("level"), contract.modality(F.col("raw_modality")).alias("modality")).agg(F.count("*").alias("n")), """
    SELECT level, modality, count(*) AS n FROM (SELECT CASE raw_modality WHEN 'Bprime' THEN 'B_prime' ELSE raw_modality END AS modality, CASE expected
      WHEN 'G1' THEN CASE WHEN severity <= 8 THEN 'minor' WHEN severity <= 32 THEN 'moderate' ELSE 'severe' END WHEN 'G2' THEN CASE WHEN severity <= 0.05 THEN 'minor' WHEN severity <= 0.2 THEN 'moderate' ELSE 'severe' END
      WHEN 'G3' THEN CASE WHEN severity <= 4 THEN 'minor' WHEN severity <= 16 THEN 'moderate' ELSE 'severe' END WHEN 'G4' THEN CASE WHEN severity <= 1 THEN 'minor' WHEN severity <= 4 THEN 'moderate' ELSE 'severe' END
      WHEN 'G5' THEN CASE WHEN severity <= 3 THEN 'minor' WHEN severity <= 12 THEN 'moderate' ELSE 'severe' END WHEN 'G6' THEN CASE WHEN severity <= 8 THEN 'minor' WHEN severity <= 16 THEN 'moderate' ELSE 'severe' END
      ELSE 'moderate' END AS level FROM {probe}) q GROUP BY ALL""")

# --- simulation -----------------------------------------------------------------------------------------------------

_SNAP = """SELECT slide_id, pos, etype, CASE etype WHEN 'title' THEN 96 WHEN 'text' THEN 144 ELSE greatest(96, least(round_even(x / 24, 0) * 24, 1824 - w)) END AS x,
      CASE etype WHEN 'title' THEN 72 WHEN 'text' THEN 180 + 92 * (row_number() OVER (PARTITION BY slide_id, etype ORDER BY y, pos) - 1) ELSE greatest(96, least(round_even(y / 24, 0) * 24, 984 - h)) END AS y,
      CASE etype WHEN 'title' THEN 1728 WHEN 'text' THEN 1512 ELSE w END AS w, CASE WHEN etype IN ('title', 'text') THEN 72 ELSE h END AS h FROM {elements}"""
query("snap_master", "elements", simulate.snap_to_master, _SNAP)


def _absorbed(elements: DataFrame) -> DataFrame:
    """Overlaps before and after snapping, and the share that the master takes away."""
    before = layout.overlapping(elements).agg(F.count("*").alias("before"))
    after = layout.overlapping(simulate.snap_to_master(elements)).agg(F.count("*").alias("after"))
    both = before.select(F.lit(1).alias("k"), "before").join(after.select(F.lit(1).alias("k"), "after"), "k").drop("k")
    return both.withColumn("absorbed", 1 - F.col("after") / F.nullif(F.col("before"), F.lit(0)))


query("absorption", "elements", _absorbed, f"""WITH s AS ({_SNAP}), a AS (SELECT count(*) AS before FROM ({_PAIRS}) p WHERE iou >= CAST(0.05 AS DOUBLE)),
    b AS (SELECT count(*) AS after FROM ({_PAIRS.replace("{elements}", "s")}) p WHERE iou >= CAST(0.05 AS DOUBLE)) SELECT before, after, 1 - CAST(after AS DOUBLE) / nullif(before, 0) AS absorbed FROM a, b""")
_SAMPLES = "(SELECT ord, sample_id, expected AS type, severity, template, model AS level FROM {probe})"


def _samples(probe: DataFrame) -> DataFrame:
    return probe.select("ord", "sample_id", F.col("expected").alias("type"), "severity", "template", F.col("model").alias("level"))


query("split_assign", "probe", lambda p: simulate.splits(_samples(p)).groupBy("type", "split").agg(F.count("*").alias("n")), f"""SELECT type, split, count(*) AS n FROM (SELECT *, CASE WHEN type = 'G6' THEN 'ood_defect' WHEN severity = 16 THEN 'ood_severity'
    WHEN (ord + CAST(severity * 100 AS BIGINT)) % 10 < 7 THEN 'train' WHEN (ord + CAST(severity * 100 AS BIGINT)) % 10 < 9 THEN 'dev' ELSE 'test' END AS split FROM {_SAMPLES} s) q GROUP BY ALL""")
query("capped_subset", "probe", lambda p: simulate.capped(_samples(p), ["type", "template"], 20), f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY type, template ORDER BY ord) AS r FROM {_SAMPLES} s) q WHERE r <= 20")
query("stratified_sample", "probe", lambda p: simulate.stratified_sample(_samples(p), ["type"], 12, id_col="ord"), f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5('7#' || CAST(ord AS VARCHAR)), ord) AS r FROM {_SAMPLES} s) q WHERE r <= 12""")
query("twin_pairs", "probe", lambda p: simulate.twins(_samples(p)), f"""SELECT * EXCLUDE (n) FROM (SELECT *, coalesce(lead(sample_id) OVER w, first_value(sample_id) OVER w) AS partner, count(*) OVER (PARTITION BY type) AS n FROM {_SAMPLES} s WINDOW w AS (PARTITION BY type ORDER BY ord)) q WHERE n > 1""")
query("unique_ids", "probe", lambda p: simulate.unique_ids(_samples(p).select("ord", F.concat_ws("_", "type", "template").alias("base"))), f"""SELECT ord, base, CASE WHEN i = 1 THEN base ELSE base || '_' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INT), '0') END AS unique_id
    FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS i FROM (SELECT ord, concat_ws('_', type, template) AS base FROM {_SAMPLES} s) b) q""")
query("matrix_cells", "probe", lambda p: simulate.matrix(p.sparkSession, ["m1", "m2", "m3", "m4"], ["A", "B", "C", "B_prime"], ["T1", "T2", "T3"], [512, 768, 1024, 1536], [1, 2, 3]), """
    SELECT * FROM (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS model) a, (SELECT unnest(['A', 'B', 'C', 'B_prime']) AS modality) b, (SELECT unnest(['T1', 'T2', 'T3']) AS task) c, (SELECT unnest([512, 768, 1024, 1536]) AS resolution) d, (SELECT unnest([1, 2, 3]) AS seed) e""")

# --- boxes out of images, markup, model text ---------------------------------------------------------------------------


def _detections(elements: DataFrame) -> DataFrame:
    return elements.select(F.col("slide_id").alias("image"), F.col("pos").alias("ord"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), (F.col("r") / 256.0).alias("score"))


def _matched(elements: DataFrame) -> DataFrame:
    boxes = _detections(elements)
    moved = boxes.withColumn("x0", F.col("x0") + 12 * (F.col("ord") % 5)).withColumn("x1", F.col("x1") + 12 * (F.col("ord") % 5))
    return vision.recovery(moved.withColumn("side", F.lit("found")).unionByName(boxes.withColumn("side", F.lit("true"))))


query("nms", "elements", lambda e: vision.suppress(_detections(e), 0.3))
query("recovery_fidelity", "elements", _matched)
def _replies(events: DataFrame) -> DataFrame:
    """Model texts around the JSON of an event: fenced, in prose, after broken braces, nested, cut off, without any."""
    props = F.col("props")
    wrap = [F.concat(F.lit("Answer: ```json\n"), props, F.lit("\n``` done")), F.concat(F.lit("I think { is odd, but "), props, F.lit(" holds}")), F.concat(F.lit("{oops} {'a': 1} "), props), F.concat(F.lit('{"outer":'), props, F.lit(', "s":"}{"}')), F.expr("substring(props, 1, length(props) - 1)"), F.lit("no object [1, 2]")]
    kind = F.col("event_id") % 6
    return events.select("event_id", F.coalesce(*[F.when(kind == i, w) for i, w in enumerate(wrap)]).alias("raw"))


query("json_recover", "events", lambda e: _replies(e).select("event_id", recover_json(F.col("raw")).alias("object")), """SELECT event_id, CASE event_id % 6 WHEN 3 THEN '{"outer":' || replace(props, ' ', '') || ',"s":"}{"}' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE replace(props, ' ', '') END AS object FROM events""")
#: The whole html as escaped text of one annotated element, so that SQL can say what is read; tags are met by html_page_elements.
_ESCAPED = """'<div id="d" data-x="3" style="top: 7px; width:12%">' || replace(replace(html, '&', '&amp;'), '<', '&lt;') || '</div>' AS html"""
query("html_elements", "pages", lambda p: html_elements(p.selectExpr("page_id", _ESCAPED)).select("page_id", "pos", "element_id", "type", "x", "y", "width", F.sha2("text", 256).alias("text")), r"""
    SELECT page_id, 0 AS pos, 'd' AS element_id, 'div' AS type, CAST(3 AS DOUBLE) AS x, CAST(7 AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS width, sha256(regexp_replace(regexp_replace(html, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '')) AS text FROM pages WHERE html IS NOT NULL""")
#: Whole pages, null ones included; every opening tag of text is annotated (SQL cannot parse it).
_ANNOTATED = r"(?i)<(div|p|h[1-6]|li|a|td|article|section)(?=[\s>])"
query("html_page_elements", "pages", lambda p: html_elements(p.select("page_id", F.regexp_replace("html", _ANNOTATED, '<$1 data-x="3" data-element-id="e"').alias("html"))).select("page_id", "pos", "element_id", "type", "x", "text"))

# --- streams over a whole table: the batch form of what streaming/twins.py runs ------------------------------------------



def _zoned(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


query("event_windows", "events", lambda e: twins.windowed_counts(_zoned(e)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
query("event_sessions", "events", lambda e: twins.session_counts(_zoned(e)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")), """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""")

# --- corpora of decks -------------------------------------------------------------------------------------------------

_REASONS = f"""SELECT d.deck_id, coalesce(slides, 0) AS slides, CASE WHEN coalesce(slides, 0) = 0 THEN 'empty_deck' WHEN slides < 2 THEN 'too_few_slides' WHEN empty > 0 THEN 'empty_slide' WHEN findings > 3 THEN 'linter_defect' END AS reason FROM {{decks}} d LEFT JOIN (
    SELECT s.deck_id, count(*) AS slides, count(*) FILTER (WHERE u.slide_id IS NULL) AS empty, coalesce(sum(f.n), 0) AS findings FROM {{slides}} s
      LEFT JOIN (SELECT DISTINCT slide_id FROM {{elements}} WHERE regexp_matches(text, '\\S') OR w * h > 0) u ON s.slide_id = u.slide_id
      LEFT JOIN (SELECT slide_id, count(*) AS n FROM ({_ALL}) x GROUP BY slide_id) f ON s.slide_id = f.slide_id GROUP BY s.deck_id) q ON d.deck_id = q.deck_id"""
query("corpus_reject_reasons", "decks slides elements", lambda d, s, e: corpus.reject_reasons(d, s, e, max_findings=3), _REASONS)
query("corpus_summary", "decks slides elements", lambda d, s, e: corpus.corpus_summary(corpus.reject_reasons(d, s, e, max_findings=3)), f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS decks, CAST(sum(slides) AS BIGINT) AS slides FROM ({_REASONS}) r GROUP BY 1")


def _required(decks: DataFrame) -> DataFrame:
    return decks.select("deck_id", F.explode(F.array(F.lit(" 1-URGENT"), F.lit("5-LOW"), F.lit("ring"), F.lit(" "))).alias("section")).distinct()


def _quality(decks: DataFrame, slides: DataFrame, elements: DataFrame) -> DataFrame:
    return corpus.quality_parts(decks, slides, elements, _required(decks))


_QUALITY = f"""SELECT d.deck_id, p.deck_id IS NULL AS degenerate, coalesce(geometry, 0) AS geometry, coalesce(conciseness, 0) AS conciseness, coalesce(coverage, 0) AS coverage, CASE WHEN p.deck_id IS NULL THEN 0 ELSE CAST(1 AS DOUBLE) END AS terms,
      CASE WHEN p.deck_id IS NULL THEN 0 ELSE greatest(0, 1 - abs(p.n - d.target_slides) / CAST(greatest(1, d.target_slides) AS DOUBLE)) END AS count FROM {{decks}} d LEFT JOIN (
    SELECT s.deck_id, count(*) AS n, avg(coalesce(g.score, 1)) AS geometry, avg(CASE WHEN coalesce(b.n, 0) <= 6 AND coalesce(t.words, 0) <= 12 THEN 1 ELSE 0 END) AS conciseness FROM {{slides}} s
      LEFT JOIN (SELECT slide_id, count(*) AS n FROM {{elements}} WHERE etype = 'text' GROUP BY slide_id) b ON s.slide_id = b.slide_id
      LEFT JOIN (SELECT slide_id, len(string_split(arg_min(text, pos), ' ')) AS words FROM {{elements}} WHERE etype = 'title' GROUP BY slide_id) t ON s.slide_id = t.slide_id
      LEFT JOIN (SELECT s.slide_id, greatest(CAST(0 AS DOUBLE), 1 - CAST(0.15 AS DOUBLE) * coalesce(n, 0)) AS score FROM (SELECT DISTINCT slide_id FROM {{elements}}) s
        LEFT JOIN (SELECT slide_id, count(*) AS n FROM ({_ALL}) a GROUP BY slide_id) f ON s.slide_id = f.slide_id) g ON s.slide_id = g.slide_id GROUP BY s.deck_id) p ON d.deck_id = p.deck_id
    LEFT JOIN (SELECT deck_id, avg(CAST(hit AS INT)) AS coverage FROM (SELECT s.deck_id, need, bool_or(contains(lower(s.section), need) OR contains(coalesce(lower(t.title), ''), need)) AS hit
      FROM {{slides}} s LEFT JOIN (SELECT slide_id, arg_min(text, pos) AS title FROM {{elements}} WHERE etype = 'title' GROUP BY slide_id) t ON s.slide_id = t.slide_id,
        (VALUES ('1-urgent'), ('5-low'), ('ring')) v(need) GROUP BY s.deck_id, need) h GROUP BY deck_id) c ON d.deck_id = c.deck_id"""
_FOUR = ("geometry", "conciseness", "coverage", "count")
_WEIGHED = " + ".join(f"round({k}, 6) * CAST({{{i}}} AS DOUBLE)" for i, k in enumerate(("coverage", "geometry", "terms", "conciseness")))
query("deck_quality", "decks slides elements", lambda d, s, e: corpus.deck_quality(_quality(d, s, e)), f"""SELECT deck_id, degenerate, {", ".join(f"round({c}, 6) AS {c}" for c in _FOUR)}, terms,
    round({_WEIGHED.format(0.4, 0.2, 0.15, 0.25)}, 6) AS quality FROM ({_QUALITY}) q""")
query("proxy_against_gold", "decks slides elements", lambda d, s, e: corpus.proxy_against_gold(_quality(d, s, e).withColumn("grp", F.col("deck_id") % 5), s, layout.cheats(e, s)).withColumns({c: F.round(c, 6) for c in ("proxy", "gold", "gap")}), f"""
    SELECT grp, round(avg(proxy), 6) AS proxy, round(avg(gold), 6) AS gold, CAST(coalesce(sum(cheats), 0) AS BIGINT) AS cheats, round(avg(proxy) - avg(gold), 6) AS gap, avg(proxy) - avg(gold) > 0 AS over_optimised FROM (
      SELECT q.deck_id % 5 AS grp, c.cheats, round({_WEIGHED.format(0.4, 0.2, 0.15, 0.25)}, 6) AS proxy, round({_WEIGHED.format(0.45, 0.15, 0.15, 0.25)}, 6) AS gold FROM ({_QUALITY}) q
      LEFT JOIN (SELECT s.deck_id, count(*) AS cheats FROM ({_CHEATS}) x JOIN {{slides}} s ON x.slide_id = s.slide_id GROUP BY s.deck_id) c ON q.deck_id = c.deck_id) z GROUP BY grp""")


def _replayed(probe: DataFrame) -> DataFrame:
    keys = ["sample_id", "modality", "task"]
    rows = judging.classify(probe)
    answers = rows.where("model = 0").select(*keys, "ord", F.col("predicted").alias("output"))
    return corpus.replay(rows.where("model = 1").select("ord", *keys), answers, keys).select("ord", "output", "answered")


query("replay_answers", "probe", _replayed, f"""SELECT r.ord, a.output, a.k IS NOT NULL AS answered FROM (SELECT * FROM {_FACTS} f WHERE model = 1) r LEFT JOIN (SELECT sample_id, modality, task, max(ord) AS k, arg_max_null(predicted, ord) AS output FROM {_FACTS} f
    WHERE model = 0 GROUP BY 1, 2, 3) a ON r.sample_id = a.sample_id AND r.modality = a.modality AND r.task = a.task""")
_CELLS_PLAN = [(m, t, r) for m in ("A", "B", "C") for t in ("T1", "T3") for r in (512, 1024)]
query("probe_grid", "customer", lambda c: corpus.probe_grid(c.select(F.col("c_custkey").alias("sample_id")), c.sparkSession.createDataFrame(_CELLS_PLAN, "modality string, task string, resolution int")), """
    SELECT c_custkey AS sample_id, modality, task, resolution FROM customer, (VALUES ('A'), ('B'), ('C')) a(modality), (VALUES ('T1'), ('T3')) b(task), (VALUES (512), (1024)) c(resolution)""")
query("finding_validity", "elements", lambda e: e.select("slide_id", "pos", corpus.evidence_ok(F.concat(F.col("text"), F.when(F.col("pos") % 2 == 0, " overlaps by 4 px").otherwise("")), F.lit("large ring"), F.col("etype")).alias("evidence"), corpus.fix_ok(F.concat(F.when(F.col("pos") % 3 == 0, "Move ").otherwise("See "), F.col("text"))).alias("fix")), """
    SELECT slide_id, pos, (pos % 2 = 0 OR contains(lower(text), etype)) AND (pos % 2 = 0 OR len(list_filter(string_split(text, ' '), lambda w: w <> '' AND w NOT IN ('large', 'ring'))) > 0) AS evidence, pos % 3 = 0 AS fix FROM {elements}""")
query("previous_score", "rollouts", lambda r: corpus.next_in_order(r, "run", "n", "score"), "SELECT *, lag(score) OVER (PARTITION BY run ORDER BY n) AS previous FROM {rollouts}")
query("issue_counts", "elements", lambda e: corpus.issue_counts(e.select(F.col("slide_id").alias("item"), F.array_compact(F.array(F.when(F.col("x") < 32, F.concat(F.lit("margin:"), F.col("pos"))), F.when(F.col("font") < 8, F.lit("font")))).alias("issues"))), """
    SELECT CASE WHEN x < 32 OR font < 8 THEN 'failed' ELSE 'ok' END AS kind, count(*) AS n FROM {elements} GROUP BY 1 UNION ALL SELECT 'margin', count(*) FROM {elements} WHERE x < 32 HAVING count(*) > 0 UNION ALL SELECT 'font', count(*) FROM {elements} WHERE font < 8 HAVING count(*) > 0""")

# --- further queries register themselves ------------------------------------------------------------------------------

from deckframe import inject_queries, record_queries, study_queries, manifest_queries  # noqa: E402, F401, I001
