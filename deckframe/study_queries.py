"""Queries of study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.functions.stats import tail_sql
from deckframe.operators import audits, judging, layout, studies
from deckframe.operators.exams import DECK_TYPES
from deckframe.queries import _ALL, _CELLS, _EXACT, _RUNS, _div, _family, _low
from deckframe.registry import SQL, query

# --- scores by level ------------------------------------------------------------------------------------------------

_DECKS = "(" + ", ".join(f"'{t}'" for t in DECK_TYPES) + ")"
_ROWS = """(SELECT ord, model, CASE raw_modality WHEN 'Bprime' THEN 'B_prime' ELSE raw_modality END AS modality, task, sample_id, CASE WHEN sample_id % 12 >= 6 THEN 'deck' ELSE 'page' END AS level, expected, predicted FROM {probe})"""


def _rows(probe: DataFrame) -> DataFrame:
    return judging.classify(probe).withColumn("level", F.when(F.col("sample_id") % 12 >= 6, "deck").otherwise("page"))


def _rates(source: str) -> str:
    """Rates of a query with tp, n_pos, fp, n_neg."""
    recall, spec, precision = _div("tp", "n_pos"), _div("n_neg - fp", "n_neg"), _div("tp", "(tp + fp)")
    return f"""SELECT * EXCLUDE (rc, sp, pr), round(rc, 6) AS recall, round(sp, 6) AS specificity, round((rc + sp) / 2, 6) AS bal_acc, round(pr, 6) AS precision, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1, round(1 - sp, 6) AS fpr
      FROM (SELECT *, {recall} AS rc, {spec} AS sp, {precision} AS pr FROM ({source}) s0) s1"""


_LEVELS = _rates(f"""SELECT p.model, p.modality, p.type, n_pos, tp, p.level, n_neg, coalesce(fp, 0) AS fp FROM (SELECT model, modality, expected AS type, CASE WHEN expected IN {_DECKS} THEN 'deck' ELSE 'page' END AS level, count(*) AS n_pos, count(*) FILTER (WHERE predicted = expected) AS tp FROM {_ROWS} r WHERE expected IS NOT NULL GROUP BY ALL) p
    JOIN (SELECT model, modality, level, count(*) AS n_neg FROM {_ROWS} r WHERE expected IS NULL GROUP BY ALL) n ON p.model = n.model AND p.modality = n.modality AND p.level = n.level
    LEFT JOIN (SELECT model, modality, level, predicted AS type, count(*) AS fp FROM {_ROWS} r WHERE expected IS NULL AND predicted IS NOT NULL GROUP BY ALL) f ON p.model = f.model AND p.modality = f.modality AND p.level = f.level AND p.type = f.type""")
query("level_scores", "probe", lambda p: studies.level_scores(_rows(p)), _LEVELS)
_MEANS = f"SELECT model, modality, round(avg(bal_acc) FILTER (WHERE type IN ('S1', 'S2', 'S4', 'S5')), 6) AS semantic, round(avg(bal_acc) FILTER (WHERE type LIKE 'G%'), 6) AS geometry FROM ({_LEVELS}) l GROUP BY model, modality"
query("group_means", "probe", lambda p: studies.group_means(studies.level_scores(_rows(p))), _MEANS)
query("best_semantic", "probe", lambda p: studies.best_of(studies.group_means(studies.level_scores(_rows(p)))), f"SELECT model, max(semantic) AS best FROM ({_MEANS}) m GROUP BY model")
query("false_alarms", "probe", lambda p: studies.false_alarms(_rows(p)), f"SELECT *, CASE WHEN any_fp <= 5 THEN 'abstains' WHEN any_fp >= CAST(0.4 AS DOUBLE) * n_neg THEN 'over-fires' ELSE 'mild over-call' END AS bias FROM (SELECT model, modality, count(*) AS n_neg, count(predicted) AS any_fp FROM {_ROWS} r WHERE expected IS NULL GROUP BY ALL) q")
_R = ", ".join(f"coalesce(avg(CAST(coalesce(predicted = expected, FALSE) AS INT)) FILTER (WHERE modality = '{m}'), 0) AS {n}" for m, n in (("A", "ra"), ("B", "rb"), ("C", "rc"), ("B_prime", "rp")))
query("fusion_gains", "probe", lambda p: studies.fusion_gains(_rows(p)), f"""SELECT type, round(ra, 6) AS "r_A", round(rb, 6) AS "r_B", round(rc, 6) AS "r_C", round(rp, 6) AS "r_B_prime", round(rb - ra, 6) AS structure_gap, round(rb - rp, 6) AS caption_gap, round(rc - greatest(ra, rb, rp), 6) AS fusion_gain
    FROM (SELECT expected AS type, {_R} FROM {_ROWS} r WHERE task = 'T1' AND expected IS NOT NULL GROUP BY expected) q""")


def _channel(keys: str, source: str) -> str:
    a, b, c = (f"max(bal_acc) FILTER (WHERE modality = '{m}')" for m in "ABC")
    return f"""SELECT *, round(c - a, 6) AS c_minus_a, round(b - a, 6) AS b_minus_a, CASE WHEN a < CAST(0.6 AS DOUBLE) AND greatest(b, c) >= CAST(0.6 AS DOUBLE) THEN 'perception' WHEN a < CAST(0.6 AS DOUBLE) AND c < CAST(0.6 AS DOUBLE) THEN 'capability' ELSE 'image_sufficient' END AS verdict
      FROM (SELECT {keys}, {a} AS a, {b} AS b, {c} AS c FROM ({source}) s GROUP BY {keys}) q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""


query("channels", "probe", lambda p: studies.channels(studies.level_scores(_rows(p))), _channel("model, type", _LEVELS))
query("mean_channels", "probe", lambda p: studies.mean_channels(studies.level_scores(_rows(p))).withColumns({c: F.round(c, 6) for c in "abc"}), f"SELECT * REPLACE (round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c) FROM ({_channel('type', f'SELECT type, modality, avg(bal_acc) AS bal_acc FROM ({_LEVELS}) l GROUP BY type, modality')}) q")

# --- forced choice, rescues, places ---------------------------------------------------------------------------------

query("forced_choice", "trials", studies.forced_choice, """SELECT *, round(coalesce(CAST("right" AS DOUBLE) / nullif(parsed, 0), 0), 6) AS accuracy, round(CAST(robust AS DOUBLE) / pairs, 6) AS robust_accuracy, greatest(pick_a, pick_b, pick_tie, trials - parsed) > CAST(0.6 AS DOUBLE) * trials AS one_sided FROM (
    SELECT model, defect, CAST(sum(t) AS BIGINT) AS trials, CAST(sum(p) AS BIGINT) AS parsed, CAST(sum(r) AS BIGINT) AS "right", count(*) AS pairs, count(*) FILTER (WHERE t = 2 AND r = 2) AS robust, CAST(sum(a) AS BIGINT) AS pick_a, CAST(sum(b) AS BIGINT) AS pick_b, CAST(sum(c) AS BIGINT) AS pick_tie FROM (
      SELECT model, defect, pair, count(*) AS t, count(pick) AS p, count(*) FILTER (WHERE pick = expect) AS r, count(*) FILTER (WHERE pick = 'a') AS a, count(*) FILTER (WHERE pick = 'b') AS b, count(*) FILTER (WHERE pick = 'tie') AS c FROM {trials} GROUP BY ALL) q GROUP BY ALL) z""")
_OK = "SELECT model, defect, cond, sample_id, bool_and(has_defect <> is_clean) AS ok FROM {elicit} WHERE NOT failure GROUP BY ALL"
_PAIRS = f"SELECT *, round({_EXACT.replace('b + c', 'gain + loss').replace('least(b, c)', 'least(gain, loss)').replace('lgamma(i + 1)', 'lgamma(CAST(i + 1 AS DOUBLE))')}, 6) AS p FROM (SELECT y.model, y.defect, y.cond, count(*) FILTER (WHERE NOT x.ok AND y.ok) AS gain, count(*) FILTER (WHERE x.ok AND NOT y.ok) AS loss FROM ({_OK}) y JOIN ({_OK}) x ON x.cond = 'C0' AND y.cond <> 'C0' AND x.model = y.model AND x.defect = y.defect AND x.sample_id = y.sample_id GROUP BY ALL) d"
query("discordant_pairs", "elicit", lambda e: studies.discordant(e, "C0", ("C3", "NAMED")), _PAIRS)
query("rescued", "elicit", lambda e: studies.rescued(judging.confusion_cells(e), studies.discordant(e, "C0", ("C3", "NAMED")), precision=0.4), f"""
    SELECT model, defect, cond, delta, precision, gain, loss, p, saved AS rescued, NOT saved AND delta >= CAST(0.1 AS DOUBLE) AND precision >= CAST(0.4 AS DOUBLE) AS improved FROM (
      SELECT *, delta > 0 AND p < CAST(0.05 AS DOUBLE) AND precision >= CAST(0.4 AS DOUBLE) AND gain > loss AS saved FROM (SELECT x.model, x.defect, x.cond, round(x.bal_acc - b.bal_acc, 6) AS delta, x.precision, coalesce(gain, 0) AS gain, coalesce(loss, 0) AS loss, coalesce(p, 1) AS p
        FROM ({_CELLS}) x JOIN ({_CELLS}) b ON x.model = b.model AND x.defect = b.defect AND b.cond = 'C0' AND x.cond <> 'C0' LEFT JOIN ({_PAIRS}) d ON x.model = d.model AND x.defect = d.defect AND x.cond = d.cond) q) r""")
_SAID = "sample_id, model, cond, has_defect, is_clean, failure, CASE CAST(model AS INT) % 3 WHEN 0 THEN 'the BOTTOM' WHEN 1 THEN 'right edge' END AS said_region, CASE WHEN sample_id % 2 = 0 THEN 'A Card' ELSE 'some URL text' END AS said_element"
_TRUTH = "DISTINCT sample_id, CASE sample_id % 4 WHEN 0 THEN 'bottom-right' WHEN 1 THEN 'left' WHEN 2 THEN '' END AS region, CASE sample_id % 3 WHEN 0 THEN 'card_height' WHEN 1 THEN 'unbreakable_text' ELSE 'image_objectfit' END AS kind"


def _localized(elicit: DataFrame) -> DataFrame:
    return studies.localization(elicit.selectExpr(*_split(_SAID)), elicit.selectExpr(*_split(_TRUTH.removeprefix("DISTINCT "))).distinct())


def _split(columns: str) -> list[str]:
    """Columns of a select list, cut at the commas outside brackets and texts."""
    out, depth, text = [""], 0, False
    for ch in columns:
        text ^= ch == "'"
        depth += 0 if text else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not text:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


query("localization", "elicit", _localized, f"""SELECT model, cond, count(*) AS n, round(avg(CAST(len(list_filter(string_split(coalesce(region, ''), '-'), lambda w: w <> '' AND contains(r, w))) > 0 AS INT)), 6) AS region_share,
    round(avg(CAST(CASE kind {" ".join(f"WHEN '{k}' THEN " + " OR ".join(f"contains(e, '{w}')" for w in ws) for k, ws in studies.KINDS.items())} ELSE FALSE END AS INT)), 6) AS element_share
    FROM (SELECT s.model, s.cond, lower(coalesce(said_region, '')) AS r, lower(said_element) AS e, t.region, t.kind FROM (SELECT {_SAID} FROM {{elicit}}) s JOIN (SELECT {_TRUTH} FROM {{elicit}}) t ON s.sample_id = t.sample_id WHERE has_defect AND NOT is_clean AND NOT failure) q GROUP BY model, cond""")
query("founded_cells", "elicit", lambda e: studies.with_evidence(e.selectExpr(*_split(_SAID))).groupBy("model", "cond").agg(F.count_if("has_defect").alias("yes"), F.count_if("unfounded").alias("unfounded")), f"SELECT model, cond, count(*) FILTER (WHERE has_defect AND said_region IS NOT NULL) AS yes, count(*) FILTER (WHERE has_defect AND said_region IS NULL) AS unfounded FROM (SELECT {_SAID} FROM {{elicit}}) q GROUP BY model, cond")
query("both_ways", "trials", lambda t: studies.both_ways(t.select(F.col("pair").alias("sample_id"), "turn", F.col("pick").alias("worse"))), """SELECT pair AS sample_id, count(DISTINCT CASE WHEN pick = CASE turn WHEN 0 THEN 'a' ELSE 'b' END THEN turn END) = 2 AS present, count(pick) AS answers FROM {trials} GROUP BY pair""")
_CONTRAST = "defect, CASE WHEN CAST(model AS INT) % 2 = 0 THEN 'real' ELSE 'original' END AS variant, CASE cond WHEN 'NAMED' THEN 'AFC' ELSE cond END AS cond, CASE cond WHEN 'NAMED' THEN 'AFC' ELSE 'cell' END AS kind, CASE WHEN n_pos > 2 THEN bal_acc + CASE WHEN CAST(model AS INT) % 2 = 0 AND defect < 'G4' THEN 0.3 ELSE 0.0 END END AS est, CASE WHEN CAST(model AS INT) % 3 > 0 THEN ba_low + CASE WHEN CAST(model AS INT) % 2 = 0 AND defect < 'G4' THEN 0.3 ELSE 0.0 END END AS low, ba_high AS high, recall AS decisive"
_TESTED = "SELECT *, CASE WHEN est IS NULL THEN NULL WHEN kind = 'AFC' THEN coalesce(decisive, 0) >= 0.5 AND est >= CAST(0.65 AS DOUBLE) WHEN low IS NOT NULL THEN low > 0.5 ELSE est >= CAST(0.65 AS DOUBLE) END AS above, CASE WHEN est IS NULL THEN NULL WHEN kind = 'AFC' THEN coalesce(decisive, 0) < 0.5 WHEN low IS NOT NULL THEN low <= 0.5 AND high >= 0.5 ELSE abs(est - 0.5) < CAST(0.12 AS DOUBLE) END AS near"
_AT = lambda v, k, f: f"max(CAST({f} AS INT)) FILTER (WHERE variant = '{v}' AND cond = '{k}')"
query("injection_contrast", "elicit", lambda e: studies.contrast(judging.confusion_cells(e).selectExpr(*_split(_CONTRAST))), f"""SELECT defect, ra AS real_above, oc AS original_at_chance, CASE WHEN ra AND oc THEN 'artifact' WHEN NOT ra AND rn AND c3n THEN 'survives' WHEN ra AND c3a THEN 'detectable' ELSE 'mixed' END AS verdict FROM (
    SELECT defect, coalesce({_AT("real", "C3", "above")}, 0) > 0 OR coalesce({_AT("real", "AFC", "above")}, 0) > 0 AS ra, coalesce({_AT("real", "C3", "near")}, 0) > 0 AS rn, coalesce({_AT("original", "C0", "near")}, 1) > 0 AND coalesce({_AT("original", "C3", "near")}, 1) > 0 AND coalesce({_AT("original", "AFC", "near")}, 1) > 0 AS oc,
      coalesce({_AT("original", "C3", "near")}, 0) > 0 AS c3n, coalesce({_AT("original", "C3", "above")}, 0) > 0 AS c3a FROM ({_TESTED} FROM (SELECT {_CONTRAST.replace("0.3 ", "CAST(0.3 AS DOUBLE) ").replace("0.0 ", "CAST(0 AS DOUBLE) ")} FROM ({_CELLS}) c) t) u GROUP BY defect) z""")

# --- answers, truth with unknowns, linter against labels ------------------------------------------------------------

_ITEMS = "SELECT o_orderkey AS pair_id, 'G' || CAST(o_orderkey % 5 AS VARCHAR(2)) AS cls, 's' || CAST(o_custkey % 3 AS VARCHAR(2)) AS stratum FROM {orders}"
_SAYS = "[TRUE, FALSE, NULL, TRUE, FALSE, NULL]"


def _answered(orders: DataFrame) -> DataFrame:
    items = orders.selectExpr("o_orderkey AS pair_id", "'G' || CAST(o_orderkey % 5 AS VARCHAR(2)) AS cls", "'s' || CAST(o_custkey % 3 AS VARCHAR(2)) AS stratum")
    said = F.element_at(F.array(*[F.lit(x).cast("boolean") for x in (True, False, None, True, False, None)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return studies.answer_rates(items, orders.where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("pair_id"), said.alias("said")))


query("answer_rates", "orders", _answered, f"""SELECT cls, stratum, n, k, round(CAST(k AS DOUBLE) / n, 9) AS rate, round({_low("k", "n", "-")}, 9) AS low, round({_low("k", "n", "+")}, 9) AS high FROM (
    SELECT cls, stratum, count(*) AS n, count(*) FILTER (WHERE said) AS k FROM (SELECT i.*, CASE WHEN pair_id % 7 > 0 THEN {_SAYS}[pair_id % 6 + 1] END AS said FROM ({_ITEMS}) i) a WHERE said IS NOT NULL GROUP BY ROLLUP (cls, stratum)) q""")


def _truth(answers: DataFrame) -> DataFrame:
    from deckframe.record_queries import _annotated

    rows = _annotated(answers).withColumn("predicted", F.when(F.col("sample_id") % 3 == 0, F.array(F.lit("G2"))).when(F.col("sample_id") % 3 == 1, F.array(F.lit("G5"), F.lit("G2"))).otherwise(F.array().cast("array<string>")))
    return studies.three_valued(rows, ("G2", "G5", "G6"))


def _truth_sql() -> str:
    from deckframe.record_queries import _ANNOTATED

    counts = f"""SELECT type, count(*) FILTER (WHERE there) AS n_pos, count(*) FILTER (WHERE there AND hit) AS tp, count(*) FILTER (WHERE NOT there AND gone) AS n_neg, count(*) FILTER (WHERE NOT there AND gone AND hit) AS fp FROM (
      SELECT type, list_contains(labels, type) AS there, list_contains(confident_absent, type) AS gone, CASE sample_id % 3 WHEN 0 THEN type = 'G2' WHEN 1 THEN type IN ('G2', 'G5') ELSE FALSE END AS hit FROM ({_ANNOTATED}) a, (VALUES ('G2'), ('G5'), ('G6')) t(type)) q GROUP BY type"""
    return f"SELECT *, n_pos >= 5 AND n_neg >= 5 AS enough FROM ({_rates(counts)}) r"


query("three_valued", "answers", _truth, _truth_sql())
_LINTED = f"""(SELECT s.slide_id, list_contains(coalesce(t, []), 'overlap') AS hit, CASE WHEN s.slide_id % 2 = 0 THEN list_contains(coalesce(t, []), 'margin') END AS clean_hit FROM (SELECT DISTINCT slide_id FROM {{elements}}) s LEFT JOIN (SELECT slide_id, list(DISTINCT detector) AS t FROM ({_ALL}) a GROUP BY slide_id) f ON s.slide_id = f.slide_id)"""


def _linted(elements: DataFrame) -> DataFrame:
    df = layout.lint_types(elements)
    clean = F.when(F.col("slide_id") % 2 == 0, F.array_contains("types", "margin"))
    return df.select("slide_id", F.concat(F.lit("G"), (F.col("slide_id") % 3).cast("string")).alias("type"), F.concat(F.lit("s"), (F.col("slide_id") % 5).cast("string")).alias("stratum"), F.when(F.col("slide_id") % 7 < 4, "freeform").otherwise("template").alias("template"), F.array_contains("types", "overlap").alias("hit"), clean.alias("clean_hit"))


_LROWS = f"SELECT *, 'G' || slide_id % 3 AS type, 's' || slide_id % 5 AS stratum, CASE WHEN slide_id % 7 < 4 THEN 'freeform' ELSE 'template' END AS template FROM {_LINTED} l"
query("lint_types", "elements", lambda e: layout.lint_types(e, 0.2, 16.0).withColumn("types", F.array_join("types", ",")), f"""SELECT s.slide_id, array_to_string(coalesce(t, []), ',') AS types FROM (SELECT DISTINCT slide_id FROM {{elements}}) s LEFT JOIN (SELECT slide_id, list_sort(list(DISTINCT detector)) AS t FROM (
    SELECT * FROM ({_ALL}) a WHERE detector NOT IN ('overlap', 'margin') UNION ALL SELECT * FROM ({_ALL}) b WHERE detector = 'overlap' AND severity >= CAST(0.2 AS DOUBLE)
    UNION ALL SELECT slide_id, 'margin', pos, 0 FROM {{elements}} WHERE greatest(16 - x, 16 - y, x + w - 1904, y + h - 1064) > 0) c GROUP BY slide_id) f ON s.slide_id = f.slide_id""")
query("linter_cells", "elements", lambda e: studies.linter_cells(_linted(e)), _rates(f"SELECT type, stratum, count(*) AS n_pos, count(*) FILTER (WHERE hit) AS tp, count(clean_hit) AS n_neg, count(*) FILTER (WHERE clean_hit) AS fp FROM ({_LROWS}) r GROUP BY GROUPING SETS ((type), (type, stratum))"))
query("template_absorption", "elements", lambda e: studies.absorption(_linted(e)), f"SELECT type, round(free, 6) AS free, round(held, 6) AS held, round(1 - held / nullif(free, 0), 6) AS absorbed FROM (SELECT type, avg(CAST(hit AS INT)) FILTER (WHERE template = 'freeform') AS free, avg(CAST(hit AS INT)) FILTER (WHERE template = 'template') AS held FROM ({_LROWS}) r GROUP BY type) q")

# --- coverage by engine, shards, strata -------------------------------------------------------------------------------

_ROUTER = {"G1": "vlm_c3", "G2": "linter", "G3": "linter", "G4": "linter", "G5": "llm"}


def _engines(elicit: DataFrame) -> DataFrame:
    engine = F.when(F.col("cond") == "C0", "vlm_c0").when(F.col("cond") == "C3", "vlm_c3").otherwise("linter")
    cells = judging._rates(judging._cell(elicit.where("not failure and not (cond = 'C3' and defect = 'G6')").withColumn("engine", engine), ["defect", "engine"], "has_defect"))
    return cells.select(F.col("defect").alias("type"), "engine", "bal_acc", "precision")


_CHOSEN = {"linter_only": "'linter'", "vlm_only": "'vlm_c0'", "vlm_c3": "'vlm_c3'", "linter_plus_vlm_c3": "CASE WHEN route = 'linter' THEN 'linter' ELSE 'vlm_c3' END", "hybrid": "CASE WHEN route LIKE 'vlm%' AND NOT list_contains(engines, route) THEN 'vlm_c0' ELSE route END"}
query("routed_coverage", "elicit", lambda e: studies.routed_coverage(_engines(e), _ROUTER, 0.4), f"""
    WITH c AS (SELECT defect AS type, CASE cond WHEN 'C0' THEN 'vlm_c0' WHEN 'C3' THEN 'vlm_c3' ELSE 'linter' END AS engine, (coalesce(sum(tp) / nullif(sum(n_pos), 0), 0) + coalesce(sum(tn) / nullif(sum(n_neg), 0), 0)) / 2 AS bal_acc, coalesce(sum(tp) / nullif(sum(tp) + sum(n_neg) - sum(tn), 0), 0) AS precision FROM ({_CELLS}) q WHERE NOT (cond = 'C3' AND defect = 'G6') GROUP BY 1, 2),
    t AS (SELECT type, list(engine) AS engines, CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROUTER.items())} ELSE 'vlm_c0' END AS route FROM c GROUP BY type),
    p AS ({" UNION ALL ".join(f"SELECT '{k}' AS config, type, {v} AS engine FROM t" for k, v in _CHOSEN.items())}),
    j AS (SELECT p.config, p.type, c.bal_acc, c.precision FROM p LEFT JOIN c ON p.type = c.type AND p.engine = c.engine)
    SELECT config, count(bal_acc) AS types, round(avg(bal_acc), 6) AS mean_bal_acc, count(*) FILTER (WHERE bal_acc >= CAST(0.4 AS DOUBLE) AND precision >= CAST(0.4 AS DOUBLE)) AS covered,
      coalesce(string_agg(CASE WHEN bal_acc >= CAST(0.4 AS DOUBLE) AND precision >= CAST(0.4 AS DOUBLE) THEN type END, ',' ORDER BY type), '') AS covered_types FROM j GROUP BY config""")
query("later_shards", "orders", lambda o: studies.later_wins([o.where(f"o_orderkey % {k} = 0").select(F.col("o_orderkey").alias("id"), F.lit(n).alias("shard"), *([F.col("o_totalprice").alias("x")] if n == "b" else [])) for n, k in (("a", 2), ("b", 3), ("c", 5))], ["id"]), """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'c' WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS shard, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 THEN o_totalprice END AS x FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
_STRATA = "SELECT DISTINCT sample_id AS base, coalesce(CASE WHEN sample_id % 2 = 0 THEN CAST(sample_id % 4 AS VARCHAR(4)) || 'px' END, 'd' || CAST(sample_id % 3 AS VARCHAR(4))) AS stratum FROM {elicit} WHERE sample_id % 5 > 0"


def _strata(elicit: DataFrame) -> DataFrame:
    table = elicit.where("sample_id % 5 > 0").selectExpr("sample_id AS base", "coalesce(CASE WHEN sample_id % 2 = 0 THEN CAST(sample_id % 4 AS VARCHAR(4)) || 'px' END, 'd' || CAST(sample_id % 3 AS VARCHAR(4))) AS stratum").distinct()
    return studies.stratum_means(elicit, table)


query("stratum_means", "elicit", _strata, f"""SELECT defect, stratum, count(*) AS models, CAST(sum(n) AS BIGINT) AS n, round(avg(recall), 6) AS mean_recall FROM (SELECT e.model, e.defect, coalesce(s.stratum, 'none') AS stratum, count(*) AS n, avg(CAST(has_defect AS INT)) AS recall
    FROM {{elicit}} e LEFT JOIN ({_STRATA}) s ON e.sample_id = s.base WHERE NOT failure AND NOT is_clean GROUP BY ALL) q GROUP BY defect, stratum""")
query("cell_texts", "elicit", lambda e: studies.cell_text(judging.confusion_cells(e)).select("model", "cond", "defect", F.regexp_extract("cell", r"n=(\d+/\d+)", 1).alias("sizes"), F.col("cell").contains("†").alias("small")), f"""
    SELECT model, cond, defect, CASE WHEN n_pos > 0 AND n_neg > 0 THEN n_pos || '/' || n_neg ELSE '' END AS sizes, n_pos > 0 AND n_neg > 0 AND least(n_pos, n_neg) < 20 AS small FROM ({_CELLS}) c""")
query("one_proportion_z", "elicit", lambda e: studies.one_proportion_z(judging.shares(e, ["defect"], "has_defect").select("defect", "k", "n"), "k", "n").withColumns({c: F.round(c, 9) for c in ("z", "p")}), f"""SELECT defect, k, n, round(z, 9) AS z, round(least(1, 2 * ({tail_sql("z")})), 9) AS p FROM (
    SELECT *, (CAST(k AS DOUBLE) / n - 0.5) / sqrt(CAST(0.25 AS DOUBLE) / n) AS z FROM (SELECT defect, count(*) AS n, count(*) FILTER (WHERE has_defect) AS k FROM {{elicit}} GROUP BY defect) q) r""")
query("multiplicity", "elicit", lambda e: audits.benjamini_hochberg(audits.holm(_family(e))).select("ord", F.round("holm", 9).alias("holm"), F.round("bh", 9).alias("bh"), "holm_reject", "bh_reject"), f"""SELECT h.ord, h.holm, b.bh, h.holm_reject, b.bh_reject FROM ({SQL["holm"]}) h JOIN ({SQL["benjamini_hochberg"]}) b ON h.ord = b.ord""")

# --- fidelity, judges, trajectories -----------------------------------------------------------------------------------

_CHANGED = "'G' || CAST(l_orderkey % 6 + 1 AS VARCHAR(2)) AS type, l_partkey % 9 > 0 AS injected, CASE WHEN l_suppkey % 7 > 0 THEN CAST((l_partkey * 7) % 23 AS DOUBLE) / 1000 END AS free, CASE WHEN l_partkey % 4 > 0 THEN CAST((l_partkey * 5) % 11 AS DOUBLE) / 1000 END AS held"
query("fidelity", "lineitem", lambda l: studies.fidelity(l.selectExpr(*_split(_CHANGED)), 0.005), f"""SELECT type, n, round(CAST(injected AS DOUBLE) / n, 6) AS injected_rate, round({_div("rendered", "n_free")}, 6) AS rendered_rate, pairs, round({_div("absorbed", "pairs")}, 6) AS absorbed_rate, round({_div("absorbed", "rendered")}, 6) AS absorbed_of_rendered, round(median, 6) AS median, round(mean, 6) AS mean,
    round(v[CAST(floor(CAST(0.9 AS DOUBLE) * (len(v) - 1)) AS INT) + 1], 6) AS late, round(v[len(v) // 2 + 1], 6) AS upper_median FROM (SELECT type, count(*) AS n, count(*) FILTER (WHERE injected) AS injected, count(free) AS n_free, count(*) FILTER (WHERE free > CAST(0.005 AS DOUBLE)) AS rendered, count(*) FILTER (WHERE free IS NOT NULL AND held IS NOT NULL) AS pairs,
      count(*) FILTER (WHERE free > CAST(0.005 AS DOUBLE) AND held IS NOT NULL AND NOT held > CAST(0.005 AS DOUBLE)) AS absorbed, median(free) AS median, avg(free) AS mean, list_sort(list(free) FILTER (WHERE free IS NOT NULL)) AS v FROM (SELECT {_CHANGED} FROM lineitem) r GROUP BY type) q""")
_JUDGED = "'G' || CAST(l_orderkey % 7 + 1 AS VARCHAR(2)) AS defect, CASE WHEN l_partkey % 13 > 0 THEN CAST(l_partkey % 101 AS DOUBLE) END AS clean, CASE WHEN l_suppkey % 5 > 0 THEN CAST((l_partkey * 3 + l_suppkey) % 101 AS DOUBLE) END AS defective"
query("judged_pairs", "lineitem", lambda l: studies.judged_pairs(l.selectExpr(*_split(_JUDGED))), f"""SELECT defect, n, wins, ties, round(CAST(wins AS DOUBLE) / n, 6) AS preference, round({_low("wins", "n", "-")}, 9) AS low, round({_low("wins", "n", "+")}, 9) AS high, mean_gap, upper_median, mean_clean, mean_defective, failures FROM (
    SELECT defect, count(*) FILTER (WHERE gap IS NOT NULL) AS n, count(*) FILTER (WHERE gap > 0) AS wins, count(*) FILTER (WHERE gap = 0) AS ties, round(avg(gap), 6) AS mean_gap, (list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)))[count(gap) // 2 + 1] AS upper_median,
      round(avg(clean) FILTER (WHERE gap IS NOT NULL), 6) AS mean_clean, round(avg(defective) FILTER (WHERE gap IS NOT NULL), 6) AS mean_defective, count(*) FILTER (WHERE gap IS NULL) AS failures FROM (SELECT *, round(clean - defective, 6) AS gap FROM (SELECT {_JUDGED} FROM lineitem) r) q GROUP BY defect) z""")
_CARRIED = f"SELECT CAST(run % 3 AS VARCHAR) AS carrier, cond, run % 11 > 0 AS ok, reached FROM ({_RUNS}) r"
_CARRIERS = f"""SELECT carrier, cond, count(*) AS runs, count(reached) AS n_reached, round(avg(reached), 6) AS mean_reached, round(coalesce(stddev_pop(reached), 0), 6) AS sd, round(avg(coalesce(reached, budget)), 6) AS mean_censored FROM (SELECT *, coalesce(nullif(max(reached) OVER (), 0), 1) AS budget FROM ({_CARRIED}) c) q WHERE ok GROUP BY carrier, cond"""


def _carried(rollouts: DataFrame) -> DataFrame:
    runs = audits.rollouts_to_threshold(rollouts)
    return studies.carriers(runs.select((F.col("run") % 3).cast("string").alias("carrier"), "cond", (F.col("run") % 11 > 0).alias("ok"), "reached"))


query("carriers", "rollouts", _carried, _CARRIERS)
_ORDER = ("cond0", "cond1", "cond2", "cond3", "cond4")


def _transferred(rollouts: DataFrame) -> DataFrame:
    quality = rollouts.sparkSession.createDataFrame([(c, i / 4) for i, c in enumerate(_ORDER)], "cond string, q double")
    return studies.transfer(_carried(rollouts), quality, "cond4")


_CORR = lambda x, y: f"round(coalesce((count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / nullif(sqrt((count(*) * sum({x} * {x}) - sum({x}) * sum({x})) * (count(*) * sum({y} * {y}) - sum({y}) * sum({y}))), 0), 0), 3)"
query("transfer", "rollouts", _transferred, f"""WITH c AS (SELECT *, CAST(substring(cond, 5) AS DOUBLE) / 4 AS q FROM ({_CARRIERS}) x), p AS (SELECT cond, q, avg(mean_censored) AS r FROM c GROUP BY cond, q), a AS (SELECT {_CORR("q", "r")} AS corr, max(r) FILTER (WHERE cond = 'cond4') AS h, min(r) FILTER (WHERE cond <> 'cond4') AS s FROM p),
    e AS (SELECT carrier, {_CORR("q", "mean_censored")} AS k FROM c GROUP BY carrier HAVING count(*) >= 2)
    SELECT corr, corr < 0 AS monotonic, (SELECT count(*) >= 2 AND max(k) <= 0 FROM e) AS agnostic, h <= s + CAST(1e-9 AS DOUBLE) AS hybrid_no_worse, CASE WHEN corr < 0 AND coalesce(h <= s + CAST(1e-9 AS DOUBLE), TRUE) THEN 'supported' ELSE 'counterexample' END AS verdict FROM a""")
_REGIMES = f"SELECT CASE WHEN run % 2 = 0 THEN 'strong' ELSE 'weak' END AS regime, cond, CAST(substring(cond, 5) AS DOUBLE) / 4 AS q, avg(first) AS initial, avg(gain) AS gain, avg(best_gain) AS best_gain FROM ({_RUNS}) r GROUP BY ALL"


def _regimes(rollouts: DataFrame) -> DataFrame:
    runs = audits.rollouts_to_threshold(rollouts).withColumn("regime", F.when(F.col("run") % 2 == 0, "strong").otherwise("weak"))
    means = runs.groupBy("regime", "cond").agg(F.avg("first").alias("initial"), F.avg("gain").alias("gain"), F.avg("best_gain").alias("best_gain")).withColumn("q", F.substring("cond", 5, 9).cast("double") / 4)
    return studies.regime_stats(means, _ORDER)


_STATS = f"""SELECT regime, count(*) AS conditions, round(avg(initial), 6) AS mean_initial, round(1 - avg(initial), 6) AS headroom, round({_CORR("q", "gain").removesuffix(", 3)").removeprefix("round(")}, 6) AS corr_gain, round({_CORR("q", "best_gain").removesuffix(", 3)").removeprefix("round(")}, 6) AS corr_best_gain, round(max(best_gain) - min(best_gain), 6) AS spread,
    round(max(best_gain), 6) AS max_best_gain, arg_max(cond, q) AS best, round(arg_max(best_gain, q), 6) AS best_cond_gain FROM ({_REGIMES}) r GROUP BY regime"""
query("regime_stats", "rollouts", _regimes, _STATS)
query("compare_regimes", "rollouts", lambda r: studies.compare_regimes(_regimes(r), "strong", "weak"), f"""SELECT round(w.headroom / nullif(s.headroom, 0), 3) AS headroom_ratio, round(w.spread / nullif(s.spread, 0), 3) AS spread_ratio, CASE WHEN w.best_cond_gain >= CAST(0.03 AS DOUBLE) OR w.max_best_gain >= CAST(0.03 AS DOUBLE) THEN 'bounded_positive' ELSE 'stronger_negative' END AS verdict
    FROM (SELECT * FROM ({_STATS}) a WHERE regime = 'weak') w, (SELECT * FROM ({_STATS}) b WHERE regime = 'strong') s""")

# --- feedback, decks, plans -------------------------------------------------------------------------------------------

query("structural_judge", "slides elements", studies.structural_judge, """SELECT deck_id, round(greatest(CAST(0 AS DOUBLE), 1 - sum(CASE WHEN coalesce(t, 0) = 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN b > 6 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN l > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)), 6) AS score FROM {slides} s
    LEFT JOIN (SELECT slide_id, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS t, count(*) FILTER (WHERE etype = 'text') AS b, count(*) FILTER (WHERE etype = 'text' AND length(text) > 120) AS l FROM {elements} GROUP BY slide_id) e ON s.slide_id = e.slide_id GROUP BY deck_id""")
query("placeholders", "slides elements", lambda s, e: studies.placeholders(s, e, ("large", "ring", "点击")), """SELECT deck_id, CAST(coalesce(sum(m), 0) AS BIGINT) AS placeholders, count(m) AS slides_with, count(*) AS slides FROM {slides} s LEFT JOIN (SELECT slide_id, count(*) AS m FROM {elements} WHERE contains(lower(text), 'large') OR contains(lower(text), 'ring') GROUP BY slide_id) e ON s.slide_id = e.slide_id GROUP BY deck_id""")


def _fed_back(slides: DataFrame, elements: DataFrame) -> DataFrame:
    terms = slides.where("deck_id % 3 = 0 and slide_index < 7").select("deck_id")
    return studies.linter_feedback(slides, layout.lint_scores(elements), layout.lint(elements), terms)


query("linter_feedback", "slides elements", lambda s, e: _fed_back(s, e).select("deck_id", "score", "findings", F.size(F.split("reflection", "\n")).alias("lines")), f"""WITH l AS (SELECT * FROM ({_ALL}) a)
    SELECT s.deck_id, round(greatest(0, least(1, avg(coalesce(g.score, 1)) - max(CASE WHEN s.deck_id % 3 = 0 THEN least(0.5, CAST(0.1 AS DOUBLE) * coalesce(t.t, 0)) ELSE 0 END))), 6) AS score, coalesce(max(f.n), 0) AS findings, CAST(1 + coalesce(least(20, max(f.n)), 0) AS INT) AS lines FROM {{slides}} s
      LEFT JOIN (SELECT x.slide_id, greatest(CAST(0 AS DOUBLE), 1 - CAST(0.15 AS DOUBLE) * coalesce(n, 0)) AS score FROM (SELECT DISTINCT slide_id FROM {{elements}}) x LEFT JOIN (SELECT slide_id, count(*) AS n FROM l GROUP BY slide_id) y ON x.slide_id = y.slide_id) g ON s.slide_id = g.slide_id
      LEFT JOIN (SELECT deck_id, count(*) AS n FROM l JOIN {{slides}} z ON l.slide_id = z.slide_id GROUP BY deck_id) f ON s.deck_id = f.deck_id LEFT JOIN (SELECT deck_id, count(*) AS t FROM {{slides}} WHERE slide_index < 7 GROUP BY deck_id) t ON s.deck_id = t.deck_id GROUP BY s.deck_id""")


def _examined(slides: DataFrame) -> DataFrame:
    answers = slides.select("deck_id", F.col("slide_index").alias("slide"), ((F.col("slide_id") % 10) / 10).alias("score"), F.when(F.col("slide_id") % 3 == 0, "G1").when(F.col("slide_id") % 3 == 1, "S1").alias("type"), F.when(F.col("slide_id") % 2 == 0, F.lit("e1")).alias("element"), F.lit(" seen ").alias("evidence"), F.when(F.col("slide_id") % 4 == 0, "do it").otherwise("").alias("fix"))
    return studies.examiner_feedback(answers)


query("examiner_feedback", "slides", _examined, """SELECT deck_id, round(avg(CAST(slide_id % 10 AS DOUBLE) / 10), 6) AS score, coalesce('Examiner critique:' || chr(10) || array_to_string((list('- ' || CASE slide_id % 3 WHEN 0 THEN 'G1' ELSE 'S1' END || ' @ ' || CASE WHEN slide_id % 2 = 0 THEN 'e1' ELSE 'unknown element' END || ': seen -> ' || CASE WHEN slide_id % 4 = 0 THEN 'do it' ELSE 'revise the affected region' END ORDER BY slide_index)
    FILTER (WHERE slide_id % 3 < 2))[1:12], chr(10)), 'Examiner: no visual or semantic defects detected; deck reads clean.') AS reflection FROM {slides} GROUP BY deck_id""")
query("hybrid_feedback", "slides elements", lambda s, e: studies.hybrid_feedback(_fed_back(s, e), _examined(s)).select("deck_id", "score", F.col("reflection").contains("\n\nExaminer").alias("both")), f"SELECT deck_id, score, TRUE AS both FROM ({SQL['linter_feedback']}) q")


def _critique(elements: DataFrame, slides: DataFrame) -> DataFrame:
    answers = slides.select("slide_id", F.lit("S1").alias("type"), F.lit("vlm").alias("engine"), (F.col("slide_id") % 2 == 0).alias("present"))
    return studies.hybrid_critique(layout.lint_types(elements), answers, {"overlap": "linter", "margin": "linter", "S1": "vlm", "S2": "llm"})


query("hybrid_critique", "elements slides", _critique, f"""SELECT s.slide_id, v.type, v.engine, CASE v.engine WHEN 'linter' THEN list_contains(coalesce(t, []), v.type) WHEN 'vlm' THEN s.slide_id % 2 = 0 ELSE FALSE END AS present FROM (SELECT DISTINCT slide_id FROM {{elements}}) s
    LEFT JOIN (SELECT slide_id, list(DISTINCT detector) AS t FROM ({_ALL}) a GROUP BY slide_id) f ON s.slide_id = f.slide_id, (VALUES ('overlap', 'linter'), ('margin', 'linter'), ('S1', 'vlm'), ('S2', 'llm')) v(type, engine)""")
query("mock_examiner", "probe", lambda p: studies.echoed(p.select("ord", F.col("raw_modality").alias("modality"), "expected"), ("A",)).select("ord", "predicted", "score"), "SELECT ord, CASE WHEN raw_modality <> 'A' THEN expected END AS predicted, CASE WHEN raw_modality = 'A' OR expected IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END AS score FROM {probe}")
query("exam_jobs", "probe", lambda p: studies.jobs(p.where("expected is not null").select("ord", F.col("expected").alias("type")), ("A", "C"), 15), """SELECT ord, type, is_clean, modality FROM (SELECT ord, expected AS type, row_number() OVER (PARTITION BY expected ORDER BY ord) AS i FROM {probe} WHERE expected IS NOT NULL) q, (VALUES (FALSE), (TRUE)) c(is_clean), (VALUES ('A'), ('C')) m(modality) WHERE i <= 15""")
query("render_jobs", "orders", lambda o: studies.render_jobs(o.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 3 > 0, F.lit("c")).alias("clean_path"), (F.col("o_custkey") % 4).alias("pages")), "out"), """SELECT sample_id, role, 'out/' || sample_id || '/' || replace(role, ':', '_') || '.png' AS path FROM (
    SELECT o_orderkey AS sample_id, unnest(list_concat(list_concat(['defective'], CASE WHEN o_orderkey % 3 > 0 THEN ['clean'] ELSE [] END), list_transform(range(0, o_custkey % 4), lambda i: 'page:' || CAST(i AS VARCHAR)))) AS role FROM orders) q""")
_CONTENT = """'{"deck_id": "d' || CAST(o_orderkey AS STRING) || '", "slides": [{"title": "' || o_orderpriority || '", "section": "s", "bullets": ["a"' || CASE WHEN o_custkey % 2 = 0 THEN ', "b"' ELSE '' END || '], "figures": [{"claim": " up "}, {"claim": " "}, {"kind": "x", "claim": "down"}]}, {"bullets": []}]}'"""
query("laid_out_decks", "orders", lambda o: studies.laid_out(o.selectExpr(f"{_CONTENT} AS content")), """WITH d AS (SELECT 'd' || o_orderkey AS deck_id, o_orderpriority AS t, 1 + CAST(o_custkey % 2 = 0 AS INT) AS n FROM orders)
    SELECT deck_id, 1 AS page, 's' AS section, 'title' AS etype, 's1_title' AS element_id, t AS text, CAST(96 AS DOUBLE) AS x, CAST(72 AS DOUBLE) AS y, CAST(1728 AS DOUBLE) AS w, CAST(72 AS DOUBLE) AS h FROM d UNION ALL SELECT deck_id, 2, NULL, 'title', 's2_title', 'Slide 2', 96, 72, 1728, 72 FROM d
    UNION ALL SELECT deck_id, 1, 's', 'text', 's1_body' || i, ['a', 'b'][i + 1], 144, 180 + 92 * i, 1512, 72 FROM d, range(2) r(i) WHERE i < n UNION ALL SELECT deck_id, 1, 's', 'figure', 's1_fig' || i, CASE i WHEN 0 THEN 'up' ELSE 'down' END, 144, 180 + 92 * n + 24 + 96 * i, 1512, 80 FROM d, (VALUES (0), (2)) r(i)""")
query("task_plan", "nation", lambda n: studies.task_plan(n.select(F.col("n_name").alias("topic"), F.concat(F.lit("a"), F.col("n_regionkey").cast("string")).alias("audience")), ("client_intro", "launch", "full_proposal"), 7), """
    SELECT 'p3_' || lpad(CAST(i AS VARCHAR), 2, '0') || '_' || s AS task_id, s AS scenario, audience, topic, 'Create a ' || replace(s, '_', ' ') || ' deck for ' || audience || ' about ' || topic || '.' AS brief, CAST(t AS INT) AS target_slides, CAST(greatest(5, t - 3) AS INT) AS min_slides FROM (
      SELECT *, ['client_intro', 'launch', 'full_proposal'][i % 3 + 1] AS s, CASE WHEN i % 2 = 0 THEN 8 ELSE 12 END AS t FROM (SELECT n_name AS topic, 'a' || n_regionkey AS audience, row_number() OVER (ORDER BY md5('7#' || n_name || '#' || 'a' || n_regionkey), n_name) - 1 AS i FROM nation) q) z""")
query("row_sets", "lineitem", lambda l: studies.row_sets(l.where("l_linenumber < 4").select("l_partkey", "l_returnflag"), l.where("l_linenumber > 1").select("l_partkey", "l_returnflag")), """WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber < 4), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber > 1)
    SELECT 'union' AS set, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) u UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) e
    UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) j UNION ALL SELECT 'except_all', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x""")
