"""Queries of injected defects, of repair and of synthetic manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckframe.operators import inject, layout
from deckframe.queries import _ALL, _IOU, _PAIRS, FINDINGS, _distance, _labs, lab_of
from deckframe.registry import query

_join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _told(df, *columns):
    """The changes of an injector, targets as text, numbers rounded."""
    return df.withColumn("targets", _join("targets")).withColumn("severity", F.round("severity", 6)).select("slide_id", "pos", *columns, "severity", "targets")


_TEXT = "(length(text) > 0 OR etype IN ('text', 'textbox', 'placeholder'))"


def _first(where: str = "TRUE", source: str = "{bullets}") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY pos) AS i FROM {source} WHERE {where}) f1 WHERE i = 1)"


def _role(role: str, text: bool = True) -> str:
    rest = _TEXT if text else "TRUE"
    return f"(SELECT coalesce(o.slide_id, r.slide_id) AS slide_id, CASE WHEN o.pos IS NOT NULL THEN o.pos ELSE r.pos END AS pos, CASE WHEN o.pos IS NOT NULL THEN o.text ELSE r.text END AS text FROM {_first(rest)} r FULL JOIN {_first(f'etype = {role!r}')} o ON r.slide_id = o.slide_id)"


_A = "font * CAST(0.55 AS DOUBLE)"
_FILLER = f"repeat('X', CAST(greatest(1, floor(32 / greatest(1, {_A})) + 2) AS INT))"
_G1 = f"""SELECT slide_id, pos, t AS text, least(w, greatest({_A}, length(text) * {_A})) AS w, length(t) * {_A} AS measured_w, CAST(32 AS DOUBLE) AS severity, CAST(pos AS VARCHAR) AS targets FROM (
    SELECT *, CASE WHEN substring(md5('7#' || CAST(slide_id AS VARCHAR)), 1, 1) < '8' THEN text || ' ' || {_FILLER} ELSE {_FILLER} || ' ' || text END AS t FROM {_first(_TEXT)} e) q"""
query("inject_text_overflow", "bullets", lambda e: _told(inject.text_overflow(e), "text", "w", "measured_w"), _G1)
_G2 = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY pos) AS i FROM {{bullets}}),
    a AS (SELECT p.slide_id, p.pos, q.pos AS other, q.x + q.w - least(p.w, q.w) * CAST(0.2 AS DOUBLE) AS x, q.y, p.w, p.h FROM f p JOIN f q ON p.slide_id = q.slide_id AND p.i = 1 AND q.i = 2)
    SELECT a.slide_id, a.pos, a.x, a.y, round({_IOU}, 6) AS severity, a.pos || ',' || a.other AS targets FROM a JOIN f b ON a.slide_id = b.slide_id AND a.other = b.pos"""
query("inject_overlap", "bullets", lambda e: _told(inject.overlap(e), "x", "y"), _G2)
_COLUMN = """(SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.slide_id ORDER BY c.y, c.pos) - 1 AS i, b.n FROM
      (SELECT *, round_even(x, 0) AS col FROM {bullets} WHERE etype IN ('text', 'body', 'textbox', 'placeholder') AND length(text) > 0) c
      JOIN (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY n DESC, first) AS r FROM (SELECT slide_id, etype, round_even(x, 0) AS col, count(*) AS n, min(pos) AS first FROM {bullets}
        WHERE etype IN ('text', 'body', 'textbox', 'placeholder') AND length(text) > 0 GROUP BY ALL HAVING count(*) >= 3) s) b ON b.r = 1 AND c.slide_id = b.slide_id AND c.etype = b.etype AND c.col = b.col) m WHERE i = n // 2)"""
_NONE = f"(SELECT f.* FROM {_first()} f WHERE f.slide_id NOT IN (SELECT slide_id FROM {_COLUMN} c))"
query("inject_offset", "bullets", lambda e: _told(inject.alignment_offset(e), "x", "expected_x", "mode"), f"""
    SELECT slide_id, pos, x + 16 AS x, CAST(NULL AS DOUBLE) AS expected_x, 'internal' AS mode, CAST(16 AS DOUBLE) AS severity, CAST(pos AS VARCHAR) AS targets FROM {_COLUMN} c
    UNION ALL SELECT slide_id, pos, x + 16, coalesce(expected_x, x), 'absolute', 16, CAST(pos AS VARCHAR) FROM {_NONE} r""")
query("inject_margin", "bullets", inject.page_offset, "SELECT slide_id, pos, x - min(x) OVER (PARTITION BY slide_id) + 16 AS x, min(x) OVER (PARTITION BY slide_id) - 16 AS severity FROM {bullets}")
query("inject_bleed", "bullets", lambda e: _told(inject.margin_bleed(e, side="right"), "x", "y"), f"SELECT slide_id, pos, 1920 - 32 + 16 - w AS x, y, CAST(16 AS DOUBLE) AS severity, CAST(pos AS VARCHAR) AS targets FROM {_first()} e")
query("inject_font", "bullets", lambda e: _told(inject.font_delta(e), "font", "expected_font"), f"SELECT slide_id, pos, font + 4 AS font, font AS expected_font, CAST(4 AS DOUBLE) AS severity, CAST(pos AS VARCHAR) AS targets FROM {_first(_TEXT)} e")
_HUES = "[" + ", ".join(str(list(h)) for h in inject.HUES) + "]"
_WALK = ", ".join(f"CAST(round_even({c}0 + ({_HUES}[hue + 1][{i}] - {c}0) * (step / CAST(200 AS DOUBLE)), 0) AS INT) AS {c}" for i, c in enumerate("rgb", 1))
_RAY = ", ".join(f"greatest(0, least(255, {c}0 + CASE WHEN {c}0 >= 128 THEN -1 ELSE 1 END * step)) AS {c}" for c in "rgb")


def _near(candidates: str, keys: str) -> str:
    """The candidate whose distance is nearest to 24, the first of equal ones."""
    return f"""SELECT {keys}, arg_min({{'r': r, 'g': g, 'b': b, 'd': d}}, [abs(d - 24), CAST(step AS DOUBLE)]) AS c FROM (SELECT *, {_distance("base", "own")} AS d FROM ({_labs(candidates, base="r0 g0 b0", own="r g b")}) l) k GROUP BY {keys}"""


_ONE = f"(SELECT slide_id, pos, r AS r0, g AS g0, b AS b0, CAST(list_sum(list_transform(string_split('e' || CAST(pos AS VARCHAR), ''), lambda x: ascii(x))) % 5 AS INT) AS hue FROM {_COLUMN} c)"
_STEPS = f"SELECT *, {_RAY} FROM (SELECT DISTINCT r AS r0, g AS g0, b AS b0 FROM {_NONE} n) x, (SELECT unnest(range(0, 443)) AS step) s"
_STOPPED = f"""SELECT a.r0, a.g0, a.b0, a.step, a.r, a.g, a.b FROM ({_STEPS}) a LEFT JOIN (SELECT r0, g0, b0, min(step) AS stop FROM (SELECT *, {_distance("base", "own")} AS d FROM ({_labs(_STEPS, base="r0 g0 b0", own="r g b")}) l) k WHERE d >= 24 AND step > 0 GROUP BY ALL) z
    ON a.r0 = z.r0 AND a.g0 = z.g0 AND a.b0 = z.b0 WHERE a.step <= coalesce(stop, 442)"""
_FIELDS = "c.r AS r, c.g AS g, c.b AS b, mode, round(c.d, 6) AS severity, CAST(pos AS VARCHAR) AS targets"
query("inject_colour", "bullets", lambda e: _told(inject.brand_colour(e), "r", "g", "b", "mode"), f"""
    SELECT slide_id, pos, {_FIELDS} FROM (SELECT o.slide_id, o.pos, 'internal' AS mode, h.c FROM {_ONE} o JOIN ({_near(f"SELECT *, {_WALK} FROM (SELECT DISTINCT r0, g0, b0, hue FROM {_ONE} o) x, (SELECT unnest(range(0, 201)) AS step) s", "r0, g0, b0, hue")}) h
      ON o.r0 = h.r0 AND o.g0 = h.g0 AND o.b0 = h.b0 AND o.hue = h.hue) i
    UNION ALL SELECT slide_id, pos, {_FIELDS} FROM (SELECT n.slide_id, n.pos, 'absolute' AS mode, h.c FROM {_NONE} n JOIN ({_near(_STOPPED, "r0, g0, b0")}) h ON n.r = h.r0 AND n.g = h.g0 AND n.b = h.b0) j""")
query("inject_title_mismatch", "bullets", lambda e: _told(inject.title_mismatch(e), "text"), f"""SELECT t.slide_id, t.pos, 'Unrelated: ' || substring(coalesce(nullif(b.text, ''), 'Unrelated implementation details'), 1, 80) AS text, CAST(1 AS DOUBLE) AS severity, t.pos || ',' || b.pos AS targets
    FROM {_role("title")} t JOIN {_role("text")} b ON t.slide_id = b.slide_id""")
query("inject_density", "bullets", lambda e: _told(inject.density(e), "text", "max_words"), f"""SELECT slide_id, pos, array_to_string(list_concat(ws, list_transform(range(0, greatest(0, 90 - len(ws))), lambda i: 'detail' || CAST(i AS VARCHAR))), ' ') AS text, 50 AS max_words, CAST(90 AS DOUBLE) AS severity, CAST(pos AS VARCHAR) AS targets
    FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM {_first(_TEXT)} e) q""")
query("inject_contradiction", "bullets", lambda e: _told(inject.contradiction(e), "text"), f"""SELECT t.slide_id, t.pos, 'This slide describes a contradictory single-layer architecture, not three-layer architecture.' AS text, CAST(1 AS DOUBLE) AS severity, d.pos || ',' || t.pos AS targets
    FROM {_role("text")} t JOIN {_role("image", text=False)} d ON t.slide_id = d.slide_id""")
query("inject_order_break", "slides", inject.order_break, """SELECT deck_id, slide_id, CASE slide_index WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE slide_index END AS slide_index FROM (SELECT *, count(*) OVER (PARTITION BY deck_id) AS n FROM {slides}) q WHERE n > 1""")
_LAST = "(SELECT e.* FROM {bullets} e JOIN (SELECT deck_id, arg_max(slide_id, slide_index) AS slide_id FROM {slides} GROUP BY deck_id) s ON e.slide_id = s.slide_id)"
query("inject_term", "slides bullets", lambda s, e: inject.term_variant(s, e, "ring", "ringX"), f"""SELECT slide_id, pos, replace(text, 'ring', 'ringX') AS text, 'replaced' AS mode FROM {_LAST} l WHERE contains(text, 'ring')
    UNION ALL SELECT slide_id, pos, text || ' ringX', 'appended' FROM {_first(_TEXT, _LAST + " l")} f WHERE slide_id NOT IN (SELECT slide_id FROM {_LAST} l WHERE contains(text, 'ring'))""")
query("inject_missing_section", "slides", lambda s: inject.missing_section(s, "1-URGENT"), "SELECT deck_id, arg_min(slide_id, slide_index) AS slide_id FROM {slides} WHERE section = '1-URGENT' GROUP BY deck_id")


def _by_type(elements):
    labels = inject.slide_labels(elements)
    return labels.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("slide_id").alias("slides"), F.round(F.avg("severity"), 4).alias("mean_severity"), F.sum(F.size("targets")).alias("targets"))


query("inject_labels", "bullets", _by_type, f"""
    WITH first AS (SELECT * FROM {_first(_TEXT)} q), middle AS (SELECT * FROM {_COLUMN} c), any_first AS (SELECT * FROM {_first()} f),
    l AS (SELECT 'G1' AS type, slide_id, CAST(32 AS DOUBLE) AS severity, 1 AS n FROM first UNION ALL SELECT 'G4', slide_id, 4, 1 FROM first UNION ALL SELECT 'S4', slide_id, 90, 1 FROM first UNION ALL SELECT 'G3', slide_id, 16, 1 FROM any_first
      UNION ALL SELECT 'G6', slide_id, min(x) - 16, count(*) FROM {{bullets}} GROUP BY slide_id UNION ALL SELECT 'S1', t.slide_id, 1, 2 FROM {_role("title")} t JOIN {_role("text")} b ON t.slide_id = b.slide_id
      UNION ALL SELECT 'S6', t.slide_id, 1, 2 FROM {_role("text")} t JOIN {_role("image", text=False)} d ON t.slide_id = d.slide_id
      UNION ALL SELECT 'G2', slide_id, severity, 2 FROM ({_G2}) g UNION ALL
      SELECT 'G5', slide_id, (c.d), 1 FROM (SELECT o.slide_id, h.c FROM {_ONE} o JOIN ({_near(f"SELECT *, {_WALK} FROM (SELECT DISTINCT r0, g0, b0, hue FROM {_ONE} o) x, (SELECT unnest(range(0, 201)) AS step) s", "r0, g0, b0, hue")}) h ON o.r0 = h.r0 AND o.g0 = h.g0 AND o.b0 = h.b0 AND o.hue = h.hue
        UNION ALL SELECT n.slide_id, h.c FROM {_NONE} n JOIN ({_near(_STOPPED, "r0, g0, b0")}) h ON n.r = h.r0 AND n.g = h.g0 AND n.b = h.b0) i)
    SELECT type, count(*) AS n, count(DISTINCT slide_id) AS slides, round(avg(severity), 4) AS mean_severity, CAST(sum(n) AS BIGINT) AS targets FROM l GROUP BY type""")

# --- repair ---------------------------------------------------------------------------------------------------------

_BRANDS = "[" + ", ".join("{" + ", ".join(f"'{c}': {v}" for c, v in zip(("r", "g", "b"), p, strict=True)) + "}" for p in layout.PALETTE) + "]"
_OFFS = "[" + ", ".join(_distance("own", lab_of(p)) for p in layout.PALETTE) + "]"
_APART = """SELECT slide_id, pos, list_reduce(others, lambda acc, o: {'ox': least(greatest(CAST(16 AS DOUBLE), o.ox + o.ow + 16), greatest(CAST(16 AS DOUBLE), 1904 - w)),
      'oy': CASE WHEN least(least(greatest(16, o.ox + o.ow + 16), greatest(16, 1904 - w)) + w, o.ox + o.ow) > greatest(least(greatest(16, o.ox + o.ow + 16), greatest(16, 1904 - w)), o.ox) AND least(acc.oy + h, o.oy + o.oh) > greatest(acc.oy, o.oy)
        THEN least(greatest(CAST(16 AS DOUBLE), o.oy + o.oh + 16), greatest(CAST(16 AS DOUBLE), 1064 - h)) ELSE acc.oy END, 'ow': CAST(0 AS DOUBLE), 'oh': CAST(0 AS DOUBLE)}, {'ox': x, 'oy': y, 'ow': CAST(0 AS DOUBLE), 'oh': CAST(0 AS DOUBLE)}) AS spot FROM (
      SELECT a.slide_id, a.pos, a.x, a.y, a.w, a.h, list({'ox': b.x, 'oy': b.y, 'ow': b.w, 'oh': b.h} ORDER BY b.pos) AS others FROM {elements} a JOIN (%s) p ON a.slide_id = p.slide_id AND a.pos = p.pos
        JOIN {elements} b ON p.slide_id = b.slide_id AND p.other = b.pos WHERE p.iou >= CAST(0.05 AS DOUBLE) GROUP BY ALL) q""" % _PAIRS
_CAPACITY = "coalesce(CASE WHEN capacity IS NOT NULL THEN greatest(0, capacity) END, greatest(1, floor(w / greatest(1, font * CAST(0.55 AS DOUBLE)))) * greatest(1, floor(h / greatest(1, font * CAST(1.25 AS DOUBLE)))))"
_EDGE = lambda v, size, limit: f"CASE WHEN list_contains(flags, 'margin') THEN least(greatest({v}, 32), {limit} - {size}) ELSE {v} END"
_PLACE = lambda n, new: f"CASE WHEN list_contains(flags, 'alignment') THEN coalesce(expected_{n}, {new}, {n}) ELSE coalesce({new}, {n}) END"


def _tint(c: str) -> str:
    first = f"CASE WHEN list_contains(flags, 'palette') THEN coalesce(e{c}, brand.{c}, {c}) ELSE {c} END"
    return f"CASE WHEN list_contains(flags, 'color_group') THEN coalesce(CASE WHEN list_contains(flags, 'palette') THEN NULL ELSE e{c} END, m{c}, {first}) ELSE {first} END"


_MOST = """(SELECT e.slide_id, e.pos, m.r AS mr, m.g AS mg, m.b AS mb FROM {elements} e JOIN (SELECT *, row_number() OVER (PARTITION BY slide_id, color_group ORDER BY c DESC, p) AS place FROM (
      SELECT slide_id, color_group, r, g, b, count(*) AS c, min(pos) AS p FROM {elements} WHERE color_group IS NOT NULL GROUP BY ALL) x) m ON e.slide_id = m.slide_id AND e.color_group = m.color_group WHERE m.place = 1)"""
_JOINED = f"""(SELECT e.*, coalesce(f.flags, CAST([] AS VARCHAR[])) AS flags, a.spot.ox AS nx, a.spot.oy AS ny, m.mr, m.mg, m.mb, {_BRANDS}[list_position(offs, list_min(offs))] AS brand FROM
      (SELECT *, {_OFFS} AS offs FROM ({_labs("SELECT * FROM {elements}", own="r g b")}) l) e
      LEFT JOIN (SELECT slide_id, pos, list(DISTINCT detector) AS flags FROM ({_ALL}) u GROUP BY slide_id, pos) f ON e.slide_id = f.slide_id AND e.pos = f.pos
      LEFT JOIN ({_APART}) a ON e.slide_id = a.slide_id AND e.pos = a.pos LEFT JOIN {_MOST} m ON e.slide_id = m.slide_id AND e.pos = m.pos) j"""
_CLEARED = "list_contains(flags, 'palette') OR list_contains(flags, 'color_group')"
_REPAIRED = f"""SELECT slide_id, deck_id, pos, etype, CASE WHEN list_contains(flags, 'overflow') THEN substring(text, 1, CAST({_CAPACITY} AS INT)) ELSE text END AS text,
      {_EDGE(_PLACE("x", "nx"), "w", 1888)} AS x, {_EDGE(_PLACE("y", "ny"), "h", 1048)} AS y, w, h, CASE WHEN list_contains(flags, 'font') THEN coalesce(expected_font, font) ELSE font END AS font, z, expected_x, expected_y,
      CASE WHEN list_contains(flags, 'font') THEN NULL ELSE expected_font END AS expected_font, align_group, font_group, color_group, {", ".join(f"CAST({_tint(c)} AS BIGINT) AS {c}" for c in "rgb")},
      {", ".join(f"CASE WHEN {_CLEARED} THEN NULL ELSE e{c} END AS e{c}" for c in "rgb")}, capacity, CASE WHEN list_contains(flags, 'overflow') THEN NULL ELSE measured_w END AS measured_w,
      CASE WHEN list_contains(flags, 'overflow') THEN NULL ELSE measured_h END AS measured_h, hidden, opacity, fill FROM {_JOINED}"""
_SHOWN = ("slide_id", "pos", "text", "x", "y", "font", "r", "g", "b")
query("repaired_elements", "elements", lambda e: inject.repaired(e).select(*_SHOWN), f"SELECT {', '.join(_SHOWN)} FROM ({_REPAIRED}) q")


def _found(source: str) -> str:
    """Types that all detectors find in ``source``, by slide."""
    every = " UNION ALL ".join(f"SELECT * FROM ({x.replace('{elements}', source)}) {n}_q" for n, x in FINDINGS.items())
    return f"SELECT slide_id, list_sort(list(DISTINCT CASE WHEN detector IN ('palette', 'color_group') THEN 'color' ELSE detector END)) AS types FROM ({every}) u GROUP BY slide_id"


query("repair_pass", "elements", lambda e: inject.repair_passes(e).select("slide_id", F.array_join("found", ",").alias("found"), F.array_join("left", ",").alias("left"), "passes"), f"""
    WITH fixed AS MATERIALIZED ({_REPAIRED}) SELECT s.slide_id, array_to_string(coalesce(a.types, []), ',') AS found, array_to_string(coalesce(b.types, []), ',') AS left, NOT list_has_any(coalesce(a.types, []), coalesce(b.types, [])) AS passes
    FROM (SELECT DISTINCT slide_id FROM {{elements}}) s LEFT JOIN ({_found("{elements}")}) a ON s.slide_id = a.slide_id LEFT JOIN ({_found("fixed")}) b ON s.slide_id = b.slide_id""")
_HELD = ("S4",)
query("synthetic_manifest", "slides bullets", lambda s, e: inject.synthetic_manifest(s, e, 3, 0.5, _HELD, (64.0,)))
query("synthetic_splits", "slides bullets", lambda s, e: inject.synthetic_manifest(s, e, 3, 0.5, _HELD, (64.0,)).groupBy("type", "split").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids")), f"""
    WITH g AS (SELECT * FROM (VALUES {", ".join(f"({o}, '{k}', CAST({v} AS DOUBLE))" for o, (k, vs) in enumerate(inject.GRID.items()) for v in vs)}) v(o, type, severity)),
    p AS (SELECT type, CASE WHEN type = 'S4' THEN 'ood_defect' WHEN severity = 64 THEN 'ood_severity' WHEN (o + CAST(floor(severity * 100) AS INT)) % 10 < 7 THEN 'train' WHEN (o + CAST(floor(severity * 100) AS INT)) % 10 < 9 THEN 'val' ELSE 'test' END AS split,
      s.slide_id FROM g, range(3) r(i) JOIN (SELECT slide_id, row_number() OVER (ORDER BY slide_id) - 1 AS base, count(*) OVER () AS n FROM {{slides}}) s ON s.base = (r.i + CAST(floor(severity * 10) AS INT)) % s.n),
    k AS (SELECT p.* FROM p JOIN (SELECT slide_id, count(*) AS n, count(*) FILTER (WHERE {_TEXT}) AS texts FROM {{bullets}} GROUP BY slide_id) e ON p.slide_id = e.slide_id
      WHERE CASE WHEN type = 'G2' THEN n > 1 WHEN type IN ('G1', 'G4', 'S1', 'S4', 'S6') THEN texts > 0 ELSE TRUE END)
    SELECT type, split, count(*) AS n, count(*) AS ids FROM k GROUP BY type, split UNION ALL SELECT 'NO_DEFECT', 'train', greatest(1, CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT)), greatest(1, CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT)) FROM k""")
