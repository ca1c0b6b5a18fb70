"""Schemas of the nested layout tables; nothing is inferred."""

from __future__ import annotations

BBOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
ELEMENT = f"STRUCT<element_id: STRING, type: STRING, bbox: {BBOX}, text: STRING, style: VARIANT, z: INT, placeholder_id: STRING, metadata: VARIANT>"
SLIDE_FIELDS = f"slide_id STRING, width INT, height INT, elements ARRAY<{ELEMENT}>, metadata VARIANT"
SLIDE = f"STRUCT<{SLIDE_FIELDS}>"
DECK_FIELDS = f"deck_id STRING, slides ARRAY<{SLIDE}>, metadata VARIANT, {SLIDE_FIELDS.replace(', metadata VARIANT', '')}"
