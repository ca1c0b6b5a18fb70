"""JSON objects out of a model's free text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def first_object(raw: str | None) -> str | None:
    """The first JSON object in a text, in a fence or on its own, as compact JSON with sorted keys; else null."""
    if raw is None:
        return None
    decoder = json.JSONDecoder()
    for text in [*(m.strip() for m in _FENCE.findall(raw)), raw]:
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                pass
            else:
                if isinstance(value, dict):
                    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            at = text.find("{", at + 1)
    return None


def recover_json(raw: Column) -> Column:
    """``first_object`` on a column, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return F.pandas_udf(run, "string")(raw)
