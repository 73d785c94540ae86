"""Scores out of the free text of an automated review: the JSON object that opens last before ``"score"``.

The object runs to the brace that closes it, braces in strings counted too.  The score must be a
number; the other fields are 0 where they are missing and NULL where they are no numbers.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType

from pagegauge.schema import struct

#: upper bounds (fixed values)
BOUNDS = {"score": 100, "structure": 25, "citability": 25, "schema": 20, "aiMetadata": 15, "contentDensity": 15}
NO_INSIGHT = "No insight provided"
REVIEW = struct(available=BooleanType(), **{name: IntegerType() for name in BOUNDS}, insight=StringType())


def object_before(text: str, at: int) -> str | None:
    """From the last brace that opens before position ``at`` to the one that closes it."""
    start = text.rfind("{", 0, at)
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[start : i + 1]
    return None


def bounded(value: object, most: int) -> int | None:
    """A number as a whole number from 0 to ``most``, halves up; numbers written as texts count."""
    if isinstance(value, str):
        try:
            value = float(value.strip() or 0)
        except ValueError:
            return None
    if not isinstance(value, (bool, int, float)) or value != value:
        return None
    return int(max(0, min(most, math.floor(max(-1e9, min(1e9, value)) + 0.5))))


def read_review(text: str | None) -> dict | None:
    at = text.find('"score"') if text else -1
    found = object_before(text, at) if at >= 0 else None
    try:
        value = json.loads(found) if found is not None else None
    except (ValueError, RecursionError):
        return None
    score = value.get("score") if isinstance(value, dict) else None
    if isinstance(score, bool) or not isinstance(score, (int, float)):
        return None
    fields = {name: bounded(0 if value.get(name) is None else value[name], most) for name, most in BOUNDS.items()}
    insight = value.get("insight")
    return {"available": True, **fields, "insight": NO_INSIGHT if insight is None else insight if isinstance(insight, str) else json.dumps(insight)}


@F.pandas_udf(REVIEW)
def parsed_review(text: pd.Series) -> pd.DataFrame:
    rows = [read_review(t) for t in text]
    empty = {"available": False, **{name: None for name in BOUNDS}, "insight": None}
    frame = pd.DataFrame([r or empty for r in rows], columns=REVIEW.names)
    return frame.astype({name: "Int32" for name in BOUNDS})
