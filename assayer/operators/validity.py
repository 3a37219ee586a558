"""Translation checks: strict JSON verdicts, per-item means, rollups."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.verdicts import strip
from assayer.sources.jsonl import is_object

# The fields of a verdict, the fence it may stand in, and the order and words of the messages below.
SCORES = ("semantic_preservation", "difficulty_preservation", "constraint_preservation", "overall_score")
FIELDS = frozenset((*SCORES, "issue_summary", "needs_manual_check"))
VERDICT = ", ".join([*(f"{c} int" for c in SCORES), "issue_summary string", "needs_manual_check boolean", "parse_status string"])
_FENCE = re.compile(r"```(?:json)?\s*(\{.*\})\s*```", re.DOTALL)


def _problem(data: object) -> str | None:
    if not isinstance(data, dict):
        return "top-level JSON value must be an object"
    missing, extra = sorted(FIELDS - data.keys()), sorted(data.keys() - FIELDS)
    if missing or extra:
        return "; ".join(f"{what} fields {names}" for what, names in (("missing", missing), ("unexpected", extra)) if names)
    for name in SCORES:
        if type(data[name]) is not int or data[name] not in range(1, 6):
            return f"{name} must be an integer from 1 through 5 (booleans excluded)"
    if not isinstance(data["needs_manual_check"], bool):
        return "needs_manual_check must be a JSON boolean"
    return None if isinstance(data["issue_summary"], str) else "issue_summary must be a string"


def verdict_of(response: str | None) -> dict:
    """The checked verdict; a bad response gets scores of -1, the flag and the reason."""
    own = (response or "").strip()
    body = m[1] if (m := _FENCE.fullmatch(own)) else own
    try:
        data = json.loads(body)
        problem = _problem(data)
    except json.JSONDecodeError as e:
        problem = f"JSON decode error at position {e.pos}: {e.msg}"
    if problem:
        excerpt = own.replace("\n", " ")[:100]
        summary = f"{problem}; response={excerpt!r}" if excerpt else problem
        return dict.fromkeys(SCORES, -1) | {"issue_summary": summary[:300], "needs_manual_check": True, "parse_status": f"invalid: {problem}"[:300]}
    low = min(data[c] for c in SCORES) <= 3
    status = "ok" if not low else "ok: low score" if data["needs_manual_check"] else "ok: low score forced needs_manual_check=true"
    return data | {"issue_summary": data["issue_summary"][:300], "needs_manual_check": data["needs_manual_check"] or low, "parse_status": status}


def _verdicts(response: pd.Series) -> pd.DataFrame:
    columns = [*SCORES, "issue_summary", "needs_manual_check", "parse_status"]
    none = dict.fromkeys(columns)
    return pd.DataFrame([none if x is None else verdict_of(x) for x in response], columns=columns).astype(object)


def parse_verdict(response: Column) -> Column:
    """``verdict_of`` as a column. Whole verdicts are read by Spark's parser; only others go to Python, for their reasons."""
    own = strip(F.coalesce(response, F.lit("")))
    inner = F.regexp_extract(own, r"(?s)^```(?:json)?\s*(\{.*\})\s*```$", 1)
    body = F.when(inner != "", inner).otherwise(own)
    kinds = F.schema_of_variant(F.try_parse_json(body))
    whole = ", ".join(sorted([*(f"{c}: BIGINT" for c in SCORES), "issue_summary: STRING", "needs_manual_check: BOOLEAN"]))
    v = F.from_json(body, VERDICT)
    good = is_object(body) & (kinds == f"OBJECT<{whole}>")
    for c in SCORES:
        good = good & F.coalesce(v[c].between(1, 5), F.lit(False))
    low = F.least(*(v[c] for c in SCORES)) <= 3
    status = F.when(~low, "ok").when(v["needs_manual_check"], "ok: low score").otherwise("ok: low score forced needs_manual_check=true")
    read = F.struct(*(v[c].alias(c) for c in SCORES), F.left(v["issue_summary"], F.lit(300)).alias("issue_summary"), (v["needs_manual_check"] | low).alias("needs_manual_check"), status.alias("parse_status"))
    others = F.pandas_udf(_verdicts, VERDICT)(F.when(~F.coalesce(good, F.lit(False)), own))
    return F.when(good, read).otherwise(others)


def turn_mean(first: Column, second: Column) -> Column:
    """Mean of the turns' scores over 0; null without one."""
    a, b = (F.when(x > 0, x) for x in (first, second))
    return F.coalesce((a + b) / 2, a, b).cast("double")


def rollup(df: DataFrame, values: list[str]) -> DataFrame:
    """(category, n, means over valid scores) and the grand row, with a null category."""
    return df.rollup("category").agg(F.count("*").alias("n"), *(F.avg(F.when(F.col(v) >= 0, F.col(v))).alias(v) for v in values))


def item_rules() -> dict[str, Column]:
    """A stored item: a finite BLEU of 0 to 1, scores 1 to 5 as text, flags as text."""
    number = F.expr("try_cast(bleu as double)")
    return {
        "bleu": number.between(0, 1) & ~F.isnan(number),
        "score": F.col("overall").rlike("^[1-5]$"),
        "flag": F.col("needs_manual_check").isin("True", "False"),
    }
