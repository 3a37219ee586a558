"""Column builders: parsing judge texts, resolving verdicts, validity of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)[\s\x1c-\x1f]+"
# The forms in which a judge writes a rating, tried in this order, and a verdict.
RATINGS = (r"\[\[(\d+(?:\.\d+)?)\]\]", r"[Rr]ating:\s*(\d+(?:\.\d+)?)", r"[Rr]ating:\s*\*\*(\d+(?:\.\d+)?)\*\*")
VERDICT = r"\[\[([ABCabc])\]\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_BLANK}", ""), f"{_BLANK}$", "")


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def _last(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def parse_score(text: Column) -> Column:
    """The last rating of the first form that occurs; -1 for none or one outside 1 to 10."""
    found = F.coalesce(*(_last(text, p) for p in RATINGS)).cast("double")
    return F.when(found.between(1, 10), found).otherwise(F.lit(-1.0))


def parse_verdict(text: Column) -> Column:
    letter = F.upper(_last(text, VERDICT))
    return F.when(letter == "C", "tie").otherwise(F.coalesce(letter, F.lit("error")))


def resolve_winner(ab: Column, ba: Column, a: Column, b: Column) -> Column:
    """Errors dominate; the second order's letters are swapped; disagreement is inconsistent."""
    swapped = F.when(ba == "A", "B").when(ba == "B", "A").otherwise("tie")
    own = F.when(ab.isin("A", "B"), ab).otherwise("tie")
    side = F.when(own == "A", a).when(own == "B", b).otherwise("tie")
    return F.when((ab == "error") | (ba == "error"), "error").when(own == swapped, side).otherwise("inconsistent")


def average_score(s1: Column, s2: Column) -> Column:
    return F.when((s1 >= 0) & (s2 >= 0), (s1 + s2) / 2)


def scored(s: Column) -> Column:
    """The score, or null for a failed parse."""
    return F.when((s >= 0) & ~F.isnan(s), s)


def stored_score(s: Column) -> Column:
    """Whether a stored score is -1 or within 1 to 10."""
    return F.coalesce(~F.isnan(s) & ((s == -1) | s.between(1, 10)), F.lit(False))


def classify_call(raw: Column, failed: Column) -> Column:
    return F.when(~failed, "valid").when(has_text(raw), "format_parse").otherwise("empty_or_api")


def has_reference(reference: Column, turn: int) -> Column:
    return has_text(F.get(reference, F.lit(turn)))


def first_turns(choices: Column) -> Column:
    return F.get(choices, F.lit(0))["turns"]
