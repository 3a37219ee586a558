"""Integrity constraints: each yields the rows that break it, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.verdicts import has_text, resolve_winner, stored_score
from assayer.schemas import CATEGORIES, VERDICTS


class GateError(ValueError):
    pass


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the first reason; a rule that is null counts as broken."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.withColumn("reason", reason).where("reason is not null")


def require_none(bad: DataFrame, what: str, show: int = 10) -> None:
    """Raises with the number of rows and the first few."""
    first = bad.limit(show).collect()
    if first:
        raise GateError(f"{what}: {bad.count()} rows, such as {[r.asDict() for r in first]}")


def question_rules() -> dict[str, Column]:
    two = F.size("turns") == 2
    reference = F.col("reference").isNull() | ((F.size("reference") == 2) & F.forall("reference", lambda x: x.isNotNull()) & F.exists("reference", has_text))
    return {
        "id": F.col("question_id").isNotNull(),
        "category": has_text(F.col("category")),
        "turns": two & F.forall("turns", has_text),
        "reference": reference,
    }


def single_rules() -> dict[str, Column]:
    return {
        "id": F.col("question_id").isNotNull(),
        "names": has_text(F.col("model_id")) & has_text(F.col("judge_id")),
        "category": F.col("category").isin(*CATEGORIES),
        "score": stored_score(F.col("score_turn1")) & stored_score(F.col("score_turn2")),
        "time": F.col("tstamp").isNull() | (F.abs("tstamp") < float("inf")),
    }


def pairwise_rules() -> dict[str, Column]:
    """The stored winner must be the one that the two verdicts give."""
    ab, ba, a, b = (F.col(c) for c in ("winner_ab", "winner_ba", "model_a", "model_b"))
    return {
        "models": has_text(a) & has_text(b) & (a != b),
        "verdict": ab.isin(*VERDICTS) & ba.isin(*VERDICTS),
        "winner": F.col("winner") == resolve_winner(ab, ba, a, b),
        "turn": F.col("turn") == 2,
        "category": F.col("category").isin(*CATEGORIES),
    }


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def several_judges(df: DataFrame, place: str) -> DataFrame:
    return df.groupBy(place).agg(F.count_distinct("judge_id").alias("judges")).where("judges > 1")


def category_census(df: DataFrame, expected: DataFrame) -> DataFrame:
    """(category, n, expected) for categories of either side."""
    own = df.groupBy("category").agg(F.count("*").alias("n"))
    return own.join(expected, "category", "full_outer").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))


def require_questions(df: DataFrame, expected: int = 80, turns: int = 2) -> None:
    """Raises unless there are exactly so many questions, each once and with so many turns."""
    require_none(duplicate_keys(df, "question_id"), "repeated question_id")
    require_none(df.where(F.coalesce(F.size("turns"), F.lit(-1)) != turns).select("question_id"), f"questions need exactly {turns} turns")
    found = df.count()
    if found != expected:
        raise GateError(f"exactly {expected} questions are needed, not {found}")


def require_complete(reasons: DataFrame) -> None:
    """Raises if a table of incomplete units (``merge.incomplete``) has a row."""
    require_none(reasons.orderBy(*reasons.columns), "incomplete units")


def set_fingerprints(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n, digest): equal sets have equal digests; sums of hashes, so no set is gathered."""
    own = df.select(group, item).distinct()
    return own.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("digest"), F.sum(F.crc32(F.col(item).cast("string")).cast("decimal(38,0)")).alias("digest2"))


def uniform_sets(df: DataFrame, group: str, item: str) -> DataFrame:
    """One row: number of groups, and whether all have the same set."""
    sets = set_fingerprints(df, group, item)
    return sets.agg(F.count("*").alias("n_groups"), (F.count_distinct("n", "digest", "digest2") <= 1).alias("uniform"))


def matrix_complete(files: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(lang, judge_id, protocol, n_files, complete)."""
    need = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    found = files.groupBy("lang", "judge_id", "protocol").agg(F.count_distinct("file_name").alias("n_files"))
    return found.withColumn("complete", F.col("n_files") == F.try_element_at(need, F.col("protocol")))
