"""Three policies that keep one record for each key. They differ in how they treat missing times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGLE_KEY = ("lang", "judge_id", "model_id", "question_id")


def newest(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Spark prunes each task's rows before the shuffle (window group limit)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def _has(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(c) for c in names if c in df.columns]


def single(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Newest ``tstamp``; no time loses to any; of equal times the later read wins."""
    return newest(df, _has(df, *SINGLE_KEY), [F.col("tstamp").desc_nulls_last(), F.col(seq).desc()])


def pair_key(df: DataFrame) -> list[Column]:
    return [*_has(df, "lang", "judge_id"), F.least("model_a", "model_b"), F.greatest("model_a", "model_b"), F.col("question_id"), F.col("turn")]


def pairwise(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The same for unordered pairs of models; the record that stays keeps its own order."""
    return newest(df, pair_key(df), [F.col("tstamp").desc_nulls_last(), F.col(seq).desc()])


def artifact(df: DataFrame, seq: str = "seq") -> DataFrame:
    """As ``single``, but no time counts as time 0."""
    return newest(df, _has(df, *SINGLE_KEY), [F.coalesce("tstamp", F.lit(0.0)).desc(), F.col(seq).desc()])


def last_wins(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last read row of each key; keys that are no integers are left out."""
    own = df.withColumn(key, F.expr(f"try_cast({key} as bigint)")).where(F.col(key).isNotNull())
    return newest(own, [F.col(key)], [F.col(seq).desc()])
