"""Published tables: languages and judges side by side, mean rows, review summaries, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.metrics import turn_scores
from assayer.schemas import LANGUAGES


def by_language(df: DataFrame, row: str, values: list[str]) -> DataFrame:
    """One row for each ``row``: every value for each language, and its difference."""
    out = df.groupBy(row).agg(*(F.max(F.when(F.col("lang") == lang, F.col(v))).alias(f"{lang}_{v}") for lang in LANGUAGES for v in values))
    return out.withColumns({f"delta_{v}": F.col(f"ko_{v}") - F.col(f"en_{v}") for v in values})


def pooled_scores(df: DataFrame) -> DataFrame:
    """(judge_id, lang, score, n): all valid turn scores over 0 of the judge's models."""
    rows = turn_scores(df).where("score > 0")
    return rows.groupBy("judge_id", "lang").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def with_mean_row(df: DataFrame, label: str, values: list[str], name: str = "Mean") -> DataFrame:
    """Adds a row with the means of the rows as they are; round first where the mean is one of rounded rows."""
    means = df.agg(*(F.avg(v).alias(v) for v in values)).select(F.lit(name).alias(label), *values)
    return df.select(label, *values).unionByName(means)


def reference_pairs(standard: DataFrame, reference: DataFrame) -> DataFrame:
    """(judge_id, lang, standard, reference, n): second-turn means over questions valid on both sides."""
    keys = ["lang", "judge_id", "model_id", "question_id"]
    s, r = (d.where("score_turn2 > 0").select(*keys, F.col("score_turn2").alias(n)) for d, n in ((standard, "s"), (reference, "r")))
    return s.join(r, keys).groupBy("judge_id", "lang").agg(F.avg("s").alias("standard"), F.avg("r").alias("reference"), F.count("*").alias("n"))


def judge_matrix(df: DataFrame, categories: DataFrame, judges: list[str]) -> DataFrame:
    """(lang, row_type, row_id, one column for each judge, judge_mean); categories come from the questions."""
    rows = turn_scores(df.drop("category").join(categories, "question_id")).where("score > 0")
    typed = F.explode(F.array(*(F.struct(F.lit(k).alias("row_type"), F.col(c).alias("row_id")) for k, c in (("model", "model_id"), ("category", "category")))))
    flat = rows.select("lang", "judge_id", "score", typed.alias("r")).select("lang", "judge_id", "score", "r.*")
    out = flat.groupBy("lang", "row_type", "row_id").agg(*(F.avg(F.when(F.col("judge_id") == j, F.col("score"))).alias(j) for j in judges))
    total = sum((F.coalesce(j, F.lit(0.0)) for j in judges), F.lit(0.0))
    many = sum((F.col(j).isNotNull().cast("int") for j in judges), F.lit(0))
    return out.withColumn("judge_mean", F.try_divide(total, many))


def leaderboard(df: DataFrame, metric: str, top: int) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), "model_id").limit(top)


def translation_review(df: DataFrame) -> DataFrame:
    """By category, from a table of strings: means of the scores and counts of the flags."""
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in ("bleu_avg", "semantic_avg", "difficulty_avg", "constraint_avg", "overall_avg")]
    flags = [F.count_if(F.col(c) == "True").alias(c) for c in ("needs_manual_check", "modified")]
    return df.groupBy("category").agg(F.count("*").alias("n"), *means, *flags)


def preview_ids(df: DataFrame, group: str, item: str, most: int = 10) -> DataFrame:
    """The smallest ids of each group: only ``most`` of them are ever held."""
    from pyspark.sql import Window

    first = df.select(group, item).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(item))).where(F.col("_k") <= most)
    return first.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("ids"))
