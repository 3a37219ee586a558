"""Scores, win rates and failures, from records that are already one for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.verdicts import classify_call, scored
from assayer.operators.coverage import product
from assayer.schemas import CALLS_PER_RECORD, CATEGORIES, EXPECTED_RECORDS, REFERENCE_CATEGORIES


def turn_scores(df: DataFrame) -> DataFrame:
    """One row for each turn: the record's columns, turn, score (null for a failed parse)."""
    turns = F.array(*(F.struct(F.lit(k).alias("turn"), F.col(f"score_turn{k}").alias("raw")) for k in (1, 2)))
    rows = df.withColumn("_t", F.explode(turns))
    return rows.withColumns({"turn": F.col("_t.turn"), "score": scored(F.col("_t.raw"))}).drop("_t")


def _category_means(categories: tuple[str, ...]) -> list[Column]:
    return [F.avg(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in categories]


def _scores(rows: DataFrame, by: list[str], categories: tuple[str, ...], calls: int, expected_questions: int | None) -> DataFrame:
    n, asked = F.count("score"), F.lit(expected_questions)
    expected = F.count("*") if expected_questions is None else calls * asked
    return rows.groupBy(*by).agg(
        *_category_means(categories),
        F.avg("score").alias("overall"),
        F.count_distinct("question_id").alias("n_questions"),
        n.alias("n_samples"),
        F.count("*").alias("observed"),
        expected.cast("long").alias("expected"),
        (F.count("*") - n).alias("failures"),
        F.try_divide(F.count("*") - n, F.count("*")).alias("failure_rate"),
        (F.count_distinct("question_id") / asked.cast("double")).alias("coverage"),
    )


def single_scores(df: DataFrame, by: list[str], expected_questions: int | None = None) -> DataFrame:
    """Means over turn samples (not over category means), counts, failures and coverage.

    Where it is not said how many questions are expected, as many samples are as there are, and there is no coverage.
    """
    return _scores(turn_scores(df), by, CATEGORIES, 2, expected_questions)


def reference_scores(df: DataFrame, by: list[str], expected_questions: int | None = None) -> DataFrame:
    """The same for the second turn of reference-guided records."""
    return _scores(df.withColumn("score", scored(F.col("score_turn2"))), by, REFERENCE_CATEGORIES, 1, expected_questions)


def win_rates(df: DataFrame, by: list[str], expected_questions: int | None = None, models: list[str] | DataFrame | None = None) -> DataFrame:
    """Each game credits both models; a tie or an inconsistent pair is half a win, an error none.

    A winner that is null or none of the known ones is an error too. With ``models`` (a list, or a table with model_id)
    only games between two of them count, and each of them has a row in every group, without a game too; otherwise the models
    are those that a group's games name. With ``expected_questions`` each model of a group is expected to meet
    every other one on so many questions.
    """
    games = df
    if models is not None:
        named = models if isinstance(models, DataFrame) else df.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
        named = named.select("model_id").distinct()
        for side in ("model_a", "model_b"):
            games = games.join(named.withColumnRenamed("model_id", side), side, "left_semi")
    games = games.withColumn("model_id", F.explode(F.array("model_a", "model_b")))
    inconsistent, tie = (F.col("winner").eqNullSafe(x) for x in ("inconsistent", "tie"))
    won = F.col("winner").eqNullSafe(F.col("model_id"))
    error = ~(inconsistent | tie | F.col("winner").eqNullSafe(F.col("model_a")) | F.col("winner").eqNullSafe(F.col("model_b")))
    gain = F.when(~error, F.when(won, 1.0).when(tie | inconsistent, 0.5).otherwise(0.0))
    consistent = F.when(~inconsistent, gain)
    per = [F.avg(F.when(F.col("category") == c, gain)).alias(c) for c in CATEGORIES]
    total = F.count("*")
    out = games.groupBy(*by, "model_id").agg(
        *per,
        F.avg(gain).alias("overall"),
        F.count(gain).alias("n_games"),
        F.avg(consistent).alias("overall_consistent_only"),
        F.count(consistent).alias("n_consistent_games"),
        total.alias("n_pairs_total"),
        F.count_if(inconsistent).alias("n_inconsistent"),
        F.count_if(error).alias("n_errors"),
        F.try_divide(F.count(gain), total).alias("valid_fraction"),
        F.try_divide(F.count(consistent), total).alias("consistent_fraction"),
    )
    counts = [c for c in out.columns if c.startswith("n_")]
    if models is not None:
        groups = product(df.select(*by).distinct(), named) if by else named
        out = groups.join(out, [*by, "model_id"], "left").fillna(0, counts)
        others = F.lit(max(named.count() - 1, 0))
    elif expected_questions is not None:
        others = F.count("*").over(Window.partitionBy(*by)) - 1  # the models of a group
    expected = F.col("n_pairs_total") if expected_questions is None else (expected_questions * others).cast("long")
    return out.withColumn("n_expected_pairs", expected)


def inconsistency(df: DataFrame, by: list[str]) -> DataFrame:
    """Among valid pairs those whose verdict turns with the order, and which side they favour."""
    valid, bad = F.col("winner") != "error", F.col("winner") == "inconsistent"
    first = bad & (F.col("winner_ab") == "A") & (F.col("winner_ba") == "A")
    second = bad & (F.col("winner_ab") == "B") & (F.col("winner_ba") == "B")
    out = df.groupBy(*by).agg(
        F.count_if(bad).alias("inconsistent"), F.count_if(valid).alias("valid"), F.count_if(first).alias("same_first"), F.count_if(second).alias("same_second")
    )
    out = out.withColumn("other", F.col("inconsistent") - F.col("same_first") - F.col("same_second"))
    shares = {f"{c}_pct": F.try_divide(F.col(c), F.col("inconsistent")) * 100 for c in ("same_first", "same_second", "other")}
    return out.withColumns({"rate_pct": F.try_divide(F.col("inconsistent"), F.col("valid")) * 100} | shares)


def calls(single: DataFrame, pairwise: DataFrame, reference: DataFrame) -> DataFrame:
    """(lang, judge_id, protocol, state): one row for each model call behind the records."""

    def of(df: DataFrame, protocol: str, parts: list[tuple[str, Column]]) -> DataFrame:
        each = F.array(*(classify_call(F.col(raw), failed) for raw, failed in parts))
        return df.select("lang", "judge_id", F.lit(protocol).alias("protocol"), F.explode(each).alias("state"))

    def no(c: str, value) -> Column:
        return F.coalesce(F.col(c) == value, F.lit(True))

    turns = [(f"judgment_turn{k}", no(f"score_turn{k}", -1)) for k in (1, 2)]
    sides = [(f"judgment_{k}", no(f"winner_{k}", "error")) for k in ("ab", "ba")]
    return of(single, "single_grade", turns).unionByName(of(pairwise, "pairwise", sides)).unionByName(of(reference, "single_grade_ref", turns[1:]))


def failure_table(all_calls: DataFrame) -> DataFrame:
    """Valid, unparsed, empty and missing calls against what a full run would make."""
    expected = F.create_map(*(F.lit(x) for p, n in EXPECTED_RECORDS.items() for x in (p, n * CALLS_PER_RECORD[p])))
    counted = all_calls.groupBy("lang", "judge_id", "protocol").agg(
        *(F.count_if(F.col("state") == s).alias(n) for s, n in (("valid", "valid_calls"), ("format_parse", "format_parse_failures"), ("empty_or_api", "empty_or_api_failures")))
    )
    seen = F.col("valid_calls") + F.col("format_parse_failures") + F.col("empty_or_api_failures")
    counted = counted.withColumn("expected_calls", expected[F.col("protocol")].cast("long"))
    counted = counted.withColumn("missing_calls", F.greatest(F.col("expected_calls") - seen, F.lit(0)))
    return counted.withColumn("total_failures", F.col("format_parse_failures") + F.col("empty_or_api_failures") + F.col("missing_calls"))


def run_audit(single: DataFrame, pairwise: DataFrame, by: list[str]) -> DataFrame:
    """Records, failed parses, inconsistent pairs and expected calls of each run."""
    s = single.groupBy(*by).agg(
        F.count("*").alias("single_records"),
        F.sum((F.col("score_turn1") == -1).cast("long") + (F.col("score_turn2") == -1).cast("long")).alias("single_failures"),
    )
    p = pairwise.groupBy(*by).agg(
        F.count("*").alias("pair_records"),
        F.sum((F.col("winner_ab") == "error").cast("long") + (F.col("winner_ba") == "error").cast("long")).alias("pair_failures"),
        F.count_if(F.col("winner") == "inconsistent").alias("inconsistent"),
    )
    names = ("single_records", "single_failures", "pair_records", "pair_failures", "inconsistent")
    out = s.join(p, by, "full_outer").select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    return out.withColumn("model_calls", 2 * F.col("single_records") + 2 * F.col("pair_records"))
