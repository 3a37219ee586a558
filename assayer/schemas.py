"""Record types, enumerations and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and orders that results depend on.
CATEGORIES = ("writing", "roleplay", "extraction", "reasoning", "math", "coding", "stem", "humanities")
REFERENCE_CATEGORIES = ("math", "reasoning", "coding")
LANGUAGES = ("en", "ko")
VERDICTS = ("A", "B", "tie", "error")
PROTOCOLS = ("single_grade", "pairwise", "single_grade_ref")
PUBLISHED_PROTOCOLS = ("pairwise", "pairwise_ref", "single_grade", "single_grade_ref")
EXPECTED_RECORDS = {"single_grade": 480, "pairwise": 1200, "single_grade_ref": 174}
CALLS_PER_RECORD = {"single_grade": 2, "pairwise": 2, "single_grade_ref": 1}

QUESTION = "question_id long, category string, turns array<string>, reference array<string>"
ANSWER = "question_id long, model_id string, choices array<struct<index:int,turns:array<string>>>, tstamp double, input_sha256 string"
SINGLE = (
    "question_id long, model_id string, judge_id string, score_turn1 double, score_turn2 double, judgment_turn1 string, "
    "judgment_turn2 string, category string, tstamp double, input_sha256 string, avg_score double"
)
PAIRWISE = (
    "question_id long, model_a string, model_b string, judge_id string, winner string, judgment_ab string, judgment_ba string, "
    "winner_ab string, winner_ba string, turn int, category string, tstamp double, input_sha256 string"
)
SCHEMAS = {"question": QUESTION, "answer": ANSWER, "single": SINGLE, "pairwise": PAIRWISE}


def dim_category(spark: SparkSession) -> DataFrame:
    rows = [(k, c, c in REFERENCE_CATEGORIES) for k, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "row_order int, category string, is_reference boolean")


def dim_protocol(spark: SparkSession) -> DataFrame:
    rows = [(p, EXPECTED_RECORDS[p] * CALLS_PER_RECORD[p]) for p in PROTOCOLS]
    return spark.createDataFrame(rows, "protocol string, expected_calls long")
