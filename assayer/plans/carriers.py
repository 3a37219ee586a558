"""Evaluation tables derived from the generic test tables, in SQL that Spark and DuckDB both run.

Scores are whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.schemas import CATEGORIES
from assayer.sources.files import table

CATEGORY = "CASE CAST(floor((event_id % 80) / 10.0) AS INT) " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CATEGORIES)) + " END"
LANG = "CASE WHEN CAST(floor(event_id / 80.0) AS BIGINT) % 2 = 0 THEN 'en' ELSE 'ko' END"
TSTAMP = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 7 - 2 AS DOUBLE) END"
WHOLE = "CAST(floor(value) AS BIGINT)"

#: name: (source table, SQL with that table in braces)
CARRIERS: dict[str, tuple[str, str]] = {
    "j_single": (
        "events",
        f"""SELECT event_id AS seq, {LANG} AS lang, 'j' || event_type AS judge_id, 'm' || CAST(user_id % 6 AS STRING) AS model_id,
        81 + event_id % 80 AS question_id, {CATEGORY} AS category,
        CAST(CASE WHEN event_id % 17 = 0 THEN -1 ELSE 1 + {WHOLE} % 10 END AS DOUBLE) AS score_turn1,
        CAST(CASE WHEN event_id % 13 = 0 THEN -1 ELSE 1 + CAST(floor(value * 7) AS BIGINT) % 10 END AS DOUBLE) AS score_turn2,
        CASE WHEN event_id % 34 = 0 THEN ' ' ELSE 'text ' || event_type END AS judgment_turn1,
        CASE WHEN event_id % 26 = 0 THEN '' ELSE 'more ' || event_type END AS judgment_turn2,
        {TSTAMP} AS tstamp, 'h' || CAST(event_id % 3 AS STRING) AS input_sha256 FROM {{events}}""",
    ),
    "j_pair": (
        "events",
        f"""SELECT seq, lang, judge_id, question_id, category, 2 AS turn, model_a, model_b, winner_ab, winner_ba, tstamp,
        CASE WHEN winner_ab = 'error' THEN '' ELSE 'ab' END AS judgment_ab, CASE WHEN winner_ba = 'error' THEN 'ba' ELSE 'ba [[A]]' END AS judgment_ba,
        CASE WHEN winner_ab = 'error' OR winner_ba = 'error' THEN 'error' WHEN winner_ab = 'tie' AND winner_ba = 'tie' THEN 'tie'
             WHEN winner_ab = 'A' AND winner_ba = 'B' THEN model_a WHEN winner_ab = 'B' AND winner_ba = 'A' THEN model_b ELSE 'inconsistent' END AS winner
        FROM (SELECT event_id AS seq, {LANG} AS lang, 'j' || event_type AS judge_id, 81 + event_id % 80 AS question_id, {CATEGORY} AS category,
        'm' || CAST(user_id % 6 AS STRING) AS model_a, 'm' || CAST((user_id + 1 + event_id % 5) % 6 AS STRING) AS model_b,
        CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' WHEN 3 THEN 'A' WHEN 4 THEN 'B' ELSE CASE WHEN event_id % 4 = 1 THEN 'error' ELSE 'tie' END END AS winner_ab,
        CASE {WHOLE} % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' WHEN 3 THEN 'A' WHEN 4 THEN 'B' WHEN 5 THEN 'tie' ELSE CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'B' END END AS winner_ba,
        {TSTAMP} AS tstamp FROM {{events}}) p""",
    ),
    "j_text": (
        "events",
        f"""SELECT event_id AS id, 'j' || event_type AS judge_id, CASE event_id % 7 WHEN 0 THEN 'fine. Rating: [[' || n || ']]' WHEN 1 THEN 'Rating: ' || n
        WHEN 2 THEN 'rating: **' || n || '.5**' WHEN 3 THEN '[[3]] then [[' || n || ']]' WHEN 4 THEN 'so [[' || substr('AbcXC', CAST(1 + event_id % 5 AS INT), 1) || ']] [[B' || CASE WHEN event_id % 2 = 0 THEN ']]' ELSE '' END
        WHEN 5 THEN '' END AS raw FROM (SELECT event_id, event_type, CAST({WHOLE} % 13 AS STRING) AS n FROM {{events}}) p""",
    ),
    "qa": (
        "conversations",
        """SELECT conv_id AS id, max(CASE WHEN turn = 0 THEN text END) AS q1, max(CASE WHEN turn = 1 THEN text END) AS a1,
        max(CASE WHEN turn = 2 THEN text END) AS q2, max(CASE WHEN turn = 3 THEN text END) AS a2,
        CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'ko' END AS lang FROM {conversations} GROUP BY conv_id""",
    ),
    "questions": (
        "events",
        f"""SELECT DISTINCT 81 + event_id % 80 AS question_id, {CATEGORY} AS category, event_id % 80 AS k,
        CASE WHEN event_id % 80 % 10 = 9 THEN NULL ELSE 'r' || CAST(event_id % 80 AS STRING) END AS ref1,
        CASE WHEN event_id % 80 % 10 = 9 THEN NULL WHEN event_id % 80 % 10 = 8 THEN ' ' ELSE 's' END AS ref2 FROM {{events}}""",
    ),
    "review": (
        "documents",
        """SELECT doc_id AS id, 'c' || CAST(doc_id % 8 AS STRING) AS category, CAST(CAST(n_chars % 128 AS DOUBLE) / 128 AS STRING) AS bleu_avg,
        CAST(1 + n_chars % 5 AS STRING) AS semantic_avg, CAST(1 + n_chars % 4 AS STRING) AS difficulty_avg, CAST(1 + n_chars % 3 AS STRING) AS constraint_avg,
        CAST(1 + n_chars % 7 AS STRING) AS overall_avg, CASE WHEN n_chars % 6 = 0 THEN 'True' ELSE 'False' END AS needs_manual_check,
        CASE WHEN n_chars % 9 = 0 THEN 'True' ELSE 'False' END AS modified,
        CAST(CASE WHEN n_chars % 5 = 0 THEN -1 ELSE 1 + n_chars % 5 END AS INT) AS s1, CAST(CASE WHEN n_chars % 7 = 0 THEN -1 ELSE 1 + n_chars % 4 END AS INT) AS s2 FROM {documents}""",
    ),
    "existing": (
        "events",
        "SELECT event_id AS seq, event_id % 500 AS id, event_type AS payload, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'h' || CAST(user_id % 3 AS STRING) END AS input_sha256 FROM {events}",
    ),
    "incoming": (
        "events",
        "SELECT event_id AS seq, 250 + (7 * event_id) % 500 AS id, event_type AS payload, 'h' || CAST(user_id % 3 AS STRING) AS input_sha256 FROM {events}",
    ),
    "paths": (
        "pages",
        """SELECT page_id, CASE page_id % 17 WHEN 0 THEN 'en/questions.jsonl' WHEN 1 THEN 'results/t' || CAST(page_id AS STRING) || '.csv' WHEN 2 THEN 'ko/answers/m' || CAST(page_id AS STRING) || '.jsonl'
        WHEN 3 THEN 'en/judgments/f/j/single_grade/m.jsonl' WHEN 4 THEN 'en/judgments/f/j/pairwise_ref/m.jsonl' WHEN 5 THEN 'README.md' WHEN 6 THEN 'fr/questions.jsonl'
        WHEN 7 THEN 'results/deep/t.csv' WHEN 8 THEN 'translation_review/items.csv' WHEN 9 THEN 'translation_review/items.json' WHEN 10 THEN 'ko/judgments/f/j/logs/run.jsonl'
        WHEN 11 THEN 'en/answers/archive/m.jsonl' WHEN 12 THEN 'en/answers/m.jsonl.bak' WHEN 13 THEN 'ko/judgments/f/j/pairwise/a_vs_b.jsonl' WHEN 14 THEN 'ko/judgments/f/j/single_grade_ref/.jsonl'
        WHEN 15 THEN 'corrected/ko/questions_v2.jsonl' ELSE url END AS path FROM {pages}""",
    ),
}


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = CARRIERS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def oracle(sql: str, *names: str, **ctes: str) -> str:
    """DuckDB SQL with the carriers and further tables in front."""
    parts = [f"{n} AS ({CARRIERS[n][1].format(**{CARRIERS[n][0]: CARRIERS[n][0]})})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in ctes.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
