"""The protocols of model calls: expected units with their messages and hashes, and the calls that answer them.

Units come from questions (question_id, category, turns, reference) and answers (question_id, model_id,
choices); each protocol's call gives whole records for ``resume.run``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fingerprints, prompts
from assayer.functions.verdicts import first_turns, has_reference, parse_score, parse_verdict, resolve_winner
from assayer.operators.coverage import model_pairs
from assayer.operators.judging import Chat, respond
from assayer.schemas import REFERENCE_CATEGORIES

MakeChat = Callable[[], Chat] | None


def turn_of(column: str | Column, k: int) -> Column:
    return F.get(F.col(column) if isinstance(column, str) else column, F.lit(k))


def now() -> Column:
    return F.unix_micros(F.current_timestamp()) / 1e6


def user_messages(*contents: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in contents))


# Answers.
def generation_units(questions: DataFrame, models: list[str], backend: str, system: str | None = None, temperature: float = 0.7, max_tokens: int = 1024) -> DataFrame:
    """Every question for every model of a short list."""
    units = questions.select("question_id", "category", "turns", F.explode(F.array(*map(F.lit, models))).alias("model_id"))
    hashed = fingerprints.generation(F.col("question_id"), F.col("category"), F.col("turns"), F.col("model_id"), backend, temperature, max_tokens, system)
    first = F.concat(F.lit(f"{system}\n\n"), turn_of("turns", 0)) if system else turn_of("turns", 0)
    return units.withColumns({"input_sha256": hashed, "first": first})


def generate(units: DataFrame, make_chat: MakeChat = None, **options) -> DataFrame:
    """Two calls, the second with the first answer in its context; the second is not made where the first failed."""
    asked = respond(units.withColumn("messages", user_messages(("user", F.col("first")))), make_chat, **options)
    asked = asked.withColumnsRenamed({"response": "answer1", "error": "error1"})
    context = user_messages(("user", F.col("first")), ("assistant", F.col("answer1")), ("user", turn_of("turns", 1)))
    out = respond(asked.withColumn("messages", F.when(F.col("error1").isNull(), context)), make_chat, **options)
    choices = F.array(F.struct(F.lit(0).alias("index"), F.array("answer1", "response").alias("turns")))
    return out.select("question_id", "model_id", choices.alias("choices"), now().alias("tstamp"), "input_sha256", F.coalesce("error1", "error").alias("error"))


# Grades.
def _answered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return questions.select("question_id", "category", "turns", "reference").join(answers.select("question_id", "model_id", first_turns(F.col("choices")).alias("own")), "question_id")


def unanswered(questions: DataFrame, answers: DataFrame, models: list[str], judge: str) -> DataFrame:
    """(question_id, model_id, judge_id) of questions that a model has not answered."""
    every = questions.select("question_id", F.explode(F.array(*map(F.lit, models))).alias("model_id"))
    return every.join(answers.select("question_id", "model_id"), ["question_id", "model_id"], "left_anti").withColumn("judge_id", F.lit(judge))


def single_units(questions: DataFrame, answers: DataFrame, judge: str, backend: str, lang: str = "en") -> DataFrame:
    units = _answered(questions, answers).withColumn("judge_id", F.lit(judge))
    turn1 = prompts.single(turn_of("turns", 0), turn_of("own", 0), F.lit(lang))
    turn2 = prompts.multi_single(turn_of("turns", 0), turn_of("own", 0), turn_of("turns", 1), turn_of("own", 1), F.lit(lang))
    units = units.withColumns({"turn1": turn1, "turn2": turn2})
    return units.withColumn("input_sha256", fingerprints.single(F.col("question_id"), F.col("category"), F.col("judge_id"), backend, F.col("turn1"), F.col("turn2")))


def _graded(df: DataFrame, make_chat: MakeChat, turn: int, **options) -> DataFrame:
    out = respond(df, make_chat, messages=f"turn{turn}", **options).withColumnsRenamed({"response": f"judgment_turn{turn}", "error": f"error{turn}"})
    return out.withColumn(f"score_turn{turn}", parse_score(F.col(f"judgment_turn{turn}")))


_SINGLE = ("question_id", "model_id", "judge_id", "score_turn1", "score_turn2", "judgment_turn1", "judgment_turn2", "category")


def grade_single(units: DataFrame, make_chat: MakeChat = None, **options) -> DataFrame:
    """Turn 1 alone, turn 2 with the whole conversation."""
    out = _graded(_graded(units, make_chat, 1, **options), make_chat, 2, **options)
    average = F.when((F.col("score_turn1") >= 0) & (F.col("score_turn2") >= 0), (F.col("score_turn1") + F.col("score_turn2")) / 2)
    return out.select(*_SINGLE, now().alias("tstamp"), "input_sha256", average.alias("avg_score"), F.coalesce("error1", "error2").alias("error"))


def with_references(questions: DataFrame, selection: str = "usable-turn2", categories: tuple[str, ...] = REFERENCE_CATEGORIES) -> DataFrame:
    """Questions of these categories that declare a reference, or have one for turn 2."""
    if selection not in ("historical-declared", "usable-turn2"):
        raise ValueError(f"unknown selection {selection}")
    chosen = F.col("reference").isNotNull() if selection == "historical-declared" else has_reference(F.col("reference"), 1)
    return questions.where(F.col("category").isin(*categories) & chosen)


def reference_single_units(questions: DataFrame, answers: DataFrame, judge: str, backend: str, lang: str = "en", selection: str = "usable-turn2") -> DataFrame:
    units = _answered(with_references(questions, selection), answers).withColumn("judge_id", F.lit(judge))
    turn2 = prompts.multi_single(turn_of("turns", 0), turn_of("own", 0), turn_of("turns", 1), turn_of("own", 1), F.lit(lang), F.col("reference"))
    units = units.withColumn("turn2", turn2)
    return units.withColumn("input_sha256", fingerprints.reference_single(F.col("question_id"), F.col("category"), F.col("judge_id"), backend, F.col("turn2")))


def grade_reference_single(units: DataFrame, make_chat: MakeChat = None, **options) -> DataFrame:
    """One call with the references; turn 1 is not graded."""
    out = _graded(units, make_chat, 2, **options).withColumns({"score_turn1": F.lit(-1.0), "judgment_turn1": F.lit("")})
    return out.select(*_SINGLE, now().alias("tstamp"), "input_sha256", F.lit(None).cast("double").alias("avg_score"), F.col("error2").alias("error"))


# Pairs.
def pair_units(questions: DataFrame, answers: DataFrame, judge: str, backend: str, lang: str = "en", references: bool = False, models: list[str] | None = None) -> DataFrame:
    """All pairs of models that answered a question, both orders' messages; with ``references`` only questions with one for turn 2.

    Pairs are in the order of ``models``, or of names. ``turned_sha256`` is the input hash of the pair the other way round, by which
    records of that form are taken up again (``resume.in_order_of_units``).
    """
    asked = with_references(questions) if references else questions
    own = _answered(asked, answers)
    sides = {k: own.select("question_id", F.col("model_id").alias(f"model_{k}"), F.col("own").alias(f"own_{k}")) for k in "ab"}
    pairs = model_pairs(own, "question_id", order=models).join(asked.select("question_id", "category", "turns", "reference"), "question_id")
    for k, side in sides.items():
        pairs = pairs.join(side, ["question_id", f"model_{k}"])
    a, b = ((turn_of(f"own_{k}", 0), turn_of(f"own_{k}", 1)) for k in "ab")
    q1, q2, slots = turn_of("turns", 0), turn_of("turns", 1), F.col("reference") if references else None
    units = pairs.withColumns({"judge_id": F.lit(judge), "messages_ab": prompts.multi_pair(q1, q2, a, b, F.lit(lang), slots), "messages_ba": prompts.multi_pair(q1, q2, b, a, F.lit(lang), slots)})
    hashed = fingerprints.reference_pairwise if references else fingerprints.pairwise
    of = [F.col(c) for c in ("question_id", "category", "judge_id")]
    sides = F.col("messages_ab"), F.col("messages_ba")
    return units.withColumns({"input_sha256": hashed(*of, backend, *sides), "turned_sha256": hashed(*of, backend, *reversed(sides))})


def unanswered_pairs(questions: DataFrame, answers: DataFrame, models: list[str], judge: str) -> DataFrame:
    """(question_id, model_a, model_b, judge_id) where one side or both have no answer, in the order of ``models``."""
    lacking = unanswered(questions, answers, models, judge)
    named = F.explode(F.array(*map(F.lit, models)))
    pairs = lacking.select("question_id", "model_id", "judge_id", named.alias("other")).where("model_id <> other")
    place = F.create_map(*(F.lit(x) for k, m in enumerate(models) for x in (m, k)))
    first = place[F.col("model_id")] < place[F.col("other")]
    ends = [F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("model_id", "other"), ("other", "model_id"))]
    return pairs.select("question_id", ends[0].alias("model_a"), ends[1].alias("model_b"), "judge_id").distinct()


def judge_pairs(units: DataFrame, make_chat: MakeChat = None, **options) -> DataFrame:
    """Both orders; the winner that the two verdicts give."""
    out = units
    for k in ("ab", "ba"):
        out = respond(out, make_chat, messages=f"messages_{k}", **options).withColumnsRenamed({"response": f"judgment_{k}", "error": f"error_{k}"})
        out = out.withColumn(f"winner_{k}", parse_verdict(F.col(f"judgment_{k}")))
    winner = resolve_winner(F.col("winner_ab"), F.col("winner_ba"), F.col("model_a"), F.col("model_b"))
    return out.select(
        "question_id", "model_a", "model_b", "judge_id", winner.alias("winner"), "judgment_ab", "judgment_ba", "winner_ab", "winner_ba",
        F.lit(2).alias("turn"), "category", now().alias("tstamp"), "input_sha256", F.coalesce("error_ab", "error_ba").alias("error"),
    )
