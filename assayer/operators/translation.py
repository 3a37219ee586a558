"""Translations back into English, and the scores of what they keep: two runs whose units carry the hashes of all they depend on.

The first translates questions turn by turn; the second compares each turn of the original with its back-translation, by a
judge's strict verdict and by BLEU. Both are protocols of ``resume.run``: answers are kept in its journal, records with
another source, prompt, service or mode are stale, and a staged run replaces the old table only when every unit is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fingerprints, text
from assayer.functions.text import fingerprint
from assayer.operators import coverage, gates, validity
from assayer.operators.judging import respond
from assayer.operators.merge import translation_is_current
from assayer.operators.protocols import MakeChat, now, turn_of, user_messages

LIVE, MOCK, BLEU_ONLY = "live", "mock", "bleu_only"
TRANSLATE = "Translate the text into English. Keep its meaning, its difficulty, its format and every constraint. Give the translation alone."
CONTEXT = "The conversation so far, in English:\n{previous}\n\nTranslate what follows:\n"
CHECK = "Compare a text with a translation of it. Give JSON alone with semantic_preservation, difficulty_preservation, constraint_preservation and overall_score (1 to 5), issue_summary and needs_manual_check."
TRANSLATED = "question_id long, category string, turns array<string>, reference array<string>, source_sha256 string, prompt_sha256 string, mode string, tstamp double, input_sha256 string"
TURN = f"turn int, bleu double, {validity.VERDICT}"
SCORED = f"question_id long, category string, source_sha256 string, back_sha256 string, mode string, turns array<struct<{TURN.replace(' int', ':int').replace(' double', ':double').replace(' string', ':string').replace(' boolean', ':boolean')}>>, tstamp double, input_sha256 string"
# What stands for a verdict where no judge was asked.
MOCK_VERDICT = dict.fromkeys(validity.SCORES, 4) | {"issue_summary": "mock: mostly preserved.", "needs_manual_check": False, "parse_status": "ok: mock"}
NO_VERDICT = dict.fromkeys(validity.SCORES, -1) | {"issue_summary": "", "needs_manual_check": False, "parse_status": "not run: BLEU only"}


def _source(df: DataFrame) -> Column:
    return fingerprints.translation_source(df["question_id"], df["category"], df["turns"], df["reference"])


def prompt_hash() -> Column:
    return fingerprints.instructions("back-translation/1", TRANSLATE, CONTEXT)


def units(questions: DataFrame, backend: str, mode: str = LIVE) -> DataFrame:
    """Questions with the hash of their source, that of the prompts, and that of both with the service and the mode.

    Mock records have another mode and so another input hash: a live run never takes them for its own.
    """
    hashed = questions.select("question_id", "category", "turns", "reference", _source(questions).alias("source_sha256"), prompt_hash().alias("prompt_sha256"), F.lit(mode).alias("mode"))
    whole = fingerprint(protocol=F.lit("back-translation/1"), backend=F.lit(backend), source=F.col("source_sha256"), prompt=F.col("prompt_sha256"), mode=F.col("mode"))
    return hashed.withColumn("input_sha256", whole)


def _asked(own: Column, previous: Column | None = None) -> Column:
    head, tail = CONTEXT.split("{previous}")
    user = own if previous is None else F.concat(F.lit(head), previous, F.lit(tail), own)
    return user_messages(("system", F.lit(TRANSLATE)), ("user", user))


def translate(asked: DataFrame, make_chat: MakeChat = None, **options) -> DataFrame:
    """Records with ``error`` for units: turn 2 sees turn 1's translation and is not asked where that failed; each reference stands alone."""
    out = asked.withColumn("_failed", F.lit(None).cast("string"))
    for turn in (0, 1):
        messages = _asked(turn_of("turns", 0)) if turn == 0 else F.when(F.col("_failed").isNull(), _asked(turn_of("turns", 1), F.col("_turn0")))
        out = respond(out.withColumn("messages", messages), make_chat, **options)
        out = out.withColumn("_failed", F.coalesce("_failed", "error")).withColumnRenamed("response", f"_turn{turn}").drop("error", "messages")
    slots = asked.select("question_id", "input_sha256", F.posexplode("reference").alias("slot", "text"))
    done = respond(slots.withColumn("messages", _asked(F.col("text"))), make_chat, **options)
    gathered = done.groupBy("question_id").agg(  # a question's two slots
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "response"))), lambda s: s["response"]).alias("_reference"), F.max("error").alias("_error")
    )
    reference = F.when(F.col("reference").isNotNull(), F.coalesce("_reference", "reference"))
    return out.join(gathered, "question_id", "left").select(
        "question_id", "category", F.array("_turn0", "_turn1").alias("turns"), reference.alias("reference"),
        "source_sha256", "prompt_sha256", "mode", now().alias("tstamp"), "input_sha256", F.coalesce("_failed", "_error").alias("error"),
    )


def stale(back: DataFrame, questions: DataFrame, mode: str = LIVE) -> DataFrame:
    """(question_id) of translations that do not come from these questions by these prompts, or are mock ones where live ones are due."""
    wanted = questions.select("question_id", _source(questions).alias("_source"))
    live = F.lit(True) if mode == MOCK else F.col("mode") == LIVE
    sound = (F.col("source_sha256") == F.col("_source")) & (F.col("prompt_sha256") == prompt_hash()) & live & translation_is_current()
    return back.join(wanted, "question_id", "left").where(~F.coalesce(sound, F.lit(False))).select("question_id")


def require_alike(original: DataFrame, translated: DataFrame, back: DataFrame, expected: int = 80) -> None:
    """Raises unless all three tables have the same ids, so many, with the same categories and two turns of text each."""
    for df in (original, translated, back):
        gates.require_questions(df, expected)
        gates.require_none(df.where(~F.coalesce(translation_is_current(), F.lit(False))).select("question_id"), "turns need text")
    named = [df.select(F.col("question_id").alias("id"), "category") for df in (original, translated, back)]
    gates.require_none(coverage.align_three(*named).where("problems <> ''"), "tables differ")


def check_messages(original: Column, translated: Column) -> Column:
    """The call whose answer ``validity.parse_verdict`` reads."""
    return user_messages(("system", F.lit(CHECK)), ("user", F.concat(F.lit("Original:\n"), original, F.lit("\n\nTranslation:\n"), translated)))


def score_units(original: DataFrame, translated: DataFrame, back: DataFrame, backend: str, mode: str = LIVE) -> DataFrame:
    """Questions of the original with the turns of their back-translation, the messages of both turns and the hashes of all three records."""
    o = original.select("question_id", "category", F.col("turns").alias("_own"), _source(original).alias("original_sha256"))
    k = translated.select("question_id", _source(translated).alias("source_sha256"))
    b = back.select("question_id", F.col("turns").alias("_back"), _source(back).alias("back_sha256"))
    out = o.join(k, "question_id").join(b, "question_id").withColumn("mode", F.lit(mode))
    out = out.withColumns({f"turn{n + 1}": check_messages(turn_of("_own", n), turn_of("_back", n)) for n in (0, 1)})
    parts = {c: F.col(c) for c in ("original_sha256", "source_sha256", "back_sha256", "mode")}
    prompt = fingerprints.instructions("translation-validity/1", CHECK)
    return out.withColumn("input_sha256", fingerprint(protocol=F.lit("translation-validity/1"), backend=F.lit(backend), prompt=prompt, **parts))


def _bleus(asked: DataFrame) -> DataFrame:
    """(question_id, bleu1, bleu2) of the back-translated turns against the original ones."""
    each = asked.select("question_id", F.posexplode(F.arrays_zip("_own", "_back")).alias("turn", "t")).select("question_id", "turn", "t.*")
    each = each.withColumn("_key", F.concat_ws("/", F.col("question_id").cast("string"), F.col("turn").cast("string")))
    found = text.bleu(each, "_key", "_back", "_own").join(each.select("_key", "question_id", "turn"), "_key")
    return found.groupBy("question_id").agg(*(F.max(F.when(F.col("turn") == n, F.col("bleu"))).alias(f"bleu{n + 1}") for n in (0, 1)))


def score(asked: DataFrame, make_chat: MakeChat = None, **options) -> DataFrame:
    """Records with ``error`` for units: a strict verdict and a BLEU for each turn. Without a judge, mock and BLEU-only units have fixed verdicts."""
    out = asked.withColumn("error", F.lit(None).cast("string"))
    fixed = F.when(F.col("mode") == BLEU_ONLY, _literal(NO_VERDICT)).when(F.col("mode") == MOCK, _literal(MOCK_VERDICT))
    for n in (1, 2):
        out = out.withColumnRenamed("error", "_before").withColumn("messages", F.when(F.col("mode") == LIVE, F.col(f"turn{n}")))
        if make_chat is None:
            out = out.withColumns({"response": F.lit(None).cast("string"), "error": F.when(F.col("mode") == LIVE, F.lit("no judge"))})
        else:
            out = respond(out, make_chat, **options).withColumn("error", F.when(F.col("mode") == LIVE, F.col("error")))
        said = F.when(F.col("response").isNotNull(), validity.parse_verdict(F.col("response")))
        out = out.withColumn(f"_v{n}", F.coalesce(fixed, said)).withColumn("error", F.coalesce("_before", "error")).drop("_before", "messages", "response")
    out = out.join(_bleus(asked), "question_id", "left")
    fields = [f.split(" ")[0] for f in validity.VERDICT.split(", ")]
    turns = F.array(*(F.struct(F.lit(n).alias("turn"), F.col(f"bleu{n}").alias("bleu"), *(F.col(f"_v{n}.{f}").alias(f) for f in fields)) for n in (1, 2)))
    return out.select("question_id", "category", "source_sha256", "back_sha256", "mode", turns.alias("turns"), now().alias("tstamp"), "input_sha256", "error")


def _literal(verdict: dict) -> Column:
    kinds = dict(f.split(" ") for f in validity.VERDICT.split(", "))
    return F.struct(*(F.lit(verdict[c]).cast(kind).alias(c) for c, kind in kinds.items()))


#: Names of the scores in tables of items, in the order of the verdict's fields.
DIMENSIONS = dict(zip(("semantic", "difficulty", "constraint", "overall"), validity.SCORES, strict=True))


def items(scored: DataFrame) -> DataFrame:
    """A row for each question: BLEU and scores by turn, their means (over valid scores; BLEU to four digits, scores to two), the flag and statuses."""
    t = [F.try_element_at("turns", F.lit(n)) for n in (1, 2)]
    bleu = [F.round(x["bleu"], 4) for x in t]
    columns = {"bleu_turn1": bleu[0], "bleu_turn2": bleu[1], "bleu_avg": F.round((t[0]["bleu"] + t[1]["bleu"]) / 2, 4)}
    for name, field in DIMENSIONS.items():
        columns |= {f"{name}_turn{n + 1}": t[n][field] for n in (0, 1)} | {f"{name}_avg": F.round(validity.turn_mean(t[0][field], t[1][field]), 2)}
    columns |= {"needs_manual_check": t[0]["needs_manual_check"] | t[1]["needs_manual_check"]}
    columns |= {f"{c}_turn{n + 1}": t[n][c] for c in ("parse_status", "issue_summary") for n in (0, 1)}
    return scored.select("question_id", "category", *(c.alias(n) for n, c in columns.items()))


def categories(of_items: DataFrame) -> DataFrame:
    """(category, n, means, needs_manual_check_count) of a table of items, and one row for all of them with a null category."""
    means = [F.avg(F.when(F.col(f"{d}_avg") >= 0, F.col(f"{d}_avg"))).alias(f"{d}_mean") for d in ("bleu", *DIMENSIONS)]
    return of_items.rollup("category").agg(F.count("*").alias("n"), *means, F.count_if("needs_manual_check").alias("needs_manual_check_count"))
