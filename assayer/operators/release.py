"""Named checks of a release: each is one row (name, ok); and the rows that break the rules of a run.

Tables are the ones of the whole release: questions with ``lang``; answers and judgments with ``lang``,
``file_name`` (without its ending) and, for judgments, ``judge_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import has_script
from assayer.functions.verdicts import first_turns, has_text
from assayer.operators.coverage import grid
from assayer.schemas import CATEGORIES, REFERENCE_CATEGORIES


def table(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, ok) of checks that each give one row with ``ok``; nothing to look at is not ok."""
    named = [df.select(F.lit(name).alias("name"), F.coalesce("ok", F.lit(False)).alias("ok")) for name, df in checks.items()]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out


def _always(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))


def _none(df: DataFrame) -> DataFrame:
    return df.agg((F.count("*") == 0).alias("ok"))


def question_checks(questions: DataFrame, first: str = "en", second: str = "ko", expected: int = 80) -> DataFrame:
    """Numbers, aligned ids, two turns of text, equal numbers in all categories, categories of both languages, declared references."""
    own = {lang: questions.where(F.col("lang") == lang) for lang in (first, second)}
    counted = questions.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("ids"))
    ids = {lang: df.select("question_id", F.col("category").alias(f"c_{lang}")) for lang, df in own.items()}
    both = ids[first].join(ids[second], "question_id", "full_outer")
    census = own[second].groupBy("category").agg(F.count("*").alias("n"))
    declared = own[first].where(F.col("category").isin(*REFERENCE_CATEGORIES) & F.col("reference").isNotNull())
    return table({
        "numbers": counted.agg(((F.count("*") == 2) & F.bool_and(F.col("n") == expected)).alias("ok")),
        "unique ids": _always(counted, F.col("ids") == F.col("n")),
        "aligned ids": _always(both, F.col(f"c_{first}").isNotNull() & F.col(f"c_{second}").isNotNull()),
        "two turns": _always(questions, (F.size("turns") == 2) & F.forall("turns", has_text)),
        "categories": census.agg(((F.count("*") == len(CATEGORIES)) & F.bool_and((F.col("n") * len(CATEGORIES) == expected) & F.col("category").isin(*CATEGORIES))).alias("ok")),
        "same categories": _always(both, F.col(f"c_{first}") == F.col(f"c_{second}")),
        "references": declared.agg((F.count("*") > 0).alias("ok")),
    })


def _exact_sets(records: DataFrame, files: list[str], ids: DataFrame) -> DataFrame:
    """One row for each file: whether it holds every id of ``ids`` (``lang``, question_id) once and no other."""
    wanted = ids.select("lang", "question_id").distinct()
    many = wanted.groupBy("lang").agg(F.count("*").alias("wanted"))
    known = wanted.withColumn("known", F.lit(1))
    found = records.join(known, ["lang", "question_id"], "left").groupBy(*files).agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("ids"), F.count("known").alias("known"))
    return found.join(many, "lang", "left").withColumn("exact", (F.col("n") == F.col("wanted")) & (F.col("ids") == F.col("n")) & (F.col("known") == F.col("n")))


def answer_checks(answers: DataFrame, questions: DataFrame, models: list[str]) -> DataFrame:
    """By language: the files are those of the models; every file holds each question once, with its model and two turns."""
    turns = first_turns(F.col("choices"))
    files = answers.groupBy("lang").agg(F.count_distinct("file_name").alias("n"), F.bool_and(F.col("file_name").isin(*models)).alias("known"))
    return table({
        "models": _always(files, (F.col("n") == len(models)) & F.col("known")),
        "ids": _always(_exact_sets(answers, ["lang", "file_name"], questions), F.col("exact")),
        "records": _always(answers, (F.col("model_id") == F.col("file_name")) & (F.size(turns) == 2)),
    })


def matrix(single: DataFrame, reference: DataFrame, pairwise: DataFrame, questions: DataFrame, models: list[str], judges: DataFrame) -> DataFrame:
    """(lang, judge_key, records, complete): the 6/15/6 files of a judge, their ids, judge, categories, models and pairs.

    ``judges``: (judge_key, judge_id). Every judge of it has a row in every language of the questions.
    """
    kinds = questions.select("lang", "question_id", F.col("category").alias("_category"))
    selected = questions.where(F.col("category").isin(*REFERENCE_CATEGORIES) & F.col("reference").isNotNull())
    by, parts = ["lang", "judge_key"], []
    pairs = len(models) * (len(models) - 1) // 2
    sides = F.array_join(F.array_sort(F.array("model_a", "model_b")), "\u0000")
    known_pair = F.col("model_a").isin(*models) & F.col("model_b").isin(*models) & (F.col("model_a") != F.col("model_b"))
    for name, df, ids, unit, known, expected in (
        ("single", single, questions, F.col("model_id"), (F.col("model_id") == F.col("file_name")) & F.col("model_id").isin(*models), len(models)),
        ("reference", reference, selected, F.col("model_id"), (F.col("model_id") == F.col("file_name")) & F.col("model_id").isin(*models), len(models)),
        ("pairwise", pairwise, questions, sides, known_pair, pairs),
    ):
        rows = df.withColumns({"_unit": unit, "_known": known}).join(judges.withColumnRenamed("judge_id", "_judge"), "judge_key", "left").join(kinds, ["lang", "question_id"], "left")
        right = F.col("_known") & (F.col("judge_id") == F.col("_judge")) & (F.col("category") == F.col("_category"))
        own = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("files"), F.count_distinct("_unit").alias("units"), F.bool_and(F.coalesce(right, F.lit(False))).alias("right"))
        files = rows.groupBy(*by, "file_name").agg(F.count_distinct("_unit").alias("u")).groupBy(*by).agg(F.max("u").alias("most"))
        exact = _exact_sets(rows, [*by, "file_name"], ids).groupBy(*by).agg(F.bool_and("exact").alias("exact"))
        ok = (F.col("files") == expected) & (F.col("units") == expected) & (F.col("most") == 1) & F.col("right") & F.col("exact")
        parts.append(own.join(files, by).join(exact, by).select(*by, F.col("n").alias(f"n_{name}"), ok.alias(f"ok_{name}")))
    out = grid(questions.select("lang").distinct(), judges.select("judge_key"))
    for part in parts:
        out = out.join(part, by, "left")
    records = sum((F.coalesce(f"n_{n}", F.lit(0)) for n in ("single", "reference", "pairwise")), F.lit(0))
    complete = F.coalesce(F.col("ok_single") & F.col("ok_reference") & F.col("ok_pairwise"), F.lit(False))
    return out.select(*by, records.cast("long").alias("records"), complete.alias("complete"))


def judgment_checks(of_matrix: DataFrame, records_a_judge: int = 1854) -> DataFrame:
    """A row for each language: all judges complete, and the number of records that many judges make."""
    return of_matrix.groupBy("lang").agg(F.bool_and("complete").alias("complete"), (F.sum("records") == records_a_judge * F.count("*")).alias("total"))


def conserved(failures: DataFrame) -> DataFrame:
    """(lang, judge_id, protocol, ok) of a failure table: what was valid, unparsed, empty and missing is what was expected."""
    parts = F.col("valid_calls") + F.col("format_parse_failures") + F.col("empty_or_api_failures") + F.col("missing_calls")
    return failures.select("lang", "judge_id", "protocol", (parts == F.col("expected_calls")).alias("ok"))


def equal_cells(results: DataFrame, golden: DataFrame, keys: list[str], value: str, within: float = 0.0) -> DataFrame:
    """(keys, ok): each golden cell stands in the results, no further from its value than ``within``."""
    own = results.select(*keys, F.col(value).alias("_own"))
    return golden.join(own, keys, "left").select(*keys, F.coalesce(F.abs(F.col("_own") - F.col(value)) <= within, F.lit(False)).alias("ok"))


def run_faults(records: DataFrame, ids: DataFrame, judge: str, unit: Column) -> DataFrame:
    """(lang, file_name, fault, n) of a run's files: repeated, missing and unexpected ids, another judge, no hash, another model or pair.

    ``unit``: the name that the file should have. ``ids`` are (lang, question_id). Files without a fault have no row.
    """
    by = ["lang", "file_name"]
    wanted = ids.select("lang", "question_id").distinct()
    repeated = records.groupBy(*by, "question_id").agg(F.count("*").alias("k")).where("k > 1").groupBy(*by).agg(F.count("*").alias("n"))
    expected = records.select(*by).distinct().join(wanted, "lang")
    missing = expected.join(records, [*by, "question_id"], "left_anti").groupBy(*by).agg(F.count("*").alias("n"))
    unexpected = records.join(wanted, ["lang", "question_id"], "left_anti").groupBy(*by).agg(F.count_distinct("question_id").alias("n"))

    def broken(ok: Column) -> DataFrame:
        return records.where(~F.coalesce(ok, F.lit(False))).groupBy(*by).agg(F.count("*").alias("n"))

    found = {
        "repeated": repeated, "missing": missing, "unexpected": unexpected, "judge": broken(F.col("judge_id") == judge),
        "hash": broken(has_text(F.col("input_sha256"))), "unit": broken(unit == F.col("file_name")),
    }
    named = [df.select(*by, F.lit(name).alias("fault"), "n") for name, df in found.items()]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out


def translation_faults(original: DataFrame, translated: DataFrame) -> DataFrame:
    """(question_id, severity, fault) of a translated table of questions against the original one.

    Errors: repeated and missing ids, another category, another number of turns or references. Warnings: ids
    that the original lacks, turns without Hangul, references left out. What follows a wrong number of turns is not looked at.
    """
    o = original.select("question_id", F.col("category").alias("c0"), F.size("turns").alias("t0"), F.coalesce(F.size("reference"), F.lit(0)).alias("r0"), F.lit(True).alias("here0"))
    t = translated.select("question_id", "category", "turns", F.size("turns").alias("t1"), F.when(F.col("reference").isNotNull(), F.size("reference")).otherwise(0).alias("r1"), F.lit(True).alias("here1"))
    repeated = translated.groupBy("question_id").agg(F.count("*").alias("k")).where("k > 1").select("question_id", F.lit("error").alias("severity"), F.lit("repeated").alias("fault"))
    o = o.withColumn("r0", F.greatest("r0", F.lit(0)))
    both = o.join(t, "question_id", "full_outer")
    met = F.col("here0") & F.col("here1")
    same_turns = met & (F.col("t0") == F.col("t1"))
    rules = [
        ("error", "missing", F.col("here1").isNull()), ("warning", "unexpected", F.col("here0").isNull()), ("error", "category", met & ~F.col("c0").eqNullSafe(F.col("category"))),
        ("error", "turns", met & (F.col("t0") != F.col("t1"))), ("warning", "script", same_turns & F.exists("turns", lambda x: ~F.coalesce(has_script(x), F.lit(False)))),
        ("warning", "reference missing", same_turns & (F.col("r0") > 0) & (F.col("r1") == 0)),
        ("error", "reference count", same_turns & (F.col("r0") > 0) & (F.col("r1") > 0) & (F.col("r0") != F.col("r1"))),
    ]
    each = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("fault"))) for s, n, broken in rules)))
    return both.select("question_id", F.explode(each).alias("f")).select("question_id", "f.*").distinct().unionByName(repeated)


def preparation_faults(recorded: DataFrame, actual: DataFrame, facts: dict[str, str], found: dict[str, str]) -> DataFrame:
    """(kind, name, fault) where a machine differs from the record of its preparation.

    Files are (path, size, digest); ``facts`` are recorded versions of packages, revisions and the like.
    """
    r, a = (df.select("path", F.col("size").alias(f"size_{k}"), F.col("digest").alias(f"digest_{k}")) for k, df in (("r", recorded), ("a", actual)))
    fault = (
        F.when(F.col("digest_a").isNull(), "missing").when(F.col("digest_r").isNull(), "not recorded")
        .when(F.col("size_r") != F.col("size_a"), "size").when(F.col("digest_r") != F.col("digest_a"), "digest")
    )
    files = r.join(a, "path", "full_outer").select(F.lit("file").alias("kind"), F.col("path").alias("name"), fault.alias("fault")).where("fault is not null")
    odd = [("fact", k, "missing" if k not in found else "other value") for k, v in sorted(facts.items()) if found.get(k) != v]
    return files.unionByName(recorded.sparkSession.createDataFrame(odd, "kind string, name string, fault string"))
