"""Expected against observed: missing and unexpected units, pairs, alignments, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from assayer.functions.verdicts import has_reference
from assayer.schemas import PUBLISHED_PROTOCOLS, REFERENCE_CATEGORIES


def gaps(expected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Keys with ``state``: met, missing or unexpected. Sets are compared, not counts."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    o = observed.select(*keys).distinct().withColumn("_o", F.lit(1))
    state = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("met")
    return e.join(o, list(keys), "full_outer").select(*keys, state.alias("state"))


#: Rows of a list that is repeated for every row of a table.
MOST_LISTED = 10_000


def short_list(df: DataFrame, most: int = MOST_LISTED) -> Column:
    """The distinct rows of a small table as a literal; raises if there are more than ``most``."""
    rows = df.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a list of over {most} rows")
    return F.from_json(F.lit(json.dumps(sorted((r.asDict() for r in rows), key=str))), ArrayType(df.schema))


#: Groups in which ``product`` numbers the rows of a table.
NUMBERED = 64


def product(df: DataFrame, other: DataFrame) -> DataFrame:
    """Each row of ``df`` with each distinct row of ``other``, at any size: rows are numbered and met by number, so it is a plain equi-join.

    ``other`` is numbered within ``NUMBERED`` groups of hashes; only the sizes of these groups are broadcast.
    """
    rows = other.distinct()
    numbered = rows.withColumn("_group", F.pmod(F.xxhash64(*rows.columns), F.lit(NUMBERED)).cast("int"))
    numbered = numbered.withColumn("_number", F.row_number().over(Window.partitionBy("_group").orderBy(*rows.columns)))
    sizes = numbered.groupBy("_group").agg(F.max("_number").alias("_size"))
    spread = df.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(NUMBERED - 1)))).join(F.broadcast(sizes), "_group")
    spread = spread.withColumn("_number", F.explode(F.sequence(F.lit(1), "_size"))).drop("_size")
    return spread.join(numbered, ["_group", "_number"]).drop("_group", "_number")


def grid(df: DataFrame, *lists: DataFrame) -> DataFrame:
    """Each row of ``df`` with each row of all lists: short ones as literals, without a join, longer ones by ``product``."""
    for rows in lists:
        if rows.distinct().limit(MOST_LISTED + 1).count() > MOST_LISTED:
            df = product(df, rows)
        else:
            df = df.select(*df.columns, F.explode(short_list(rows)).alias("_listed")).select(*df.columns, "_listed.*")
    return df


def model_pairs(models: DataFrame, *keys: str, order: list[str] | None = None) -> DataFrame:
    """All pairs of models that share the keys; ``models`` is small for each key.

    The first of a pair is the one whose name is smaller or, with ``order``, the one that comes first in that list; models outside it are left out.
    """
    place = F.col("model_id") if order is None else F.try_element_at(F.create_map(*(F.lit(x) for kv in reversed([*enumerate(order)]) for x in reversed(kv))), F.col("model_id"))
    a, b = (models.select(*keys, F.col("model_id").alias(f"model_{k}"), place.alias(f"_place_{k}")).distinct() for k in "ab")
    return a.join(b, list(keys)).where("_place_a < _place_b").drop("_place_a", "_place_b")


def answers(questions: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Each question with each answer (state met), and questions that a model of a run (``keys``) lacks (missing)."""
    asked = questions.select("question_id", "category").distinct()
    own = ["question_id", "model_id", *reversed(keys)]
    met = asked.join(found.drop("category"), "question_id").select(*own, "category", F.lit("met").alias("state"))
    expected = grid(found.select(*keys, "model_id").distinct(), asked)
    missing = expected.join(found, own, "left_anti").select(*own, "category", F.lit("missing").alias("state"))
    return met.unionByName(missing)


def paired_answers(questions: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Each question with ``seq`` of both answers, for all pairs of a run's models; missing if either side is."""
    asked = questions.select("question_id", "category").distinct()
    out = grid(model_pairs(found, *keys), asked)
    for k in "ab":
        side = found.select(*keys, "question_id", F.col("model_id").alias(f"model_{k}"), F.col("seq").alias(f"seq_{k}"))
        out = out.join(side, [*keys, "question_id", f"model_{k}"], "left")
    state = F.when(F.col("seq_a").isNull() | F.col("seq_b").isNull(), "missing").otherwise("met")
    return out.select(*keys, "question_id", "category", "model_a", "model_b", "seq_a", "seq_b", state.alias("state"))


def reference_ids(questions: DataFrame) -> DataFrame:
    """Questions of the reference categories, and whether they declare one and have one for turn 2."""
    return questions.where(F.col("category").isin(*REFERENCE_CATEGORIES)).select(
        "question_id", F.col("reference").isNotNull().alias("declared"), (F.col("reference").isNotNull() & has_reference(F.col("reference"), 1)).alias("usable")
    )


def resolve_references(questions: DataFrame, observed: DataFrame, selection: str = "auto", allow_partial: bool = False) -> DataFrame:
    """Ids that reference grading is expected for.

    ``observed`` has (model_id, question_id). Auto: no record means usable ids; otherwise all models
    must share one set, which is the declared or the usable one, or with ``allow_partial`` a part of the former.
    """
    from assayer.operators.gates import GateError, uniform_sets

    own = reference_ids(questions)
    declared, usable = own.where("declared").select("question_id"), own.where("usable").select("question_id")
    if selection in ("historical-declared", "usable-turn2"):
        return declared if selection == "historical-declared" else usable
    if selection != "auto":
        raise ValueError(f"unknown selection {selection}")
    ids = observed.select("question_id").distinct()
    if ids.isEmpty():
        return usable
    if not uniform_sets(observed, "model_id", "question_id").first()["uniform"]:
        raise GateError("models were graded on different sets of questions")
    flags = own.withColumnRenamed("question_id", "q").join(ids.withColumn("seen", F.lit(True)), F.col("q") == F.col("question_id"), "full_outer").agg(
        F.count_if(F.coalesce("declared", F.lit(False)) != F.coalesce("seen", F.lit(False))).alias("off_declared"),
        F.count_if(F.coalesce("usable", F.lit(False)) != F.coalesce("seen", F.lit(False))).alias("off_usable"),
        F.count_if(F.col("seen") & ~F.coalesce("declared", F.lit(False))).alias("outside"),
        F.count_if(F.col("seen") & F.col("declared") & ~F.col("usable")).alias("only_declared"),
    ).first()
    if not flags["off_declared"]:
        return declared
    if not flags["off_usable"]:
        return usable
    if allow_partial and not flags["outside"]:
        return declared if flags["only_declared"] else usable
    raise GateError("graded questions match neither set of references")


def align_three(original: DataFrame, translated: DataFrame, back: DataFrame) -> DataFrame:
    """(id, problems): ids and categories of three tables side by side."""
    named = [df.select("id", F.col("category").alias(f"c{k}")) for k, df in enumerate((original, translated, back))]
    joined = named[0].join(named[1], "id", "full_outer").join(named[2], "id", "full_outer")
    tests = {"original": F.col("c0").isNull(), "translated": F.col("c1").isNull(), "back": F.col("c2").isNull(), "category": (F.col("c0") != F.col("c1")) | (F.col("c0") != F.col("c2"))}
    return joined.select("id", F.concat_ws(",", *(F.when(t, F.lit(n)) for n, t in tests.items())).alias("problems"))


def manifest_diff(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of (path, digest) tables: ok, changed, missing or extra."""
    r, a = recorded.withColumnRenamed("digest", "_r"), actual.withColumnRenamed("digest", "_a")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_r").isNull(), "extra").when(F.col("_a") != F.col("_r"), "changed").otherwise("ok")
    return r.join(a, "path", "full_outer").select("path", state.alias("state"))


def published(path):
    """Whether a relative path is one that a release holds."""
    parts = F.split(path, "/")
    n, head, second, name = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    csv, jsonl = (F.endswith(name, F.lit(end)) & (F.length(name) > len(end)) for end in (".csv", ".jsonl"))
    in_lang = (
        F.when(n == 2, second == "questions.jsonl")
        .when(second == "answers", (n == 3) & jsonl)
        .when(second == "judgments", (n == 6) & F.get(parts, F.lit(4)).isin(*PUBLISHED_PROTOCOLS) & jsonl)
        .otherwise(False)
    )
    return F.when(n < 2, False).when(head.isin("results", "translation_review"), (n == 2) & csv).when(head.isin("en", "ko"), in_lang).otherwise(False)


def require_met(states: DataFrame, what: str, allow_partial: bool = False) -> dict[str, int]:
    """Numbers of met, missing and unexpected units of a table of ``gaps``; raises if any is not met, unless partial work is allowed."""
    from assayer.operators.gates import GateError

    counted = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}  # three rows at most
    found = {s: counted.get(s, 0) for s in ("met", "missing", "unexpected")}
    if (found["missing"] or found["unexpected"]) and not allow_partial:
        some = [r.asDict() for r in states.where("state <> 'met'").orderBy(*states.columns).limit(10).collect()]
        raise GateError(f"{what}: {found['missing']} missing, {found['unexpected']} unexpected, such as {some}")
    return found


def single_gaps(records: DataFrame, questions: DataFrame, models: DataFrame, *by: str) -> DataFrame:
    """(by, model_id, question_id, state): in every group, every model has every question and no other."""
    asked, named = questions.select("question_id").distinct(), models.select("model_id").distinct()
    expected = grid(records.select(*by).distinct() if by else _one(records), named, asked)
    return gaps(expected, records.join(named, "model_id", "left_semi"), *by, "model_id", "question_id")


def pair_gaps(records: DataFrame, questions: DataFrame, models: DataFrame, *by: str) -> DataFrame:
    """(by, model_a, model_b, question_id, turn, state) in order of names: in every group all pairs of these models, all questions, turn 2."""
    asked, named = questions.select("question_id").distinct(), models.select("model_id").distinct()
    sides = [named.select(F.col("model_id").alias(f"model_{k}")) for k in "ab"]
    expected = grid(records.select(*by).distinct() if by else _one(records), *sides, asked).where("model_a < model_b").withColumn("turn", F.lit(2))
    of = records
    for side in sides:
        of = of.join(side, side.columns, "left_semi")
    observed = of.select(*by, F.least("model_a", "model_b").alias("model_a"), F.greatest("model_a", "model_b").alias("model_b"), "question_id", "turn")
    return gaps(expected, observed, *by, "model_a", "model_b", "question_id", "turn")


def _one(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select()
