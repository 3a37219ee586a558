"""Upserts and incremental work: what is current, what is pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.verdicts import has_text, resolve_winner, stored_score
from assayer.operators import published
from assayer.operators.dedup import newest
from assayer.schemas import VERDICTS


def upsert(existing: DataFrame, new: DataFrame, *keys: str, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` in place of existing ones with the same keys.

    Of rows of ``new`` with the same keys the first in ``order`` stays (the one with the largest hash, if it is not said).
    """
    once = newest(new, [F.col(k) for k in keys], order or [F.xxhash64(*new.columns).desc()])
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").select(existing.columns).unionByName(once)


def upsert_published(new: DataFrame, path: str, *keys: str, order: list[Column] | None = None, fmt: str = "parquet") -> None:
    """Upserts into a published table; any number of writers may do so at the same time, and no row is lost.

    A writer that comes second reads ``new`` again, so it must give the same rows each time.
    """

    def change(now: DataFrame | None) -> DataFrame:
        return upsert(new.limit(0) if now is None else now, new, *keys, order=order)

    published.update(new.sparkSession, path, change, fmt, sort_within=keys)


def single_is_current(prefix: str = "") -> Column:
    """Scores valid and texts there, as a resumed run demands."""
    c = lambda n: F.col(prefix + n)
    return stored_score(c("score_turn1")) & stored_score(c("score_turn2")) & has_text(c("judgment_turn1")) & has_text(c("judgment_turn2"))


def reference_single_is_current(prefix: str = "") -> Column:
    """The first turn is not graded: score -1 and an empty text."""
    c = lambda n: F.col(prefix + n)
    return (c("score_turn1") == -1) & (c("judgment_turn1") == "") & stored_score(c("score_turn2")) & has_text(c("judgment_turn2"))


def pairwise_is_current(prefix: str = "") -> Column:
    """Known verdicts, the winner they give, turn 2 and both texts. Holds for pairs with references too."""
    c = lambda n: F.col(prefix + n)
    ab, ba = c("winner_ab"), c("winner_ba")
    resolved = c("winner") == resolve_winner(ab, ba, c("model_a"), c("model_b"))
    return ab.isin(*VERDICTS) & ba.isin(*VERDICTS) & resolved & (c("turn") == 2) & has_text(c("judgment_ab")) & has_text(c("judgment_ba"))


def answer_is_current(prefix: str = "") -> Column:
    """One choice of index 0 with two turns of text."""
    choices = F.col(prefix + "choices")
    turns = F.get(choices, F.lit(0))["turns"]
    return (F.size(choices) == 1) & (F.get(choices, F.lit(0))["index"] == 0) & (F.size(turns) == 2) & F.forall(turns, has_text)


def translation_is_current(prefix: str = "") -> Column:
    """Two turns with text."""
    turns = F.col(f"{prefix}turns")
    return (F.size(turns) == 2) & F.forall(turns, has_text)


def validity_is_current(prefix: str = "") -> Column:
    """A verdict for each of two turns, both read strictly or left out on purpose, and a BLEU of each."""
    turns, left_out = F.col(f"{prefix}turns"), F.col(f"{prefix}mode") == "bleu_only"
    read = F.forall(turns, lambda t: F.coalesce((F.startswith(t["parse_status"], F.lit("ok")) | left_out) & t["bleu"].between(0, 1), F.lit(False)))
    return (F.size(turns) == 2) & read


def current(existing: DataFrame, expected: DataFrame, keys: list[str], valid: Column, hash_column: str = "input_sha256") -> DataFrame:
    """Existing records of expected units whose inputs have not changed and whose contents are whole."""
    return existing.where(F.coalesce(valid, F.lit(False))).join(expected.select(*keys, hash_column).distinct(), [*keys, hash_column], "left_semi")


def pending(existing: DataFrame, expected: DataFrame, keys: list[str], valid: Column, hash_column: str = "input_sha256") -> DataFrame:
    return expected.join(current(existing, expected, keys, valid, hash_column).select(*keys), keys, "left_anti")


def processed_inputs(df: DataFrame, key: str, seq: str = "seq", hash_column: str = "input_sha256") -> DataFrame:
    """The last non-empty input hash of each key."""
    return newest(df.where(F.length(hash_column) > 0), [F.col(key)], [F.col(seq).desc()]).select(key, hash_column)


def prune_orphans(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return df.join(source.select(key).distinct(), key, "left_semi")


def incomplete(key: str, **parts: DataFrame) -> DataFrame:
    """(key, why): every unit that is missing, failed or invalid, once, with all its reasons."""
    flags = [df.select(key).distinct().withColumn("_why", F.lit(name)) for name, df in parts.items()]
    union = flags[0]
    for f in flags[1:]:
        union = union.unionByName(f)
    why = F.concat_ws(",", *(F.max(F.when(F.col("_why") == name, F.lit(name))) for name in parts))
    return union.groupBy(key).agg(why.alias("why"))
