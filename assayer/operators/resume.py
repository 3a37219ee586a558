"""Runs that can be taken up again: stale records go, pending units are called, valid results are published.

A run has expected units (keys, category, ``input_sha256`` and whatever its call needs), a rule for a whole record, and a call
that turns pending units into records with an ``error``. All pairs, models or languages of a protocol are one run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import published
from assayer.operators.dedup import newest
from assayer.operators.journal import Journal
from assayer.operators.merge import (
    answer_is_current, current, pairwise_is_current, reference_single_is_current, single_is_current, translation_is_current, upsert, validity_is_current,
)


class IncompleteRun(RuntimeError):
    """Some units are missing, failed or invalid; the valid records were published before."""


@dataclass(frozen=True)
class Protocol:
    """``keys``: what names a unit; all of them, ``match`` and the input hash must be those of the expected unit."""

    keys: tuple[str, ...]
    match: tuple[str, ...]
    whole: Callable[[], Column]
    #: Records as the expected units have them, where records of another form hold the same answers.
    turned: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def in_order_of_units(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Pairwise records in the order of the expected pairs: (b, a) holds the same two answers as (a, b), with sides exchanged.

    A record is turned round if its pair is expected the other way and its input hash is that of the turned unit.
    """
    if "turned_sha256" not in expected.columns:
        return records
    swap = {f"{c}_{a}": f"{c}_{b}" for c in ("model", "judgment", "winner") for a, b in (("a", "b"), ("b", "a"), ("ab", "ba"), ("ba", "ab"))}
    units = expected.select("question_id", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), "judge_id", F.col("turned_sha256").alias("input_sha256"), F.col("input_sha256").alias("_as"))
    found = records.join(units, ["question_id", "model_a", "model_b", "judge_id", "input_sha256"], "left")
    turned = F.col("_as").isNotNull()
    columns = {c: F.when(turned, F.col(swap[c])).otherwise(F.col(c)) for c in records.columns if c in swap} | {"input_sha256": F.coalesce("_as", "input_sha256")}
    return found.select(*(columns.get(c, F.col(c)).alias(c) for c in records.columns))


GENERATION = Protocol(("question_id", "model_id"), (), answer_is_current)
SINGLE = Protocol(("question_id", "model_id", "judge_id"), ("category",), single_is_current)
REFERENCE_SINGLE = Protocol(("question_id", "model_id", "judge_id"), ("category",), reference_single_is_current)
PAIRWISE = Protocol(("question_id", "model_a", "model_b", "judge_id"), ("category",), pairwise_is_current, in_order_of_units)
TRANSLATION = Protocol(("question_id",), ("category", "source_sha256", "prompt_sha256", "mode"), translation_is_current)
VALIDITY = Protocol(("question_id",), ("category", "source_sha256", "back_sha256", "mode"), validity_is_current)


def still_current(records: DataFrame, expected: DataFrame, protocol: Protocol) -> DataFrame:
    """Records of expected units, made from the same inputs, whole and of the same category."""
    return current(records, expected, [*protocol.keys, *protocol.match], protocol.whole())


def pending_units(records: DataFrame, expected: DataFrame, protocol: Protocol) -> DataFrame:
    return expected.join(still_current(records, expected, protocol).select(*protocol.keys), list(protocol.keys), "left_anti")


def incomplete_units(final: DataFrame, expected: DataFrame, protocol: Protocol, missing: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(keys, why): missing inputs, failed calls, and units without a valid record; each unit once, reasons in this order."""
    keys = list(protocol.keys)
    invalid = pending_units(final, expected, protocol)
    parts = {"missing": missing, "failed": failed, "invalid": invalid}
    flagged = [df.select(*keys, F.lit(name).alias("_why")) for name, df in parts.items() if df is not None]
    union = flagged[0]
    for more in flagged[1:]:
        union = union.unionByName(more)
    why = F.concat_ws(",", *(F.max(F.when(F.col("_why") == name, F.lit(name))) for name in parts))
    return union.groupBy(*keys).agg(why.alias("why"))


def run(
    spark: SparkSession, path: str, expected: DataFrame, protocol: Protocol, call: Callable[[DataFrame, Journal], DataFrame], schema: str,
    missing: DataFrame | None = None, resume: bool = True, allow_partial: bool = False, staged: bool = False,
) -> DataFrame:
    """Brings the published table ``path`` up to date and returns it.

    ``call`` gives records with the columns of ``schema`` and ``error`` for pending units; it passes the journal on to the
    calls it makes, which keeps each answer as it comes. A run that is killed, at whatever point, and taken up again
    makes no call whose answer it had. The journal goes when the run has come to its end: what is then without
    a valid record is called anew by the next run. ``resume=False`` starts from nothing.

    Stale records are gone even if every call fails. ``missing`` holds units whose inputs are not there. Raises
    ``IncompleteRun`` after publishing, unless ``allow_partial``. A ``staged`` run works on a table of its own, ``path``.stage, which takes the
    place of the old one only when all units are complete; until then the old one stays as it was.
    """
    keys = list(protocol.keys)
    columns = spark.createDataFrame([], schema).columns
    work = f"{path}.stage" if staged else path
    journal = Journal(f"{path}.journal", (*keys, "input_sha256"))
    if not resume:
        journal.clear(spark)
        if staged:
            remove(spark, work)
    source = next((at for at in (work, path) if resume and published.exists(spark, at)), None)
    had = published.read(spark, source, "parquet", schema) if source else spark.createDataFrame([], schema)
    if protocol.turned:
        had = protocol.turned(had, expected)
    kept = still_current(_last_read(had, keys), expected, protocol).select(columns)
    published.publish(kept, work, "parquet", tuple(keys))
    kept = published.read(spark, work, "parquet", schema)
    calls = f"{path}.calls"
    called = call(pending_units(kept, expected, protocol), journal).select(*columns, "error")
    published.publish(called, calls, "parquet")
    called = published.read(spark, calls, "parquet", f"{schema}, error string")
    fresh = still_current(_last_read(called.where("error is null").select(columns), keys), expected, protocol).select(columns)
    published.publish(upsert(kept, fresh, *keys), work, "parquet", tuple(keys))
    final = published.read(spark, work, "parquet", schema)
    left = incomplete_units(final, expected, protocol, missing, called.where("error is not null"))
    some = left.orderBy(*keys).limit(20).collect()
    if staged and not some:
        published.publish(final, path, "parquet", tuple(keys))
        final = published.read(spark, path, "parquet", schema)
        remove(spark, work)
    journal.clear(spark)
    if some and not allow_partial:
        raise IncompleteRun(f"{left.count()} units are incomplete, such as {[r.asDict() for r in some]}; valid records were kept")
    return final


def remove(spark: SparkSession, path: str) -> None:
    fs, at = published.file_system(spark, path)
    fs.delete(at, True)


def _last_read(records: DataFrame, keys: list[str]) -> DataFrame:
    """Of records with the same keys the newest; of equal or no times the one with the largest hash, so that runs repeat."""
    return newest(records, [F.col(k) for k in keys], [F.col("tstamp").desc_nulls_last(), F.xxhash64(*records.columns).desc()])
