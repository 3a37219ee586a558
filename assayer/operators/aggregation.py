"""The whole aggregation of a judge's records: strict coverage first, then scores, win rates and reference scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import coverage, dedup, metrics
from assayer.operators.gates import require_none, several_judges


@dataclass(frozen=True)
class Scores:
    single: DataFrame
    win_rates: DataFrame
    reference: DataFrame


def aggregate(
    single: DataFrame, pairwise: DataFrame, reference: DataFrame, questions: DataFrame | None = None, models: list[str] | None = None,
    selection: str = "auto", allow_partial: bool = False,
) -> Scores:
    """Scores of one judge in one language, of ``models`` or of those that ``single`` names.

    With ``questions``, every model must have every question once, every pair of models too, and every model
    the selected reference questions; what is missing or unexpected raises ``GateError``, unless ``allow_partial``.
    Without, as many samples are expected as there are, and there is no coverage.
    """
    for df, name in ((single, "single"), (pairwise, "pairwise"), (reference, "reference")):
        require_none(several_judges(df.withColumn("_all", F.lit(name)), "_all"), f"multiple judge_id in {name} records")
    s, p, r = dedup.single(single), dedup.pairwise(pairwise), dedup.single(reference)
    spark = single.sparkSession
    named = spark.createDataFrame([(m,) for m in models], "model_id string") if models is not None else s.select("model_id").distinct()
    asked = expected = None
    if questions is not None:
        selected = coverage.resolve_references(questions, r.join(named, "model_id", "left_semi"), selection, allow_partial)
        for states, what in (
            (coverage.single_gaps(s, questions, named), "single records"), (coverage.pair_gaps(p, questions, named), "pairwise records"),
            (coverage.single_gaps(r, selected, named), "reference records"),
        ):
            coverage.require_met(states, what, allow_partial)
        asked, expected = questions.select("question_id").distinct().count(), selected.distinct().count()
    s, r = (df.join(named, "model_id", "left_semi") for df in (s, r))
    return Scores(
        metrics.single_scores(s, ["model_id"], asked),
        metrics.win_rates(p, [], asked, named),
        metrics.reference_scores(r, ["model_id"], expected),
    )
