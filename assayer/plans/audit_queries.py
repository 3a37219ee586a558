"""Queries of translation runs, audits of cells, large grids and pairs in list order, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fingerprints
from assayer.operators import audit, coverage, metrics, release, resume, translation, validity
from assayer.plans.carriers import oracle
from assayer.plans.queries import BY, PAIRS, SINGLE, TURNS
from assayer.plans.registry import Tables, query

BACKEND = fingerprints.identity("test", "http://localhost")


# Translations, one of each conversation.
def _questions(t: Tables) -> DataFrame:
    k = F.col("id")
    reference = F.when(k % 3 == 0, F.array("a1", "a2"))
    return t["qa"].select(k.alias("question_id"), F.concat(F.lit("c"), (k % 8).cast("string")).alias("category"), F.array("q1", "q2").alias("turns"), reference.alias("reference"), "a1", "a2")


SOURCE = "sha256(CAST(to_json({'category': category, 'question_id': id, 'reference': CASE WHEN id % 3 = 0 THEN [a1, a2] END, 'turns': [q1, q2]}) AS VARCHAR))"


@query(
    "translation_pending",
    oracle(
        f"""SELECT id AS question_id, {SOURCE} AS source_sha256 FROM (SELECT *, 'c' || CAST(id % 8 AS VARCHAR) AS category FROM qa)
        WHERE id % 4 = 0 OR id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0 OR coalesce(length(trim(a1)), 0) = 0 OR coalesce(length(trim(a2)), 0) = 0""",
        "qa",
    ),
)
def _(t):
    """Translations that are missing, of another source or prompt, of a mock run, or without two turns of text."""
    q, k = _questions(t), F.col("question_id")
    units = translation.units(q, BACKEND)
    had = units.join(q.select("question_id", F.array("a1", "a2").alias("_back")), "question_id").where(k % 4 != 0).withColumns({
        "turns": F.col("_back"), "source_sha256": F.when(k % 5 == 0, "older").otherwise(F.col("source_sha256")),
        "prompt_sha256": F.when(k % 7 == 0, "other").otherwise(F.col("prompt_sha256")), "mode": F.when(k % 11 == 0, translation.MOCK).otherwise(F.col("mode")),
    })
    return resume.pending_units(had, units, resume.TRANSLATION).select("question_id", "source_sha256")


def _said(n: int) -> Column:
    k = F.col("question_id")
    body = F.format_string(
        '{"semantic_preservation": %d, "difficulty_preservation": %d, "constraint_preservation": 5, "overall_score": %d, "issue_summary": "s", "needs_manual_check": false}',
        1 + (k + n) % 5, 1 + (k + 2 * n) % 4, 1 + (k % 7 + n) % 5,
    )
    return F.when(k % 9 == n, "no verdict").otherwise(body)


def _scored(t: Tables) -> DataFrame:
    """Both turns' answers read strictly; ninths of them are no verdict."""
    q, k = _questions(t), F.col("question_id")
    for n in (1, 2):
        q = q.withColumn(f"_v{n}", validity.parse_verdict(_said(n)))
    fields = [f.split(" ")[0] for f in validity.VERDICT.split(", ")]
    turns = F.array(*(F.struct(F.lit(n).alias("turn"), ((k * n) % 9 / F.lit(8.0)).alias("bleu"), *(F.col(f"_v{n}.{f}").alias(f) for f in fields)) for n in (1, 2)))
    return q.select("question_id", "category", turns.alias("turns"))


VERDICTS = "SELECT id, 'c' || CAST(id % 8 AS VARCHAR) AS category, (id % 9) / 8.0::DOUBLE AS b1, (2 * id % 9) / 8.0::DOUBLE AS b2, " + ", ".join(
    f"id % 9 <> {n} AS ok{n}, CASE WHEN id % 9 = {n} THEN -1 ELSE 1 + (id + {n}) % 5 END AS s{n}, CASE WHEN id % 9 = {n} THEN -1 ELSE 1 + (id + {2 * n}) % 4 END AS d{n}, "
    f"CASE WHEN id % 9 = {n} THEN -1 ELSE 5 END AS c{n}, CASE WHEN id % 9 = {n} THEN -1 ELSE 1 + (id % 7 + {n}) % 5 END AS o{n}"
    for n in (1, 2)
) + " FROM qa"
MEAN = "round(CASE WHEN {0}1 > 0 AND {0}2 > 0 THEN ({0}1 + {0}2) / 2 WHEN {0}1 > 0 THEN {0}1 WHEN {0}2 > 0 THEN {0}2 END::DOUBLE, 2)"
ITEMS = f"""SELECT id AS question_id, category, round((b1 + b2) / 2, 4) AS bleu_avg, {', '.join(f'{MEAN.format(d[0])} AS {d}_avg' for d in translation.DIMENSIONS)},
NOT ok1 OR NOT ok2 OR least(s1, d1, c1, o1) <= 3 OR least(s2, d2, c2, o2) <= 3 AS needs_manual_check FROM verdicts"""


@query("translation_items", oracle("SELECT * FROM items", "qa", verdicts=VERDICTS, items=ITEMS))
def _(t):
    """The table of items that a scoring run ends in."""
    out = translation.items(_scored(t))
    return out.select("question_id", "category", "bleu_avg", *(f"{d}_avg" for d in translation.DIMENSIONS), "needs_manual_check")


@query(
    "translation_categories",
    oracle(
        f"SELECT category, count(*) AS n, avg(bleu_avg) AS bleu_mean, {', '.join(f'avg({d}_avg) AS {d}_mean' for d in translation.DIMENSIONS)}, count_if(needs_manual_check)::BIGINT AS needs_manual_check_count FROM items GROUP BY ROLLUP (category)",
        "qa", verdicts=VERDICTS, items=ITEMS,
    ),
)
def _(t):
    return translation.categories(translation.items(_scored(t)))


OTHER = """SELECT id, CASE WHEN id % 11 = 0 THEN 'other' ELSE category END AS category, CASE WHEN id % 13 = 0 THEN 1 ELSE 2 END AS turns, id % 6 <> 0 AS korean,
CASE WHEN id % 3 <> 0 OR id % 5 = 0 THEN 0 WHEN id % 2 = 0 THEN 1 ELSE 2 END AS refs FROM asked WHERE id % 10 <> 0 UNION ALL SELECT -1 - id, 'c0', 2, true, 0 FROM asked WHERE id % 14 = 0
UNION ALL SELECT id, category, 2, true, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END FROM asked WHERE id % 17 = 3"""


@query(
    "translation_faults_all",
    oracle(
        """SELECT DISTINCT id AS question_id, severity, fault FROM (SELECT id, 'error' AS severity, 'repeated' AS fault FROM t GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT id, 'error', 'missing' FROM asked WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT id, 'warning', 'unexpected' FROM t WHERE id NOT IN (SELECT id FROM asked)
        UNION ALL SELECT id, 'error', 'category' FROM t JOIN asked a USING (id) WHERE t.category <> a.category UNION ALL SELECT id, 'error', 'turns' FROM t JOIN asked a USING (id) WHERE turns <> 2
        UNION ALL SELECT id, 'warning', 'script' FROM t JOIN asked a USING (id) WHERE turns = 2 AND NOT korean
        UNION ALL SELECT id, 'warning', 'reference missing' FROM t JOIN asked a USING (id) WHERE turns = 2 AND id % 3 = 0 AND refs = 0
        UNION ALL SELECT id, 'error', 'reference count' FROM t JOIN asked a USING (id) WHERE turns = 2 AND id % 3 = 0 AND refs = 1)""",
        "qa", asked="SELECT id, 'c' || CAST(id % 8 AS VARCHAR) AS category FROM qa", t=OTHER,
    ),
)
def _(t):
    """Every conversation as a question, and a translation of the whole table with faults."""
    k, slot, ask = F.col("question_id"), F.lit("r"), F.lit("물음")
    two = F.array(ask, ask)
    original = _questions(t).select("question_id", "category", F.array(F.lit("one"), F.lit("two")).alias("turns"), F.when(k % 3 == 0, F.array(slot, slot)).alias("reference"))
    korean = F.when(k % 6 != 0, ask).otherwise("no")
    other = original.where(k % 10 != 0).select(
        "question_id", F.when(k % 11 == 0, "other").otherwise(F.col("category")).alias("category"), F.when(k % 13 == 0, F.array(korean)).otherwise(F.array(korean, ask)).alias("turns"),
        F.when((k % 3 == 0) & (k % 5 != 0), F.when(k % 2 == 0, F.array(slot)).otherwise(F.array(slot, slot))).alias("reference"),
    )
    more = original.where(k % 14 == 0).select((-1 - k).alias("question_id"), F.lit("c0").alias("category"), two.alias("turns"), F.lit(None).cast("array<string>").alias("reference"))
    again = original.where(k % 17 == 3).withColumn("turns", two)
    return release.translation_faults(original, other.unionByName(more).unionByName(again))


# Cells.
CELLS = "SELECT lang || '/' || judge_id || '/' || model_id AS row, model_id, avg(score) AS overall, count(score) AS n_samples FROM turns GROUP BY lang, judge_id, model_id"


@query(
    "cell_audit",
    oracle(
        """SELECT 'scores' AS "table", NULL::VARCHAR AS row, 'judge' AS "column", 'column added' AS fault UNION ALL SELECT 'scores', NULL, 'note', 'column missing'
        UNION ALL SELECT 'scores', row, NULL, 'row missing' FROM c WHERE model_id = 'm5' UNION ALL SELECT 'scores', row, NULL, 'row added' FROM c WHERE model_id = 'm4'
        UNION ALL SELECT 'scores', row, 'overall', 'changed' FROM c WHERE model_id = 'm3' UNION ALL SELECT 'scores', row, 'n_samples', 'changed' FROM c WHERE model_id = 'm2'""",
        "j_single", latest=SINGLE, turns=TURNS, c=CELLS,
    ),
)
def _(t):
    """A recorded table of scores against the recomputed one: changed cells, lost and added rows and columns; small differences pass."""
    own, m = metrics.single_scores(t.single, BY, 80).select(*BY, "overall", "n_samples"), F.col("model_id")
    recorded = own.where(m != "m4").select(
        *BY, F.format_number(F.when(m == "m3", F.col("overall") + 1).otherwise(F.col("overall")), 4).alias("overall"),
        F.when(m == "m2", F.col("n_samples") + 1).otherwise(F.col("n_samples")).cast("string").alias("n_samples"), F.lit("n").alias("note"),
    )
    sides = audit.cells(recorded, BY, "scores"), audit.cells(own.where(m != "m5").withColumn("judge", F.col("judge_id")), BY, "scores")
    return audit.audit_cells(*sides, within=0.0001).select("table", "row", "column", "fault")


# Grids and pairs.
@query(
    "grid_gaps",
    oracle(
        """SELECT model_id, CASE WHEN o.seen THEN 'met' ELSE 'missing' END AS state, count(*) AS n FROM (SELECT conv_id, model_id FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT DISTINCT model_id FROM j_single)) e
        LEFT JOIN (SELECT DISTINCT seq AS conv_id, model_id, true AS seen FROM j_single) o USING (conv_id, model_id) GROUP BY ALL""",
        "j_single",
    ),
)
def _(t):
    """Every conversation for every model, whatever their numbers, against those that records name."""
    asked, models = t.raw("conversations").select("conv_id").distinct(), t["j_single"].select("model_id").distinct()
    expected = coverage.product(models, asked)
    states = coverage.gaps(expected, t["j_single"].select(F.col("seq").alias("conv_id"), "model_id").join(asked, "conv_id", "left_semi"), "model_id", "conv_id")
    return states.groupBy("model_id", "state").agg(F.count("*").alias("n"))


LISTED = ["m4", "m0", "m5", "m1"]


@query(
    "model_pairs_listed",
    oracle(
        "SELECT DISTINCT a.lang, a.question_id, a.model_id AS model_a, b.model_id AS model_b FROM m a JOIN m b ON a.lang = b.lang AND a.question_id = b.question_id AND a.p < b.p",
        "j_single", m="SELECT DISTINCT lang, question_id, model_id, list_position(['m4', 'm0', 'm5', 'm1'], model_id) AS p FROM j_single WHERE model_id IN ('m4', 'm0', 'm5', 'm1')",
    ),
)
def _(t):
    """Pairs whose first model is the one that comes first in a list."""
    return coverage.model_pairs(t["j_single"], "lang", "question_id", order=LISTED)


@query(
    "pairwise_turned",
    oracle(
        """SELECT seq, greatest(model_a, model_b) AS model_a, least(model_a, model_b) AS model_b, CASE WHEN model_a < model_b THEN judgment_ba ELSE judgment_ab END AS judgment_ab,
        CASE WHEN model_a < model_b THEN winner_ba ELSE winner_ab END AS winner_ab, CASE WHEN model_a < model_b THEN winner_ab ELSE winner_ba END AS winner_ba, winner, 'new' AS input_sha256
        FROM latest WHERE model_a <> model_b""",
        "j_pair", latest=PAIRS,
    ),
)
def _(t):
    """Records of either order, as units with the larger name first have them."""
    pairs = t.pairs.where("model_a <> model_b").withColumn("judge_id", F.concat_ws("/", "judge_id", "lang", "seq"))
    pairs = pairs.withColumn("input_sha256", F.when(F.col("model_a") > F.col("model_b"), "new").otherwise("old"))
    units = pairs.select("question_id", F.greatest("model_a", "model_b").alias("model_a"), F.least("model_a", "model_b").alias("model_b"), "judge_id", F.lit("new").alias("input_sha256"), F.lit("old").alias("turned_sha256"))
    turned = resume.in_order_of_units(pairs, units)
    return turned.select("seq", "model_a", "model_b", "judgment_ab", "winner_ab", "winner_ba", "winner", "input_sha256")
