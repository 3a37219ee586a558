"""Queries of resumed runs, strict coverage, releases and translations, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import fingerprints, prompts, text
from assayer.operators import coverage, merge, metrics, protocols, release, resume
from assayer.plans.carriers import oracle
from assayer.plans.queries import BLOCK, CALLS, FAILURES, PAIRS, SINGLE, TRANSCRIPT
from assayer.plans.registry import Tables, query

BACKEND = fingerprints.identity("mock", None, True)
MODELS = ["m0", "m1", "m2", "m3", "m4", "m5"]

# Hashes of inputs.
SYSTEM = f"CASE WHEN lang = 'ko' THEN '{prompts.RATE['ko']}' ELSE '{prompts.RATE['en']}' END"
MESSAGES = "[{{'role': 'system', 'content': {0}}}, {{'role': 'user', 'content': {1}}}]"
USER1 = f"concat_ws(chr(10) || chr(10), {BLOCK.format('question', 'q1')}, {BLOCK.format('answer', 'a1')})"


@query(
    "input_hashes",
    oracle(
        f"""SELECT id, sha256(CAST(to_json({{'backend': '{BACKEND}', 'category': category, 'max_tokens': 1024, 'model': 'm0', 'protocol': 'generation/2', 'question_id': id, 'system': NULL::VARCHAR, 'temperature': 0.7::DOUBLE, 'turns': [q1, q2]}}) AS VARCHAR)) AS generation,
        sha256(CAST(to_json({{'backend': '{BACKEND}', 'category': category, 'judge': 'j', 'protocol': 'single/1', 'question_id': id, 'turn1': {MESSAGES.format(SYSTEM, USER1)}, 'turn2': {MESSAGES.format(SYSTEM, TRANSCRIPT)}}}) AS VARCHAR)) AS single,
        sha256(CAST(to_json({{'category': category, 'question_id': id, 'reference': CASE WHEN id % 3 = 0 THEN [a1, a2] END, 'turns': [q1, q2]}}) AS VARCHAR)) AS source
        FROM (SELECT *, 'c' || CAST(id % 8 AS VARCHAR) AS category FROM qa)""",
        "qa",
    ),
)
def _(t):
    i, q1, a1, q2, a2, lang = map(F.col, ("id", "q1", "a1", "q2", "a2", "lang"))
    category = F.concat(F.lit("c"), (i % 8).cast("string"))
    turns = F.array(q1, q2)
    return t["qa"].select(
        "id",
        fingerprints.generation(i, category, turns, F.lit("m0"), BACKEND).alias("generation"),
        fingerprints.single(i, category, F.lit("j"), BACKEND, prompts.single(q1, a1, lang), prompts.multi_single(q1, a1, q2, a2, lang)).alias("single"),
        fingerprints.translation_source(i, category, turns, F.when(i % 3 == 0, F.array(a1, a2))).alias("source"),
    )


# What a resumed run still has to do.
ODD_PAIRS = """SELECT * REPLACE (CASE WHEN seq % 19 = 0 THEN 'tie' ELSE winner END AS winner, CASE WHEN seq % 23 = 0 THEN 1 ELSE turn END AS turn, CASE WHEN seq % 13 = 0 THEN ' ' ELSE judgment_ba END AS judgment_ba),
'h' || CAST(seq % 4 AS VARCHAR) AS input_sha256 FROM latest"""


def _odd_pairs(t: Tables) -> DataFrame:
    k = F.col("seq")
    return t.pairs.withColumns({
        "winner": F.when(k % 19 == 0, "tie").otherwise(F.col("winner")), "turn": F.when(k % 23 == 0, 1).otherwise(F.col("turn")),
        "judgment_ba": F.when(k % 13 == 0, " ").otherwise(F.col("judgment_ba")), "input_sha256": F.concat(F.lit("h"), (k % 4).cast("string")),
    })


@query(
    "pairwise_pending",
    oracle(
        """SELECT DISTINCT lang, judge_id, model_a, model_b, question_id FROM odd u WHERE NOT EXISTS (SELECT 1 FROM odd o WHERE o.lang = u.lang AND o.judge_id = u.judge_id AND o.model_a = u.model_a
        AND o.model_b = u.model_b AND o.question_id = u.question_id AND o.input_sha256 <> 'h3' AND o.turn = 2 AND length(trim(o.judgment_ab)) > 0 AND length(trim(o.judgment_ba)) > 0 AND o.winner = CASE
        WHEN o.winner_ab = 'error' OR o.winner_ba = 'error' THEN 'error' WHEN o.winner_ab = 'A' AND o.winner_ba = 'B' THEN o.model_a WHEN o.winner_ab = 'B' AND o.winner_ba = 'A' THEN o.model_b
        WHEN o.winner_ab = 'tie' AND o.winner_ba = 'tie' THEN 'tie' ELSE 'inconsistent' END)""",
        "j_pair", latest=PAIRS, odd=ODD_PAIRS,
    ),
)
def _(t):
    """Pairs whose inputs changed, or whose record has another winner, turn or an empty text."""
    keys = ["lang", "judge_id", "model_a", "model_b", "question_id"]
    odd = _odd_pairs(t)
    expected = odd.select(*keys, F.when(F.col("input_sha256") == "h3", "new").otherwise(F.col("input_sha256")).alias("input_sha256")).distinct()
    return merge.pending(odd, expected, keys, merge.pairwise_is_current()).select(*keys).distinct()


@query(
    "reference_pending",
    oracle(
        """SELECT lang, judge_id, model_id, question_id FROM latest WHERE category IN ('math', 'reasoning', 'coding') AND NOT (input_sha256 = 'h1' AND length(trim(judgment_turn2)) > 0
        AND seq % 5 <> 0 AND seq % 7 <> 0 AND (score_turn2 = -1 OR score_turn2 BETWEEN 1 AND 10))""",
        "j_single", latest=SINGLE,
    ),
)
def _(t):
    """Reference grades: the first turn must have score -1 and no text."""
    keys, k = ["lang", "judge_id", "model_id", "question_id"], F.col("seq")
    rows = t.single.where(F.col("category").isin("math", "reasoning", "coding"))
    rows = rows.withColumns({"score_turn1": F.when(k % 5 == 0, 3.0).otherwise(-1.0), "judgment_turn1": F.when(k % 7 == 0, "text").otherwise("")})
    return merge.pending(rows, rows.select(*keys).withColumn("input_sha256", F.lit("h1")), keys, merge.reference_single_is_current()).select(*keys)


@query(
    "incomplete_units",
    oracle(
        """SELECT question_id, model_id, judge_id, concat_ws(',', CASE WHEN bool_or(w = 1) THEN 'missing' END, CASE WHEN bool_or(w = 2) THEN 'failed' END, CASE WHEN bool_or(w = 3) THEN 'invalid' END) AS why FROM (
        SELECT question_id, model_id, judge_id || '/' || lang AS judge_id, 1 AS w FROM latest WHERE seq % 6 = 0 UNION ALL SELECT question_id, model_id, judge_id || '/' || lang, 2 FROM latest WHERE seq % 10 = 0
        UNION ALL SELECT question_id, model_id, judge_id || '/' || lang, 3 FROM latest WHERE NOT (input_sha256 = 'h1' AND length(trim(judgment_turn1)) > 0 AND length(trim(judgment_turn2)) > 0)) GROUP BY question_id, model_id, judge_id""",
        "j_single", latest=SINGLE,
    ),
)
def _(t):
    """A run's units without a valid record, with all reasons; a unit is a question, a model and a judge of one language."""
    rows = t.single.withColumn("judge_id", F.concat_ws("/", "judge_id", "lang"))
    expected = rows.withColumn("input_sha256", F.lit("h1"))
    return resume.incomplete_units(rows, expected, resume.SINGLE, rows.where("seq % 6 = 0"), rows.where("seq % 10 = 0"))


# Strict coverage.
WANTED = "SELECT question_id FROM questions WHERE question_id <> 100 UNION ALL SELECT unnest([201, 202])"


def _wanted(t: Tables) -> DataFrame:
    more = t.spark.range(201, 203).select(F.col("id").alias("question_id"))
    return t["questions"].where("question_id <> 100").select(F.col("question_id").cast("long")).distinct().unionByName(more)


def _models(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(m,) for m in ("m0", "m1", "m2", "m7")], "model_id string")


@query(
    "strict_coverage",
    oracle(
        """SELECT lang, judge_id, state, count(*) AS n FROM (SELECT lang, judge_id, CASE WHEN o.seen IS NULL THEN 'missing' WHEN e.wanted IS NULL THEN 'unexpected' ELSE 'met' END AS state
        FROM (SELECT *, 1 AS wanted FROM (SELECT DISTINCT lang, judge_id FROM latest) g, (SELECT unnest(['m0', 'm1', 'm2', 'm7']) AS model_id) m, wanted_ids) e
        FULL JOIN (SELECT DISTINCT lang, judge_id, model_id, question_id, 1 AS seen FROM latest WHERE model_id IN ('m0', 'm1', 'm2', 'm7')) o USING (lang, judge_id, model_id, question_id)) GROUP BY ALL""",
        "j_single", "questions", latest=SINGLE, wanted_ids=WANTED,
    ),
)
def _(t):
    """A model without records, a question less and two more than there are records for."""
    states = coverage.single_gaps(t.single, _wanted(t), _models(t), "lang", "judge_id")
    return states.groupBy("lang", "judge_id", "state").agg(F.count("*").alias("n"))


@query(
    "strict_pair_coverage",
    oracle(
        """SELECT lang, judge_id, model_a, model_b, state, count(*) AS n FROM (SELECT lang, judge_id, model_a, model_b, CASE WHEN o.seen IS NULL THEN 'missing' WHEN e.wanted IS NULL THEN 'unexpected' ELSE 'met' END AS state
        FROM (SELECT g.*, a.m AS model_a, b.m AS model_b, question_id, 2 AS turn, 1 AS wanted FROM (SELECT DISTINCT lang, judge_id FROM odd) g, (SELECT unnest(['m0', 'm1', 'm2', 'm7']) AS m) a, (SELECT unnest(['m0', 'm1', 'm2', 'm7']) AS m) b, wanted_ids WHERE a.m < b.m) e
        FULL JOIN (SELECT DISTINCT lang, judge_id, least(model_a, model_b) AS model_a, greatest(model_a, model_b) AS model_b, question_id, turn, 1 AS seen FROM odd
        WHERE model_a IN ('m0', 'm1', 'm2', 'm7') AND model_b IN ('m0', 'm1', 'm2', 'm7')) o USING (lang, judge_id, model_a, model_b, question_id, turn)) GROUP BY ALL""",
        "j_pair", "questions", latest=PAIRS, odd=ODD_PAIRS, wanted_ids=WANTED,
    ),
)
def _(t):
    states = coverage.pair_gaps(_odd_pairs(t), _wanted(t), _models(t), "lang", "judge_id")
    return states.groupBy("lang", "judge_id", "model_a", "model_b", "state").agg(F.count("*").alias("n"))


# Releases.
BOTH = """SELECT v AS variant, l AS lang, question_id, CASE WHEN v = 'broken' AND l = 'ko' AND question_id % 17 = 0 THEN 'other' ELSE category END AS category, 'one' AS t1,
CASE WHEN v = 'broken' AND l = 'ko' AND question_id = 100 THEN ' ' ELSE 'two' END AS t2, ref1 FROM (SELECT DISTINCT question_id, category, ref1 FROM questions), (SELECT unnest(['whole', 'broken']) AS v), (SELECT unnest(['en', 'ko']) AS l)
WHERE NOT (v = 'broken' AND l = 'ko' AND question_id = 99)"""
PER_VARIANT = {
    "numbers": "SELECT variant, bool_and(n = 80) AND count(*) = 2 AS ok FROM (SELECT variant, lang, count(*) AS n FROM q GROUP BY ALL) GROUP BY variant",
    "unique ids": "SELECT variant, bool_and(n = d) AS ok FROM (SELECT variant, lang, count(*) AS n, count(DISTINCT question_id) AS d FROM q GROUP BY ALL) GROUP BY variant",
    "aligned ids": "SELECT variant, bool_and(n = 2) AS ok FROM (SELECT variant, question_id, count(DISTINCT lang) AS n FROM q GROUP BY ALL) GROUP BY variant",
    "two turns": "SELECT variant, bool_and(length(trim(t1)) > 0 AND length(trim(t2)) > 0) AS ok FROM q GROUP BY variant",
    "categories": "SELECT variant, list_sort(list(category || n)) = list_sort(['writing10', 'roleplay10', 'extraction10', 'reasoning10', 'math10', 'coding10', 'stem10', 'humanities10']) AS ok FROM (SELECT variant, category, count(*)::VARCHAR AS n FROM q WHERE lang = 'ko' GROUP BY ALL) GROUP BY variant",
    "same categories": "SELECT variant, bool_and(n = 1 AND l = 2) AS ok FROM (SELECT variant, question_id, count(DISTINCT category) AS n, count(*) AS l FROM q GROUP BY ALL) GROUP BY variant",
    "references": "SELECT variant, count_if(lang = 'en' AND ref1 IS NOT NULL AND category IN ('math', 'reasoning', 'coding')) > 0 AS ok FROM q GROUP BY variant",
}


def _release_questions(t: Tables, broken: bool) -> DataFrame:
    q = t["questions"].select("question_id", "category", "ref1").distinct().select("*", F.explode(F.array(F.lit("en"), F.lit("ko"))).alias("lang"))
    odd = (F.col("lang") == "ko") & F.lit(broken)
    q = q.where(~(odd & (F.col("question_id") == 99)))
    category = F.when(odd & (F.col("question_id") % 17 == 0), "other").otherwise(F.col("category"))
    turns = F.array(F.lit("one"), F.when(odd & (F.col("question_id") == 100), " ").otherwise("two"))
    return q.select("lang", "question_id", category.alias("category"), turns.alias("turns"), F.when(F.col("ref1").isNotNull(), F.array("ref1", "ref1")).alias("reference"))


@query("release_questions", oracle(" UNION ALL ".join(f"SELECT variant, '{n}' AS name, ok FROM ({sql})" for n, sql in PER_VARIANT.items()), "questions", q=BOTH))
def _(t):
    """The checks of a whole table of questions, and of one with faults."""
    found = [release.question_checks(_release_questions(t, broken)).select(F.lit(v).alias("variant"), "name", "ok") for v, broken in (("whole", False), ("broken", True))]
    return found[0].unionByName(found[1])


MATRIX = """SELECT l AS lang, j AS judge_key, protocol, file_name, model_a, model_b, question_id, category, CASE WHEN j = 'jC' AND protocol = 'pairwise' AND question_id = 120 THEN 'jB' ELSE j END AS judge_id
FROM (SELECT 'single_grade' AS protocol, a.m AS file_name, a.m AS model_a, NULL AS model_b FROM m a UNION ALL SELECT 'single_grade_ref', m, m, NULL FROM m
UNION ALL SELECT 'pairwise', a.m || '_vs_' || b.m, a.m, b.m FROM m a, m b WHERE a.m < b.m) f, (SELECT unnest(['jA', 'jB', 'jC']) AS j), (SELECT unnest(['en', 'ko']) AS l), asked
WHERE (protocol <> 'single_grade_ref' OR category IN ('math', 'reasoning', 'coding') AND ref1 IS NOT NULL) AND NOT (j = 'jB' AND l = 'ko' AND protocol = 'single_grade' AND file_name = 'm3' AND question_id = 85)"""


def _matrix(t: Tables) -> dict[str, DataFrame]:
    """Complete files of three judges, but for one record that judge B lacks in one language and some of judge C with another judge's name."""
    asked = _release_questions(t, False).withColumn("judge_key", F.explode(F.array(F.lit("jA"), F.lit("jB"), F.lit("jC"))))
    model = F.explode(F.array(*map(F.lit, MODELS)))
    one = asked.withColumn("model_id", model).withColumns({"file_name": F.col("model_id"), "judge_id": F.col("judge_key")})
    two = asked.withColumn("model_a", model).withColumn("model_b", model).where("model_a < model_b").withColumn("file_name", F.concat_ws("_vs_", "model_a", "model_b"))
    two = two.withColumn("judge_id", F.when((F.col("judge_key") == "jC") & (F.col("question_id") == 120), "jB").otherwise(F.col("judge_key")))
    lost = (F.col("judge_key") == "jB") & (F.col("lang") == "ko") & (F.col("model_id") == "m3") & (F.col("question_id") == 85)
    return {"single": one.where(~lost), "reference": one.where(F.col("category").isin("math", "reasoning", "coding") & F.col("reference").isNotNull()), "pairwise": two}


@query(
    "release_matrix",
    oracle(
        """SELECT lang, judge_key, CAST(sum(n) AS BIGINT) AS records, bool_and(CASE protocol WHEN 'pairwise' THEN files = 15 AND n = 15 * 80 ELSE files = 6 AND n = 6 * CASE protocol WHEN 'single_grade' THEN 80 ELSE refs END END AND whole AND named) AS complete FROM (
        SELECT lang, judge_key, protocol, count(DISTINCT file_name) AS files, sum(k) AS n, bool_and(k = d) AS whole, bool_and(named) AS named, (SELECT count(*) FROM asked WHERE category IN ('math', 'reasoning', 'coding') AND ref1 IS NOT NULL) AS refs
        FROM (SELECT lang, judge_key, protocol, file_name, count(*) AS k, count(DISTINCT question_id) AS d, bool_and(judge_id = judge_key) AS named FROM records GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
        "questions", m="SELECT unnest(['m0', 'm1', 'm2', 'm3', 'm4', 'm5']) AS m", asked="SELECT DISTINCT question_id, category, ref1 FROM questions", records=MATRIX,
    ),
)
def _(t):
    judges = t.spark.createDataFrame([(j, j) for j in ("jA", "jB", "jC")], "judge_key string, judge_id string")
    return release.matrix(**_matrix(t), questions=_release_questions(t, False), models=MODELS, judges=judges)


@query(
    "failure_conservation",
    oracle(
        "SELECT lang, judge_id, protocol, valid_calls + format_parse_failures + empty_or_api_failures + greatest(expected_calls - n, 0) = expected_calls AS ok FROM counted",
        "j_single", "j_pair", latest=SINGLE, pairs=PAIRS, calls=CALLS, counted=FAILURES,
    ),
)
def _(t):
    reference = t.single.where(F.col("category").isin("math", "reasoning", "coding"))
    return release.conserved(metrics.failure_table(metrics.calls(t.single, t.pairs, reference)))


RUN_ROWS = "SELECT lang, model_id, CASE WHEN seq % 40 = 0 THEN 'm9' ELSE model_id END AS file_name, CASE WHEN seq % 50 = 0 THEN 999 ELSE question_id END AS question_id, judge_id, CASE WHEN seq % 9 = 0 THEN ' ' ELSE input_sha256 END AS h FROM j_single"


@query(
    "run_faults",
    oracle(
        """SELECT lang, file_name, 'repeated' AS fault, count(*) AS n FROM (SELECT lang, file_name, question_id FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
        UNION ALL SELECT f.lang, file_name, 'missing', count(*) FROM (SELECT DISTINCT lang, file_name FROM r) f, (SELECT DISTINCT question_id FROM questions) q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.lang = f.lang AND r.file_name = f.file_name AND r.question_id = q.question_id) GROUP BY ALL
        UNION ALL SELECT lang, file_name, 'unexpected', count(DISTINCT question_id) FROM r WHERE question_id NOT IN (SELECT question_id FROM questions) GROUP BY ALL
        UNION ALL SELECT lang, file_name, 'judge', count(*) FROM r WHERE judge_id <> 'jview' GROUP BY ALL UNION ALL SELECT lang, file_name, 'hash', count(*) FROM r WHERE length(trim(h)) = 0 GROUP BY ALL
        UNION ALL SELECT lang, file_name, 'unit', count(*) FROM r WHERE model_id <> file_name GROUP BY ALL""",
        "j_single", "questions", r=RUN_ROWS,
    ),
)
def _(t):
    k = F.col("seq")
    rows = t["j_single"].withColumns({
        "file_name": F.when(k % 40 == 0, "m9").otherwise(F.col("model_id")), "question_id": F.when(k % 50 == 0, 999).otherwise(F.col("question_id")),
        "input_sha256": F.when(k % 9 == 0, " ").otherwise(F.col("input_sha256")),
    })
    ids = t["questions"].select("question_id", F.explode(F.array(F.lit("en"), F.lit("ko"))).alias("lang"))
    return release.run_faults(rows, ids, "jview", F.col("model_id"))


# Translations.
TRANSLATED = """SELECT question_id, CASE WHEN question_id % 11 = 0 THEN 'other' ELSE category END AS category, CASE WHEN question_id % 13 = 0 THEN 1 ELSE 2 END AS turns, question_id % 6 <> 0 AS korean,
CASE WHEN ref1 IS NULL OR question_id % 5 = 0 THEN 0 WHEN question_id % 9 = 0 THEN 1 ELSE 2 END AS refs FROM asked WHERE question_id % 10 <> 0 UNION ALL SELECT 300, 'math', 2, true, 0 UNION ALL SELECT 83, category, 2, true, CASE WHEN ref1 IS NULL THEN 0 ELSE 2 END FROM asked WHERE question_id = 83"""


@query(
    "translation_faults",
    oracle(
        """SELECT question_id, 'error' AS severity, 'repeated' AS fault FROM t GROUP BY question_id HAVING count(*) > 1
        UNION ALL SELECT question_id, 'error', 'missing' FROM asked WHERE question_id NOT IN (SELECT question_id FROM t)
        UNION ALL SELECT question_id, 'warning', 'unexpected' FROM t WHERE question_id NOT IN (SELECT question_id FROM asked)
        UNION ALL SELECT DISTINCT question_id, 'error', 'category' FROM t JOIN asked a USING (question_id) WHERE t.category <> a.category
        UNION ALL SELECT DISTINCT question_id, 'error', 'turns' FROM t JOIN asked a USING (question_id) WHERE turns <> 2
        UNION ALL SELECT DISTINCT question_id, 'warning', 'script' FROM t JOIN asked a USING (question_id) WHERE turns = 2 AND NOT korean
        UNION ALL SELECT DISTINCT question_id, 'warning', 'reference missing' FROM t JOIN asked a USING (question_id) WHERE turns = 2 AND ref1 IS NOT NULL AND refs = 0
        UNION ALL SELECT DISTINCT question_id, 'error', 'reference count' FROM t JOIN asked a USING (question_id) WHERE turns = 2 AND ref1 IS NOT NULL AND refs = 1""",
        "questions", asked="SELECT DISTINCT question_id, category, ref1 FROM questions", t=TRANSLATED,
    ),
)
def _(t):
    own = t["questions"].select("question_id", "category", "ref1").distinct()
    k, slot, two = F.col("question_id"), F.lit("r"), F.array(F.lit("q one"), F.lit("q two"))
    original = own.select("question_id", "category", two.alias("turns"), F.when(F.col("ref1").isNotNull(), F.array(slot, slot)).alias("reference"))
    korean = F.when(k % 6 != 0, F.lit("물음")).otherwise("no")
    other = own.where("question_id % 10 <> 0").select(
        k.cast("long").alias("question_id"), F.when(k % 11 == 0, "other").otherwise(F.col("category")).alias("category"),
        F.when(k % 13 == 0, F.array(korean)).otherwise(F.array(korean, F.lit("물음"))).alias("turns"),
        F.when(F.col("ref1").isNotNull() & (k % 5 != 0), F.when(k % 9 == 0, F.array(slot)).otherwise(F.array(slot, slot))).alias("reference"),
    )
    more = t.spark.createDataFrame([(300, "math", ["물음", "물음"], None)], other.schema)
    again = original.where("question_id = 83").select(k.cast("long").alias("question_id"), "category", F.array(F.lit("물음"), F.lit("물음")).alias("turns"), "reference")
    return release.translation_faults(original, other.unionByName(more).unionByName(again))


@query(
    "reference_units",
    oracle("SELECT question_id, category FROM questions WHERE category IN ('math', 'reasoning', 'coding') AND length(trim(ref2)) > 0", "questions"),
)
def _(t):
    q = t["questions"].select("question_id", "category", F.when(F.col("ref1").isNotNull(), F.array("ref1", "ref2")).alias("reference"))
    return protocols.with_references(q).select("question_id", "category")


@query(
    "preparation_faults",
    """SELECT 'file' AS kind, url || CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'not recorded' WHEN page_id % 3 = 0 THEN 'size' ELSE 'digest' END AS fault
    FROM pages WHERE (page_id % 5 = 0) <> (page_id % 7 = 0) OR page_id % 5 <> 0 AND page_id % 7 <> 0 AND (page_id % 3 = 0 OR page_id % 11 = 0)
    UNION ALL SELECT 'fact', 'b', 'other value' UNION ALL SELECT 'fact', 'c', 'missing'""",
)
def _(t):
    k = F.col("page_id")
    own = t.raw("pages").select("page_id", F.concat("url", k.cast("string")).alias("path"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("digest"))
    actual = own.where("page_id % 5 <> 0").withColumns({"size": F.when(k % 3 == 0, F.col("size") + 1).otherwise(F.col("size")), "digest": F.when(k % 11 == 0, "other").otherwise(F.col("digest"))})
    return release.preparation_faults(own.where("page_id % 7 <> 0"), actual, {"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "9", "d": "4"})


@query(
    "truncate_messages",
    "SELECT conv_id, array_to_string(list(role || ': ' || CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END ORDER BY turn), chr(10)) AS log FROM conversations GROUP BY conv_id",
)
def _(t):
    """The messages of one conversation are a few; they are gathered, cut and written as a log has them."""
    own = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    cut = text.truncated_messages(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), 40)
    return own.select("conv_id", F.array_join(F.transform(cut, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("log"))
