"""The registered queries and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import prompts, text, verdicts
from assayer.operators import coverage, dedup, gates, judging, merge, metrics, reports, validity
from assayer.plans.carriers import oracle
from assayer.plans.registry import Tables, query
from assayer.schemas import CATEGORIES
from assayer.sources import jsonl

# Shared SQL.
LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"
SINGLE = LATEST.format(keys="lang, judge_id, model_id, question_id", order="tstamp DESC NULLS LAST, seq DESC", source="j_single")
PAIRS = LATEST.format(keys="lang, judge_id, least(model_a, model_b), greatest(model_a, model_b), question_id, turn", order="tstamp DESC NULLS LAST, seq DESC", source="j_pair")
TURNS = "SELECT *, 1 AS turn, CASE WHEN score_turn1 >= 0 THEN score_turn1 END AS score FROM latest UNION ALL SELECT *, 2, CASE WHEN score_turn2 >= 0 THEN score_turn2 END FROM latest"


def _on_single(sql: str, **more: str) -> str:
    return oracle(sql, "j_single", latest=SINGLE, turns=TURNS, **more)


def _on_pairs(sql: str, **more: str) -> str:
    return oracle(sql, "j_pair", latest=PAIRS, **more)


def _means(categories=CATEGORIES, value: str = "score") -> str:
    return ", ".join(f"avg(CASE WHEN category = '{c}' THEN {value} END) AS {c}" for c in categories)


# Parsing and small functions.
SCORE_SQL = r"""coalesce(list_extract(regexp_extract_all(raw, '\[\[(\d+(?:\.\d+)?)\]\]', 1), -1), list_extract(regexp_extract_all(raw, '[Rr]ating:\s*(\d+(?:\.\d+)?)', 1), -1),
list_extract(regexp_extract_all(raw, '[Rr]ating:\s*\*\*(\d+(?:\.\d+)?)\*\*', 1), -1))::DOUBLE"""
VERDICT_SQL = r"upper(list_extract(regexp_extract_all(raw, '\[\[([ABCabc])\]\]', 1), -1))"


@query("parse_score", oracle(f"SELECT id, CASE WHEN s BETWEEN 1 AND 10 THEN s ELSE -1 END::DOUBLE AS score FROM (SELECT id, {SCORE_SQL} AS s FROM j_text)", "j_text"))
def _(t):
    return t["j_text"].select("id", verdicts.parse_score(F.col("raw")).alias("score"))


@query("parse_verdict", oracle(f"SELECT id, CASE WHEN v = 'C' THEN 'tie' ELSE coalesce(v, 'error') END AS verdict FROM (SELECT id, {VERDICT_SQL} AS v FROM j_text)", "j_text"))
def _(t):
    return t["j_text"].select("id", verdicts.parse_verdict(F.col("raw")).alias("verdict"))


@query("resolve_winner", oracle("SELECT seq, winner FROM j_pair", "j_pair"))
def _(t):
    return t["j_pair"].select("seq", verdicts.resolve_winner(*map(F.col, ("winner_ab", "winner_ba", "model_a", "model_b"))).alias("winner"))


@query("avg_score", oracle("SELECT seq, CASE WHEN score_turn1 >= 0 AND score_turn2 >= 0 THEN (score_turn1 + score_turn2) / 2 END AS avg_score FROM j_single", "j_single"))
def _(t):
    return t["j_single"].select("seq", verdicts.average_score(F.col("score_turn1"), F.col("score_turn2")).alias("avg_score"))


@query("turns_nest", oracle("SELECT id, coalesce(a1, a2) AS first, CASE WHEN a1 IS NOT NULL THEN a2 END AS second, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT AS n FROM qa", "qa"))
def _(t):
    """A choice holds as many turns as a conversation has answers."""
    choices = F.array(F.struct(F.lit(0).alias("index"), F.array_compact(F.array("a1", "a2")).alias("turns")))
    turns = verdicts.first_turns(choices)
    return t["qa"].select("id", F.get(turns, F.lit(0)).alias("first"), F.get(turns, F.lit(1)).alias("second"), F.size(turns).alias("n"))


@query("reference_usable", oracle("SELECT question_id, ref1 IS NOT NULL AS declared, coalesce(length(trim(ref2)) > 0, false) AS usable FROM questions WHERE category IN ('math', 'reasoning', 'coding')", "questions"))
def _(t):
    return coverage.reference_ids(_questions(t))


def _questions(t: Tables) -> DataFrame:
    q = t["questions"]
    return q.select("question_id", "category", F.array(F.lit("q one"), F.lit("q two")).alias("turns"), F.when(F.col("ref1").isNotNull(), F.array("ref1", "ref2")).alias("reference"))


@query("fingerprint", "SELECT conv_id, turn, sha256(CAST(to_json({'nothing': NULL::VARCHAR, 'role': role, 'text': text, 'turn': turn}) AS VARCHAR)) AS fingerprint FROM conversations")
def _(t):
    parts = {"text": F.col("text"), "role": F.col("role"), "turn": F.col("turn"), "nothing": F.lit(None).cast("string")}
    return t.raw("conversations").select("conv_id", "turn", text.fingerprint(**parts).alias("fingerprint"))


@query("safe_name", "SELECT page_id, replace(url, '/', '_') AS name FROM pages")
def _(t):
    return t.raw("pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("truncate_log", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS head FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.truncated(F.col("text"), 80).alias("head"))


@query("has_script", "SELECT doc_id, regexp_matches(text, '[à-ÿ]') AS accents, regexp_matches(text, '[가-힣]') AS korean FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.has_script(F.col("text"), "à", "ÿ").alias("accents"), text.has_script(F.col("text")).alias("korean"))


SECRETS_SQL = r"""array_to_string(list_filter([CASE WHEN regexp_matches({0}, '\b(?:sk|rk|pk)-[A-Za-z0-9_-]{{32,}}\b') THEN 'OpenAI-style key' END,
    CASE WHEN regexp_matches({0}, '\b(?:gh[pousr]_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}})\b') THEN 'GitHub token' END,
    CASE WHEN regexp_matches({0}, '\bAKIA[0-9A-Z]{{16}}\b') THEN 'AWS access key' END, CASE WHEN regexp_matches({0}, '\bhf_[A-Za-z0-9]{{30,}}\b') THEN 'Hugging Face token' END], lambda x: x IS NOT NULL), ',')"""


@query("secret_scan", f"SELECT page_id, {SECRETS_SQL.format('html')} AS found FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.array_join(text.secrets(F.col("html")), ",").alias("found"))


@query("secret_scan_documents", f"SELECT doc_id, {SECRETS_SQL.format('text')} AS found FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.array_join(text.secrets(F.col("text")), ",").alias("found"))


TOKENS_SQL = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
GRAMS_SQL = "SELECT id, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS times FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {0}, range(1, 5) r(n)) GROUP BY ALL"
ITEMS = f"SELECT a.item_id AS id, {TOKENS_SQL.format('a.text')} AS w, {TOKENS_SQL.format('b.text')} AS v FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % 40"


def _items(t: Tables) -> DataFrame:
    b = t.raw("benchmark")
    other = b.select(F.col("item_id").alias("o"), F.col("text").alias("reference"))
    return b.join(other, F.col("o") == (F.col("item_id") + 1) % 40).select(F.col("item_id").alias("id"), F.col("text").alias("hypothesis"), "reference")


@query("ngrams", f"WITH items AS ({ITEMS}), g AS ({GRAMS_SQL.format('items')}) SELECT id, CAST(n AS INT) AS n, gram, times FROM g")
def _(t):
    return text.ngram_counts(_items(t), "id", "hypothesis")


@query(
    "bleu",
    f"""WITH items AS ({ITEMS}), rev AS (SELECT id, v AS w FROM items), g AS ({GRAMS_SQL.format("items")}), h AS ({GRAMS_SQL.format("rev")})
    SELECT g.id, CAST(g.n AS INT) AS n, CAST(sum(least(g.times, coalesce(h.times, 0))) AS BIGINT) AS clipped, CAST(sum(g.times) AS BIGINT) AS total
    FROM g LEFT JOIN h ON g.id = h.id AND g.n = h.n AND g.gram = h.gram GROUP BY g.id, g.n""",
)
def _(t):
    return text.bleu_counts(_items(t), "id", "hypothesis", "reference")


@query(
    "spearman",
    oracle(
        """SELECT category, count(*) AS n, CASE WHEN count(*) >= 3 THEN 1 - 6 * CAST(sum((rx - ry) * (rx - ry)) AS DOUBLE) / CAST(count(*) * (count(*) * count(*) - 1) AS DOUBLE) END AS rho FROM
        (SELECT category, row_number() OVER (PARTITION BY category ORDER BY s1, id) AS rx, row_number() OVER (PARTITION BY category ORDER BY s2, id) AS ry FROM review) GROUP BY category""",
        "review",
    ),
)
def _(t):
    return text.spearman(t["review"], "category", "s1", "s2", "id").withColumnRenamed("category", "category")


# Prompts and the mock judge.
BLOCK = "'<{0}>' || chr(10) || coalesce({1}, '') || chr(10) || '</{0}>'"


@query("prompt_single", oracle(f"SELECT id, lang, concat_ws(chr(10) || chr(10), {BLOCK.format('question', 'q1')}, {BLOCK.format('answer', 'a1')}) AS content FROM qa", "qa"))
def _(t):
    return t["qa"].select("id", F.col("lang"), prompts.single(F.col("q1"), F.col("a1"), F.col("lang"))[1]["content"].alias("content"))


TRANSCRIPT = "concat_ws(chr(10), 'user 1: ' || coalesce(q1, ''), 'Assistant 1: ' || coalesce(a1, ''), 'user 2: ' || coalesce(q2, ''), 'Assistant 2: ' || coalesce(a2, ''))"
SLOT = f"CASE WHEN length(trim(q2)) > 0 THEN {BLOCK.format('reference 1', 'q2')} END"


@query("prompt_multi", oracle(f"SELECT id, concat_ws(chr(10) || chr(10), {SLOT}, {TRANSCRIPT}) AS content, coalesce(length(trim(q2)) > 0, false)::INT AS references FROM qa".replace(" AS references", ' AS "references"'), "qa"))
def _(t):
    references = F.array("q2", F.lit(" "))
    user = prompts.multi_single(*map(F.col, ("q1", "a1", "q2", "a2", "lang")), references)[1]["content"]
    return t["qa"].select("id", user.alias("content"), F.regexp_count(user, F.lit("<reference")).alias("references"))


def _pair_sql(*parts: str) -> str:
    return f"concat_ws(chr(10) || chr(10), {', '.join(parts)})"


def _turns_sql(side: str, first: str, second: str) -> str:
    return f"concat_ws(chr(10), 'user 1: ' || coalesce(q1, ''), 'Assistant {side} 1: ' || coalesce({first}, ''), 'user 2: ' || coalesce(q2, ''), 'Assistant {side} 2: ' || coalesce({second}, ''))"


PAIR_BODY = [BLOCK.format("question", "q1"), BLOCK.format("Assistant A", "a1"), BLOCK.format("Assistant B", "a2")]
PAIR_TURNS = [_turns_sql("A", "a1", "a2"), _turns_sql("B", "a2", "a1")]
SYSTEM_SQL = f"CASE WHEN lang = 'ko' THEN '{prompts.COMPARE['ko']}' ELSE '{prompts.COMPARE['en']}' END"
HAS = "CASE WHEN length(trim({0})) > 0 THEN {1} END"
PAIR_USERS = {
    "plain": (SYSTEM_SQL, _pair_sql(*PAIR_BODY)), "steps": (f"{SYSTEM_SQL} || '{prompts.STEPS}'", _pair_sql(*PAIR_BODY)),
    "reference": (SYSTEM_SQL, _pair_sql(HAS.format("q2", BLOCK.format("reference", "q2")), *PAIR_BODY)),
    "turns": (SYSTEM_SQL, _pair_sql(*PAIR_TURNS)),
    "turns_reference": (SYSTEM_SQL, _pair_sql(HAS.format("a1", BLOCK.format("reference 2", "a1")), *PAIR_TURNS)),
}


@query("prompt_pair", oracle("SELECT id, " + ", ".join(f"sha256({system} || chr(0) || {user}) AS {kind}" for kind, (system, user) in PAIR_USERS.items()) + " FROM qa", "qa"))
def _(t):
    q1, a1, q2, a2, lang = map(F.col, ("q1", "a1", "q2", "a2", "lang"))
    kinds = {"plain": prompts.pair(q1, a1, a2, lang), "steps": prompts.pair(q1, a1, a2, lang, steps=True), "reference": prompts.pair(q1, a1, a2, lang, q2, True),
             "turns": prompts.multi_pair(q1, q2, (a1, a2), (a2, a1), lang), "turns_reference": prompts.multi_pair(q1, q2, (a1, a2), (a2, a1), lang, F.array(F.lit(None), a1))}
    return t["qa"].select("id", *(F.sha2(F.concat_ws("\0", c[0]["content"], c[1]["content"]), 256).alias(k) for k, c in kinds.items()))


MOCKED = "CASE WHEN contains({0}, 'Assistant A') AND contains({0}, 'Assistant B') THEN -1 ELSE 7 END::DOUBLE"


@query(
    "mock_judge",
    oracle(
        f"SELECT id, {MOCKED.format('u')} AS score, 'tie' AS winner FROM (SELECT id, {_pair_sql(BLOCK.format('question', 'q1'), BLOCK.format('answer', 'a1'))} AS u FROM odd)",
        "qa", odd="SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'Assistant A or Assistant B? ' || coalesce(q1, '') WHEN id % 3 = 1 THEN 'Assistant A' ELSE q1 END AS q1) FROM qa",
    ),
)
def _(t):
    """Some questions name both assistants, so that a grading call looks like a comparison and gets no rating."""
    q1, a1, q2, a2, lang = map(F.col, ("q1", "a1", "q2", "a2", "lang"))
    k = F.col("id") % 3
    q1 = F.when(k == 0, F.concat(F.lit("Assistant A or Assistant B? "), F.coalesce(q1, F.lit("")))).when(k == 1, "Assistant A").otherwise(q1)
    rows = t["qa"].withColumns({"messages": prompts.single(q1, a1, lang), "messages_ab": prompts.pair(q1, a1, a2, lang), "messages_ba": prompts.pair(q1, a2, a1, lang), "model_a": F.lit("x"), "model_b": F.lit("y")})
    return judging.compare(judging.grade(rows).drop("error")).select("id", "score", "winner")


# One record for each key.
@query("dedup_single", _on_single("SELECT lang, judge_id, model_id, question_id, seq FROM latest"))
def _(t):
    return t.single.select("lang", "judge_id", "model_id", "question_id", "seq")


@query("dedup_pairwise", _on_pairs("SELECT lang, judge_id, model_a, model_b, question_id, seq FROM latest"))
def _(t):
    return t.pairs.select("lang", "judge_id", "model_a", "model_b", "question_id", "seq")


@query("dedup_artifact", oracle("SELECT lang, judge_id, model_id, question_id, seq FROM latest", "j_single", latest=SINGLE.replace("tstamp DESC NULLS LAST", "coalesce(tstamp, 0) DESC")))
def _(t):
    return dedup.artifact(t["j_single"]).select("lang", "judge_id", "model_id", "question_id", "seq")


@query("dedup_last_wins", oracle("SELECT CAST(id AS BIGINT) AS id, seq, payload FROM existing QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1", "existing"))
def _(t):
    odd = t["existing"].select(F.col("id").cast("string").alias("id"), "seq", "payload")
    return dedup.last_wins(odd.unionByName(odd.withColumn("id", F.concat(F.lit("x"), "id"))), "id").select("id", "seq", "payload")


@query("processed_inputs", oracle("SELECT id, input_sha256 FROM existing WHERE length(input_sha256) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1", "existing"))
def _(t):
    return merge.processed_inputs(t["existing"], "id")


# Metrics.
SCORES_SQL = """avg(score) AS overall, count(DISTINCT question_id) AS n_questions, count(score) AS n_samples, count(*) AS observed, {expected}::BIGINT AS expected,
count(*) - count(score) AS failures, (count(*) - count(score)) / count(*) AS failure_rate, count(DISTINCT question_id) / {questions}::DOUBLE AS coverage"""
BY = ["lang", "judge_id", "model_id"]


@query("single_scores", _on_single(f"SELECT lang, judge_id, model_id, {SCORES_SQL.format(expected=160, questions=80)} FROM turns GROUP BY ALL"))
def _(t):
    return metrics.single_scores(t.single, BY, 80).drop(*CATEGORIES)


@query("scores_unplanned", _on_single(f"SELECT lang, judge_id, model_id, {SCORES_SQL.format(expected='count(*)', questions='NULL')} FROM turns GROUP BY ALL"))
def _(t):
    """Nobody says how many questions were asked: as many samples as there are, and no coverage."""
    return metrics.single_scores(t.single, BY).drop(*CATEGORIES)


@query("scores_wide", _on_single(f"SELECT lang, judge_id, model_id, {_means()}, avg(score) AS overall FROM turns GROUP BY ALL"))
def _(t):
    return metrics.single_scores(t.single, BY, 80).select(*BY, *CATEGORIES, "overall")


@query(
    "reference_scores",
    _on_single(
        f"SELECT lang, judge_id, model_id, {_means(('math', 'reasoning', 'coding'))}, {SCORES_SQL.format(expected=29, questions=29)} FROM turns "
        "WHERE turn = 2 AND category IN ('math', 'reasoning', 'coding') GROUP BY ALL"
    ),
)
def _(t):
    return metrics.reference_scores(t.single.where(F.col("category").isin("math", "reasoning", "coding")), BY, 29)


GAMES = "SELECT *, unnest([model_a, model_b]) AS model_id FROM latest {where}"
KNOWN = "coalesce(winner IN (model_a, model_b, 'tie', 'inconsistent'), false)"
GAIN = f"CASE WHEN NOT {KNOWN} THEN NULL WHEN winner = model_id THEN 1.0::DOUBLE WHEN winner IN ('tie', 'inconsistent') THEN 0.5 ELSE 0 END"
RATES = f"""SELECT lang, judge_id, model_id, {_means(value=GAIN)}, avg({GAIN}) AS overall, count({GAIN}) AS n_games,
avg(CASE WHEN winner <> 'inconsistent' THEN {GAIN} END) AS overall_consistent_only, count(CASE WHEN winner <> 'inconsistent' THEN {GAIN} END) AS n_consistent_games,
count(*) AS n_pairs_total, {{expected}} AS n_expected_pairs, count_if(winner = 'inconsistent')::BIGINT AS n_inconsistent, count_if(NOT {KNOWN})::BIGINT AS n_errors,
count({GAIN}) / count(*) AS valid_fraction, count(CASE WHEN winner <> 'inconsistent' THEN {GAIN} END) / count(*) AS consistent_fraction FROM games GROUP BY ALL"""


@query("win_rates", _on_pairs(RATES.format(expected="count(*)"), games=GAMES.format(where="")))
def _(t):
    return metrics.win_rates(t.pairs, ["lang", "judge_id"])


SUBSET = ["m0", "m1", "m2", "m9"]


@query(
    "win_rates_subset",
    _on_pairs(
        """SELECT lang, judge_id, model_id, * EXCLUDE (lang, judge_id, model_id) REPLACE (coalesce(n_games, 0) AS n_games, coalesce(n_consistent_games, 0) AS n_consistent_games, coalesce(n_pairs_total, 0) AS n_pairs_total,
        coalesce(n_inconsistent, 0) AS n_inconsistent, coalesce(n_errors, 0) AS n_errors, 240::BIGINT AS n_expected_pairs)
        FROM (SELECT DISTINCT lang, judge_id, unnest(['m0', 'm1', 'm2', 'm9']) AS model_id FROM latest) LEFT JOIN rates USING (lang, judge_id, model_id)""",
        games=GAMES.format(where="WHERE model_a IN ('m0', 'm1', 'm2', 'm9') AND model_b IN ('m0', 'm1', 'm2', 'm9')"), rates=RATES.format(expected="count(*)"),
    ),
)
def _(t):
    """A model without a game has a row; 80 questions against each of the three others are expected."""
    return metrics.win_rates(t.pairs, ["lang", "judge_id"], 80, SUBSET)


ODD_WINNERS = "SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 7 = 0 THEN 'someone' ELSE winner END AS winner) FROM clean"


@query(
    "win_rates_expected",
    oracle(
        "SELECT * REPLACE (80 * (SELECT count(DISTINCT model_id) - 1 FROM games g WHERE g.lang = rates.lang AND g.judge_id = rates.judge_id) AS n_expected_pairs) FROM rates",
        "j_pair", clean=PAIRS, latest=ODD_WINNERS, games=GAMES.format(where=""), rates=RATES.format(expected="count(*)"),
    ),
)
def _(t):
    """No list of models: those that a group's games name are expected to meet; unknown and null winners are errors."""
    k = F.col("seq")
    odd = t.pairs.withColumn("winner", F.when(k % 5 != 0, F.when(k % 7 == 0, "someone").otherwise(F.col("winner"))))
    return metrics.win_rates(odd, ["lang", "judge_id"], 80)


INCONSISTENT = """SELECT *, inconsistent - same_first - same_second AS other, 100.0::DOUBLE * inconsistent / nullif(valid, 0) AS rate_pct, 100.0::DOUBLE * same_first / nullif(inconsistent, 0) AS same_first_pct,
100.0::DOUBLE * same_second / nullif(inconsistent, 0) AS same_second_pct, 100.0::DOUBLE * (inconsistent - same_first - same_second) / nullif(inconsistent, 0) AS other_pct FROM (
SELECT lang, judge_id, count_if(winner = 'inconsistent')::BIGINT AS inconsistent, count_if(winner <> 'error')::BIGINT AS valid,
count_if(winner = 'inconsistent' AND winner_ab = 'A' AND winner_ba = 'A')::BIGINT AS same_first, count_if(winner = 'inconsistent' AND winner_ab = 'B' AND winner_ba = 'B')::BIGINT AS same_second FROM latest GROUP BY ALL)"""


@query("inconsistency", _on_pairs(INCONSISTENT))
def _(t):
    return metrics.inconsistency(t.pairs, ["lang", "judge_id"])


@query(
    "inconsistency_mean",
    _on_pairs("SELECT lang, avg(CAST(floor(rate_pct) AS BIGINT)) AS mean_rate, count(*) AS n_judges FROM stats GROUP BY lang", stats=INCONSISTENT),
)
def _(t):
    """The mean over judges of rates that are cut to whole per cents first, as a report with rounded rows takes it."""
    stats = metrics.inconsistency(t.pairs, ["lang", "judge_id"])
    return stats.groupBy("lang").agg(F.avg(F.floor("rate_pct")).alias("mean_rate"), F.count("*").alias("n_judges"))


POOLED = "SELECT judge_id, lang, avg(score) AS score, count(*) AS n FROM turns WHERE score > 0 GROUP BY ALL"


@query("single_table", _on_single("SELECT judge_id, lang, score, n FROM pooled", pooled=POOLED))
def _(t):
    return reports.pooled_scores(t.single)


SIDES = "SELECT judge_id, max(CASE WHEN lang = 'en' THEN score END) AS en_score, max(CASE WHEN lang = 'ko' THEN score END) AS ko_score FROM pooled GROUP BY judge_id"


@query(
    "lang_delta",
    _on_single(
        "SELECT judge_id, en_score, ko_score, ko_score - en_score AS delta_score FROM sides UNION ALL SELECT 'Mean', avg(en_score), avg(ko_score), avg(ko_score - en_score) FROM sides",
        pooled=POOLED, sides=SIDES,
    ),
)
def _(t):
    return reports.with_mean_row(reports.by_language(reports.pooled_scores(t.single), "judge_id", ["score"]), "judge_id", ["en_score", "ko_score", "delta_score"])


@query(
    "reference_pairs",
    oracle(
        """SELECT a.judge_id, a.lang, avg(a.score_turn2) AS standard, avg(b.score_turn2) AS reference, count(*) AS n FROM latest a JOIN other b USING (lang, judge_id, model_id, question_id)
        WHERE a.score_turn2 > 0 AND b.score_turn2 > 0 GROUP BY ALL""",
        "j_single", latest=SINGLE, other="SELECT * FROM (" + SINGLE.replace("tstamp DESC NULLS LAST", "coalesce(tstamp, 0) DESC") + ") WHERE category IN ('math', 'reasoning', 'coding')",
    ),
)
def _(t):
    return reports.reference_pairs(t.single, dedup.artifact(t["j_single"]).where(F.col("category").isin("math", "reasoning", "coding")))


JUDGES = ["jclick", "jerror", "jpurchase", "jsignup", "jview"]


@query(
    "judge_matrix",
    _on_single(
        f"""SELECT *, ({" + ".join(f"coalesce({j}, 0)" for j in JUDGES)}) / nullif({" + ".join(f"({j} IS NOT NULL)::INT" for j in JUDGES)}, 0) AS judge_mean FROM (
        SELECT lang, row_type, row_id, {", ".join(f"avg(CASE WHEN judge_id = '{j}' THEN score END) AS {j}" for j in JUDGES)} FROM (
        SELECT lang, judge_id, score, 'model' AS row_type, model_id AS row_id FROM turns WHERE score > 0 UNION ALL SELECT lang, judge_id, score, 'category', category FROM turns WHERE score > 0) GROUP BY lang, row_type, row_id)"""
    ),
)
def _(t):
    return reports.judge_matrix(t.single, t["questions"].select("question_id", "category"), JUDGES)


@query("topk_models", _on_single("SELECT lang, judge_id, model_id, avg(score) AS overall FROM turns GROUP BY ALL ORDER BY overall DESC NULLS LAST, model_id, lang, judge_id LIMIT 10"))
def _(t):
    scores = metrics.single_scores(t.single, BY, 80).select(*BY, "overall")
    return scores.orderBy(F.col("overall").desc_nulls_last(), "model_id", "lang", "judge_id").limit(10)


CALLS = """SELECT lang, judge_id, 'single_grade' AS protocol, raw, failed FROM (SELECT lang, judge_id, unnest([judgment_turn1, judgment_turn2]) AS raw, unnest([score_turn1 = -1, score_turn2 = -1]) AS failed FROM latest)
UNION ALL SELECT lang, judge_id, 'single_grade_ref', judgment_turn2, score_turn2 = -1 FROM latest WHERE category IN ('math', 'reasoning', 'coding')
UNION ALL SELECT lang, judge_id, 'pairwise', raw, failed FROM (SELECT lang, judge_id, unnest([judgment_ab, judgment_ba]) AS raw, unnest([winner_ab = 'error', winner_ba = 'error']) AS failed FROM pairs)"""
FAILURES = """SELECT lang, judge_id, protocol, count_if(NOT failed)::BIGINT AS valid_calls, count_if(failed AND length(trim(raw)) > 0)::BIGINT AS format_parse_failures, count_if(failed AND length(trim(raw)) = 0)::BIGINT AS empty_or_api_failures,
max(CASE protocol WHEN 'single_grade' THEN 960 WHEN 'pairwise' THEN 2400 ELSE 174 END)::BIGINT AS expected_calls, count(*) AS n FROM calls GROUP BY ALL"""


@query(
    "failure_table",
    oracle(
        "SELECT * EXCLUDE (n), greatest(expected_calls - n, 0) AS missing_calls, format_parse_failures + empty_or_api_failures + greatest(expected_calls - n, 0) AS total_failures FROM counted",
        "j_single", "j_pair", latest=SINGLE, pairs=PAIRS, calls=CALLS, counted=FAILURES,
    ),
)
def _(t):
    return metrics.failure_table(metrics.calls(t.single, t.pairs, t.single.where(F.col("category").isin("math", "reasoning", "coding"))))


@query(
    "run_audit",
    oracle(
        """SELECT lang, judge_id, coalesce(a, 0) AS single_records, coalesce(b, 0)::BIGINT AS single_failures, coalesce(c, 0) AS pair_records, coalesce(d, 0)::BIGINT AS pair_failures, coalesce(e, 0)::BIGINT AS inconsistent,
        2 * coalesce(a, 0) + 2 * coalesce(c, 0) AS model_calls FROM
        (SELECT lang, judge_id, count(*) AS a, sum((score_turn1 = -1)::INT + (score_turn2 = -1)::INT) AS b FROM latest GROUP BY ALL) FULL JOIN
        (SELECT lang, judge_id, count(*) AS c, sum((winner_ab = 'error')::INT + (winner_ba = 'error')::INT) AS d, count_if(winner = 'inconsistent') AS e FROM pairs GROUP BY ALL) USING (lang, judge_id)""",
        "j_single", "j_pair", latest=SINGLE, pairs=PAIRS,
    ),
)
def _(t):
    return metrics.run_audit(t.single, t.pairs, ["lang", "judge_id"])


# Coverage and gates.
GRID = "SELECT 'm' || CAST(m AS VARCHAR) AS model_id, 81 + q AS question_id FROM range(0, 6) a(m), range(0, 90) b(q)"


def _grid(t: Tables) -> DataFrame:
    ids = t.spark.range(540)
    return ids.select(F.concat(F.lit("m"), F.expr("string(id div 90)")).alias("model_id"), (81 + F.col("id") % 90).alias("question_id"))


SEEN = "SELECT DISTINCT model_id, question_id FROM j_single"


@query(
    "coverage_gaps",
    oracle(
        "SELECT model_id, question_id, CASE WHEN s.seen IS NULL THEN 'missing' WHEN g.wanted IS NULL THEN 'unexpected' ELSE 'met' END AS state FROM (SELECT *, 1 AS wanted FROM grid WHERE question_id <> 100) g FULL JOIN (SELECT *, 1 AS seen FROM found) s USING (model_id, question_id)",
        "j_single", grid=GRID, found=SEEN,
    ),
)
def _(t):
    """All records of all judges; ten questions of the grid have no record, and one that has is not expected."""
    return coverage.gaps(_grid(t).where("question_id <> 100"), t["j_single"], "model_id", "question_id")


@query(
    "coverage_gaps_judges",
    oracle(
        "SELECT judge_id, model_id, question_id, CASE WHEN s.seen IS NULL THEN 'missing' WHEN g.wanted IS NULL THEN 'unexpected' ELSE 'met' END AS state FROM (SELECT *, 1 AS wanted FROM (SELECT DISTINCT judge_id FROM j_single) j CROSS JOIN grid) g FULL JOIN (SELECT DISTINCT judge_id, model_id, question_id, 1 AS seen FROM j_single) s USING (judge_id, model_id, question_id)",
        "j_single", grid=GRID,
    ),
)
def _(t):
    """Every judge and all its records; the expected grid has ten questions that no judge saw."""
    expected = coverage.grid(t["j_single"].select("judge_id").distinct(), _grid(t))
    return coverage.gaps(expected, t["j_single"], "judge_id", "model_id", "question_id")


@query(
    "set_equality",
    oracle(
        """SELECT lang, judge_id, list_sort(list(DISTINCT model_id)) = ['m0', 'm1', 'm2', 'm3', 'm4', 'm5'] AND list_sort(list(DISTINCT question_id)) = range(81, 161) AS same
        FROM (SELECT * REPLACE (CASE WHEN judge_id = 'jview' AND question_id = 90 THEN 61 ELSE question_id END AS question_id, CASE WHEN judge_id = 'jerror' AND model_id = 'm5' THEN 'm6' ELSE model_id END AS model_id) FROM j_single) GROUP BY ALL""",
        "j_single",
    ),
)
def _(t):
    """Whether a run's models and questions are exactly the expected ones: nothing is missing or unexpected.

    One judge has another question and one another model instead, so that numbers alone would not tell.
    """
    j = t["j_single"]
    j = j.withColumns({"question_id": F.when((F.col("judge_id") == "jview") & (F.col("question_id") == 90), 61).otherwise(F.col("question_id")),
                       "model_id": F.when((F.col("judge_id") == "jerror") & (F.col("model_id") == "m5"), "m6").otherwise(F.col("model_id"))})
    runs = j.select("lang", "judge_id").distinct()
    checks = []
    for item, expected in (("model_id", _grid(t).select("model_id").distinct()), ("question_id", _grid(t).where("question_id <= 160").select("question_id").distinct())):
        state = coverage.gaps(coverage.grid(runs, expected), j, "lang", "judge_id", item)
        checks.append(state.select("lang", "judge_id", "state"))
    return checks[0].unionByName(checks[1]).groupBy("lang", "judge_id").agg((F.count_if(F.col("state") != "met") == 0).alias("same"))


@query("model_pairs", oracle("SELECT DISTINCT a.lang, a.question_id, a.model_id AS model_a, b.model_id AS model_b FROM m a JOIN m b ON a.lang = b.lang AND a.question_id = b.question_id AND a.model_id < b.model_id", "j_single", m="SELECT DISTINCT lang, question_id, model_id FROM j_single"))
def _(t):
    return coverage.model_pairs(t["j_single"], "lang", "question_id")


@query("join_qa", oracle("SELECT q.question_id, l.model_id, l.judge_id, l.lang, q.category FROM (SELECT DISTINCT question_id, category FROM questions) q JOIN latest l USING (question_id)", "j_single", "questions", latest=SINGLE))
def _(t):
    asked = t["questions"].select("question_id", "category").distinct()
    return asked.join(t.single.drop("category"), "question_id").select("question_id", "model_id", "judge_id", "lang", "category")


@query("join_pair", _on_single("SELECT a.lang, a.judge_id, a.question_id, a.model_id AS model_a, b.model_id AS model_b, a.seq AS seq_a, b.seq AS seq_b FROM latest a JOIN latest b USING (lang, judge_id, question_id) WHERE a.model_id < b.model_id"))
def _(t):
    sides = [t.single.select("lang", "judge_id", "question_id", F.col("model_id").alias(f"model_{k}"), F.col("seq").alias(f"seq_{k}")) for k in "ab"]
    return sides[0].join(sides[1], ["lang", "judge_id", "question_id"]).where("model_a < model_b")


ASKED = "SELECT DISTINCT question_id, category FROM questions"


@query(
    "join_qa_all",
    oracle(
        """SELECT question_id, model_id, judge_id, lang, q.category, 'met' AS state FROM asked q JOIN latest l USING (question_id)
        UNION ALL SELECT question_id, model_id, judge_id, lang, category, 'missing' FROM asked CROSS JOIN (SELECT DISTINCT lang, judge_id, model_id FROM latest) r
        WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.lang = r.lang AND l.judge_id = r.judge_id AND l.model_id = r.model_id AND l.question_id = asked.question_id)""",
        "j_single", "questions", latest=SINGLE, asked=ASKED,
    ),
)
def _(t):
    """All questions with all answers, and those that a model of a run has not answered."""
    return coverage.answers(t["questions"], t.single, "lang", "judge_id")


@query(
    "join_pair_all",
    oracle(
        """SELECT lang, judge_id, question_id, q.category, p.model_a, p.model_b, a.seq AS seq_a, b.seq AS seq_b, CASE WHEN a.seq IS NULL OR b.seq IS NULL THEN 'missing' ELSE 'met' END AS state
        FROM (SELECT x.lang, x.judge_id, x.model_id AS model_a, y.model_id AS model_b FROM models x JOIN models y ON x.lang = y.lang AND x.judge_id = y.judge_id AND x.model_id < y.model_id) p CROSS JOIN asked q
        LEFT JOIN (SELECT lang, judge_id, question_id, model_id AS model_a, seq FROM latest) a USING (lang, judge_id, question_id, model_a)
        LEFT JOIN (SELECT lang, judge_id, question_id, model_id AS model_b, seq FROM latest) b USING (lang, judge_id, question_id, model_b)""",
        "j_single", "questions", latest=SINGLE, asked=ASKED, models="SELECT DISTINCT lang, judge_id, model_id FROM latest",
    ),
)
def _(t):
    """All pairs of a run's models on all questions, with both answers or the side that is missing."""
    return coverage.paired_answers(t["questions"], t.single, "lang", "judge_id")


@query("dup_key_gate", oracle("SELECT id, count(*) AS copies FROM existing GROUP BY id HAVING count(*) > 1", "existing"))
def _(t):
    return gates.duplicate_keys(t["existing"], "id")


@query("judge_guard", oracle("SELECT model_id, count(DISTINCT judge_id) AS judges FROM j_single GROUP BY model_id HAVING count(DISTINCT judge_id) > 1", "j_single"))
def _(t):
    return gates.several_judges(t["j_single"], "model_id")


@query("category_census", oracle("SELECT category, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected FROM (SELECT category, count(*) AS n FROM questions GROUP BY category) FULL JOIN (SELECT unnest(['writing', 'math', 'other']) AS category, 10::BIGINT AS expected) USING (category)", "questions"))
def _(t):
    expected = t.spark.createDataFrame([("writing", 10), ("math", 10), ("other", 10)], "category string, expected long")
    return gates.category_census(t["questions"], expected)


@query("uniform_sets", oracle("SELECT count(*) AS n_groups, count(DISTINCT s) <= 1 AS uniform FROM (SELECT model_id, list_sort(list(DISTINCT question_id)) AS s FROM j_single GROUP BY model_id)", "j_single"))
def _(t):
    return gates.uniform_sets(t["j_single"], "model_id", "question_id")


@query("matrix_complete", oracle("SELECT lang, judge_id, 'single_grade' AS protocol, count(DISTINCT model_id) AS n_files, count(DISTINCT model_id) = 6 AS complete FROM j_single GROUP BY ALL UNION ALL SELECT lang, judge_id, 'pairwise', count(DISTINCT model_a || '_vs_' || model_b), count(DISTINCT model_a || '_vs_' || model_b) = 15 FROM j_pair GROUP BY ALL", "j_single", "j_pair"))
def _(t):
    one = t["j_single"].select("lang", "judge_id", F.lit("single_grade").alias("protocol"), F.col("model_id").alias("file_name"))
    two = t["j_pair"].select("lang", "judge_id", F.lit("pairwise").alias("protocol"), F.concat_ws("_vs_", "model_a", "model_b").alias("file_name"))
    return gates.matrix_complete(one.unionByName(two), {"single_grade": 6, "pairwise": 15})


@query("valid_single_gate", oracle("SELECT seq, CASE WHEN category = 'math' THEN 'category' ELSE 'score' END AS reason FROM j_single WHERE category = 'math' OR seq % 19 = 0", "j_single"))
def _(t):
    odd = t["j_single"].withColumns({"category": F.when(F.col("category") == "math", "maths").otherwise(F.col("category")), "score_turn1": F.when(F.col("seq") % 19 == 0, 99.0).otherwise(F.col("score_turn1"))})
    return gates.violations(odd, gates.single_rules()).select("seq", "reason")


@query("valid_pairwise_gate", oracle("SELECT seq, CASE WHEN seq % 23 = 0 THEN 'models' WHEN seq % 11 = 0 THEN 'verdict' WHEN seq % 7 = 0 AND winner <> 'tie' THEN 'winner' ELSE 'turn' END AS reason FROM j_pair WHERE seq % 23 = 0 OR seq % 11 = 0 OR (seq % 7 = 0 AND winner <> 'tie') OR seq % 5 = 0", "j_pair"))
def _(t):
    k = F.col("seq")
    odd = t["j_pair"].withColumns({
        "model_b": F.when(k % 23 == 0, F.col("model_a")).otherwise(F.col("model_b")), "winner_ab": F.when(k % 11 == 0, "garbage").otherwise(F.col("winner_ab")),
        "winner": F.when(k % 7 == 0, "tie").otherwise(F.col("winner")), "turn": F.when(k % 5 == 0, 1).otherwise(F.col("turn")),
    })
    return gates.violations(odd, gates.pairwise_rules()).select("seq", "reason")


@query("valid_question_gate", oracle("SELECT question_id, CASE WHEN k % 4 = 0 THEN 'turns' ELSE 'reference' END AS reason FROM questions WHERE k % 4 = 0 OR k % 7 = 0 AND ref1 IS NOT NULL", "questions"))
def _(t):
    k = F.col("question_id") - 81
    q = _questions(t)
    q = q.withColumn("turns", F.when(k % 4 == 0, F.array(F.lit("one"))).otherwise(F.col("turns")))
    q = q.withColumn("reference", F.when((k % 7 == 0) & F.col("reference").isNotNull(), F.array(F.lit(" "), F.lit(""))).otherwise(F.col("reference")))
    return gates.violations(q, gates.question_rules()).select("question_id", "reason")


@query("release_checks", oracle("SELECT 'questions' AS name, count(*) = 80 AND count(DISTINCT question_id) = 80 AS ok FROM questions UNION ALL SELECT 'answers', bool_and(n = 6) FROM (SELECT question_id, count(DISTINCT model_id) AS n FROM j_single GROUP BY question_id) UNION ALL SELECT 'duplicates', count(*) = 0 FROM (SELECT seq FROM j_single GROUP BY seq HAVING count(*) > 1)", "questions", "j_single"))
def _(t):
    q, j = t["questions"], t["j_single"]
    checks = {
        "questions": q.agg(((F.count("*") == 80) & (F.count_distinct("question_id") == 80)).alias("ok")),
        "answers": j.groupBy("question_id").agg(F.count_distinct("model_id").alias("n")).agg(F.bool_and(F.col("n") == 6).alias("ok")),
        "duplicates": gates.duplicate_keys(j, "seq").agg((F.count("*") == 0).alias("ok")),
    }
    named = [df.select(F.lit(n).alias("name"), "ok") for n, df in checks.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("align_three", "SELECT item_id AS id, concat_ws(',', CASE WHEN item_id % 5 = 0 THEN 'translated' END, CASE WHEN item_id % 7 = 0 THEN 'back' END, CASE WHEN item_id % 7 <> 0 AND item_id % 11 = 0 THEN 'category' END) AS problems FROM benchmark")
def _(t):
    b = t.raw("benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("c"), F.expr("string(item_id % 8)")).alias("category"))
    back = b.where("id % 7 <> 0").withColumn("category", F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("category")))
    return coverage.align_three(b, b.where("id % 5 <> 0"), back)


@query("manifest_diff", "SELECT url || CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'extra' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'ok' END AS state FROM pages WHERE NOT (page_id % 5 = 0 AND page_id % 7 = 0)")
def _(t):
    own = t.raw("pages").select("page_id", F.concat("url", F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("digest"))
    recorded = own.where("page_id % 7 <> 0").select("path", "digest")
    actual = own.where("page_id % 5 <> 0").select("path", F.when(F.col("page_id") % 3 == 0, "other").otherwise(F.col("digest")).alias("digest"))
    return coverage.manifest_diff(recorded, actual)


@query(
    "path_allowlist",
    oracle(
        r"""SELECT page_id, path, regexp_full_match(path, '(results|translation_review)/[^/]+\.csv|(en|ko)/questions\.jsonl|(en|ko)/answers/[^/]+\.jsonl|(en|ko)/judgments/[^/]+/[^/]+/(pairwise|pairwise_ref|single_grade|single_grade_ref)/[^/]+\.jsonl') AS published FROM paths""",
        "paths",
    ),
)
def _(t):
    return t["paths"].select("page_id", "path", coverage.published(F.col("path")).alias("published"))


@query("preview_ids", oracle("SELECT category, array_to_string(list_sort(list(id))[1:10], ',') AS ids FROM review GROUP BY category", "review"))
def _(t):
    return reports.preview_ids(t["review"], "category", "id")


# Upserts and resumed runs.
@query("upsert_merge", oracle("SELECT * FROM existing WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh", "existing", "incoming", fresh="SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"))
def _(t):
    return merge.upsert(t["existing"], dedup.last_wins(t["incoming"], "id"), "id")


@query("orphan_prune", oracle("SELECT seq, id FROM existing WHERE id IN (SELECT id FROM incoming)", "existing", "incoming"))
def _(t):
    return merge.prune_orphans(t["existing"], t["incoming"], "id").select("seq", "id")


@query("incomplete_ids", oracle("SELECT id, concat_ws(',', max(CASE WHEN w = 1 THEN 'missing' END), max(CASE WHEN w = 2 THEN 'failed' END)) AS why FROM (SELECT id, 1 AS w FROM existing WHERE input_sha256 = '' UNION ALL SELECT id, 2 FROM incoming WHERE seq % 10 = 1) GROUP BY id", "existing", "incoming"))
def _(t):
    return merge.incomplete("id", missing=t["existing"].where("input_sha256 = ''"), failed=t["incoming"].where("seq % 10 = 1"))


@query(
    "resume_pending",
    oracle(
        """SELECT e.lang, e.judge_id, e.model_id, e.question_id FROM (SELECT DISTINCT lang, judge_id, model_id, question_id, 'h1' AS input_sha256 FROM j_single) e
        LEFT JOIN (SELECT * FROM latest WHERE length(trim(judgment_turn1)) > 0 AND length(trim(judgment_turn2)) > 0) l USING (lang, judge_id, model_id, question_id, input_sha256) WHERE l.seq IS NULL""",
        "j_single", latest=SINGLE,
    ),
)
def _(t):
    keys = [*BY, "question_id"]
    expected = t["j_single"].select(*keys).distinct().withColumn("input_sha256", F.lit("h1"))
    return merge.pending(t.single, expected, keys, merge.single_is_current()).select(*keys)


# Translation review.
@query("translation_review", oracle("SELECT category, count(*) AS n, avg(bleu_avg::DOUBLE) AS bleu_avg, avg(semantic_avg::DOUBLE) AS semantic_avg, avg(difficulty_avg::DOUBLE) AS difficulty_avg, avg(constraint_avg::DOUBLE) AS constraint_avg, avg(overall_avg::DOUBLE) AS overall_avg, count_if(needs_manual_check = 'True')::BIGINT AS needs_manual_check, count_if(modified = 'True')::BIGINT AS modified FROM review GROUP BY category", "review"))
def _(t):
    return reports.translation_review(t["review"])


@query("validity_item", oracle("SELECT id, CASE WHEN s1 > 0 AND s2 > 0 THEN (s1 + s2) / 2 WHEN s1 > 0 THEN s1 WHEN s2 > 0 THEN s2 END::DOUBLE AS mean FROM review", "review"))
def _(t):
    return t["review"].select("id", validity.turn_mean(F.col("s1"), F.col("s2")).alias("mean"))


@query("validity_rollup", oracle("SELECT category, count(*) AS n, avg(CASE WHEN s1 >= 0 THEN s1 END) AS s1, avg(CASE WHEN s2 >= 0 THEN s2 END) AS s2 FROM review GROUP BY ROLLUP (category)", "review"))
def _(t):
    return validity.rollup(t["review"], ["s1", "s2"])


@query("valid_validity_gate", oracle("SELECT id, 'score' AS reason FROM review WHERE NOT regexp_full_match(overall_avg, '[1-5]')", "review"))
def _(t):
    return gates.violations(t["review"].withColumnsRenamed({"bleu_avg": "bleu", "overall_avg": "overall"}), validity.item_rules()).select("id", "reason")


@query("validity_parse", oracle("SELECT id, CASE WHEN s1 < 1 THEN -1 ELSE s1 END::INT AS overall_score, CASE WHEN s1 < 1 THEN true ELSE s1 <= 3 OR modified = 'True' END AS needs_manual_check, CASE WHEN s1 < 1 THEN 'invalid: overall_score must be an integer from 1 through 5 (booleans excluded)' WHEN s1 > 3 THEN 'ok' WHEN modified = 'True' THEN 'ok: low score' ELSE 'ok: low score forced needs_manual_check=true' END AS parse_status FROM review", "review"))
def _(t):
    body = F.format_string(
        '{"semantic_preservation": 5, "difficulty_preservation": 4, "constraint_preservation": 5, "overall_score": %d, "issue_summary": "s", "needs_manual_check": %s}', "s1", F.lower("modified")
    )
    return t["review"].select("id", validity.parse_verdict(body).alias("v")).select("id", "v.overall_score", "v.needs_manual_check", "v.parse_status")


# Strict lines.
@query("scan_strict_filter", """SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'bad' WHEN 4 THEN 'bad' ELSE 'good' END AS state, CASE WHEN event_id % 6 IN (0, 5) THEN (props::JSON->>'k')::BIGINT END AS k FROM events WHERE event_id % 6 NOT IN (1, 2)""")
def _(t):
    e, k = t.raw("events"), F.col("event_id") % 6
    line = F.when(k == 1, F.concat(F.lit("# "), "props")).when(k == 2, " \t").when(k == 3, '{"k": NaN}').when(k == 4, F.concat("props", F.lit(" trailing"))).otherwise(F.concat(F.lit("  "), "props"))
    rows = jsonl.parse(jsonl.content(e.select("event_id", line.alias("line"))), "k long", ("k",))
    return rows.select("event_id", F.when(F.col("reject").isNull(), "good").otherwise("bad").alias("state"), F.when(F.col("reject").isNull(), F.col("k")).alias("k"))
