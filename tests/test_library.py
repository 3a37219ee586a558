"""Functions and operators that SQL does not cover: sources, sinks, gates, references, streams, calls."""

from __future__ import annotations

import json
import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import text, verdicts
from assayer.operators import coverage, dedup, gates, judging, merge, metrics, published, sinks, validity
from assayer.sources import files, jsonl
from assayer.streaming.merge import merge_batch, merge_stream


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_scores_of_texts(spark):
    cases = {"[[3]] then [[7.5]]": 7.5, "[[11]] Rating: 5": -1, "Rating: 8/10": 8, "Rating: **8**": 8, "[[-5]]": -1, "": -1, None: -1, "rating: 2 Rating: 9": 9}
    got = values(spark, [(t,) for t in cases], "t string", verdicts.parse_score(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_verdicts_of_texts(spark):
    cases = {"[[a]] [[B]]": "B", "[[C]]": "tie", "[[D]]": "error", "": "error", None: "error"}
    got = values(spark, [(t,) for t in cases], "t string", verdicts.parse_verdict(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_winners(spark):
    cases = {("A", "B"): "x", ("B", "A"): "y", ("tie", "tie"): "tie", ("A", "A"): "inconsistent", ("error", "A"): "error", ("A", "tie"): "inconsistent"}
    got = values(spark, list(cases), "ab string, ba string", verdicts.resolve_winner(F.col("ab"), F.col("ba"), F.lit("x"), F.lit("y")))
    assert [g[0] for g in got] == list(cases.values())


def test_strip_takes_all_white_space(spark):
    assert values(spark, [("\u3000\x1c a b\u0085\n",), (None,)], "t string", verdicts.strip(F.col("t")), verdicts.has_text(F.col("t"))) == [("a b", True), (None, False)]


SINGLE = "seq long, lang string, judge_id string, model_id string, question_id long, category string, score_turn1 double, score_turn2 double, tstamp double"


def test_missing_times_in_the_three_policies(spark):
    for order in ((1, 2), (2, 1)):
        for other, by_null, by_zero in ((0.0, "value", "later"), (-1.0, "value", "null")):
            rows = [(order[0], "en", "j", "m", 1, "math", 1.0, 1.0, None), (order[1], "en", "j", "m", 1, "math", 2.0, 2.0, other)]
            df = spark.createDataFrame(rows, SINGLE)
            kept = {"null": 1.0, "value": 2.0, "later": 2.0 if order[1] == 2 else 1.0}
            assert dedup.single(df).first()["score_turn1"] == kept[by_null]
            assert dedup.artifact(df).first()["score_turn1"] == kept[by_zero]


def test_single_scores_of_copies(spark):
    rows = [(1, "en", "j", "model-a", 1, "math", 1.0, 3.0, 1.0), (2, "en", "j", "model-a", 2, "math", 5.0, -1.0, 1.0), (0, "en", "j", "model-a", 1, "math", 7.0, 9.0, 2.0)]
    r = metrics.single_scores(dedup.single(spark.createDataFrame(rows, SINGLE)), ["model_id"], 2).first()
    assert (r["n_questions"], r["observed"], r["expected"], r["n_samples"], r["failures"], r["failure_rate"], r["overall"]) == (2, 4, 4, 3, 1, 0.25, 7.0)


def test_win_rates_of_a_few_games(spark):
    schema = "seq long, judge_id string, question_id long, turn int, category string, model_a string, model_b string, winner_ab string, winner_ba string, winner string, tstamp double"
    games = [("A", "B", "a"), ("A", "A", "inconsistent"), ("error", "A", "error"), ("tie", "tie", "tie"), ("A", "B", "a")]
    rows = [(k, "j", 1 if k == 4 else k + 1, 2, "math", "a", "b", ab, ba, w, 1.0) for k, (ab, ba, w) in enumerate(games)]
    out = {r["model_id"]: r for r in metrics.win_rates(dedup.pairwise(spark.createDataFrame(rows, schema)), []).collect()}
    a = out["a"]
    assert (a["n_pairs_total"], a["n_games"], a["n_consistent_games"], a["n_inconsistent"], a["n_errors"]) == (4, 3, 2, 1, 1)
    assert (a["overall"], a["overall_consistent_only"]) == (pytest.approx(2 / 3), 0.75)
    assert (out["b"]["overall"], out["b"]["overall_consistent_only"]) == (pytest.approx(1 / 3), 0.25)


def test_gates_raise_with_rows(spark):
    df = spark.createDataFrame([(1, "en", "j", "m", 1, "math", 99.0, 1.0, 1.0)], SINGLE)
    with pytest.raises(gates.GateError, match="99"):
        gates.require_none(gates.violations(df, gates.single_rules()), "invalid judgments")
    gates.require_none(gates.violations(df.where("false"), gates.single_rules()), "invalid judgments")


def test_references_are_resolved(spark):
    q = spark.createDataFrame([(1, "math", ["r", ""]), (2, "math", ["r", "s"]), (3, "stem", ["r", "s"]), (4, "coding", None)], "question_id long, category string, reference array<string>")

    def of(*seen, **options):
        observed = spark.createDataFrame([(m, i) for m, ids in seen for i in ids], "model_id string, question_id long")
        return sorted(r[0] for r in coverage.resolve_references(q, observed, **options).collect())

    assert of() == [2] and of(("m", [1, 2])) == [1, 2] and of(("m", [2]), ("n", [2])) == [2]
    assert of(("m", [1]), allow_partial=True) == [1, 2] and of(selection="historical-declared") == [1, 2]
    for bad in ([("m", [1]), ("n", [2])], [("m", [1])], [("m", [1, 2, 3])]):
        with pytest.raises(gates.GateError):
            of(*bad)


def test_bleu(spark):
    pairs = [("a b c d e", "a b c d e"), ("a b c d", "a b c d e f"), ("", "a b"), ("a b c", "a b c"), ("x y z w", "a b c d"), ("A b\u3000c d d d d d", "a b c d d")]

    def want(h, r):
        h, r = h.lower().split(), r.lower().split()
        total = 0.0
        for n in range(1, 5):
            own, other = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (h, r))
            met = sum(min(c, other[g]) for g, c in own.items())
            if not met:
                return 0.0
            total += math.log(met / sum(own.values()))
        return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(total / 4)

    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id long, h string, r string")
    got = {r["id"]: r["bleu"] for r in text.bleu(df, "id", "h", "r").collect()}
    assert got == {k: pytest.approx(want(*p)) for k, p in enumerate(pairs)}


@pytest.mark.parametrize("n", [60_000, 2_200_000])
def test_ranks_of_large_groups(spark, n):
    """Squares of ranks beyond int, cubes of the number of rows beyond long."""
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("x"), (-F.col("id")).alias("y"), "id")
    assert [tuple(r) for r in text.spearman(df, "g", "x", "y", "id").collect()] == [("g", n, -1.0)]


def test_ranks_of_nulls(spark):
    """Nulls are last, as in the SQL."""
    df = spark.createDataFrame([("g", None, 1, 1), ("g", 1, 2, 2), ("g", 2, 3, 3), ("h", 1, 1, 4), ("h", None, 2, 5)], "g string, x int, y int, id long")
    assert sorted(tuple(r) for r in text.spearman(df, "g", "x", "y", "id").collect()) == [("g", 3, -0.5), ("h", 2, None)]


def test_strict_lines(spark, tmp_path):
    good = {"question_id": 81, "category": "math", "turns": ["a", "b"], "reference": None}
    (tmp_path / "model-a 2.jsonl").write_text("# note\n\n" + json.dumps(good) + "\n")
    (tmp_path / "model-a.jsonl").write_text(json.dumps(good | {"question_id": 82}) + "\n" + json.dumps(good | {"question_id": 83}))
    rows = jsonl.read(spark, str(tmp_path / "*.jsonl"), schemas.QUESTION, ("question_id", "turns")).orderBy("seq").collect()
    assert [r["question_id"] for r in rows] == [81, 82, 83]
    for bad in ("not-json", '{"question_id": NaN}', json.dumps(good) + " x", json.dumps({"category": "x"}), '{"question_id": true, "turns": []}', "[1]"):
        (tmp_path / "model-a.jsonl").write_text(bad)
        with pytest.raises(PySparkException, match="refused line in .*model-a.jsonl"):
            jsonl.read(spark, str(tmp_path / "model-a.jsonl"), schemas.QUESTION, ("question_id", "turns")).count()
        assert jsonl.refused(spark, str(tmp_path / "model-a.jsonl"), schemas.QUESTION, ("question_id", "turns")).count() == 1


def test_lines_that_two_parsers_take_alike(spark):
    """What goes to Python is what Spark's parser refuses; both together say what Python alone says."""
    cases = ['{"k": 1}', '  {"k": 1} ', '{"k": NaN}', '{"k": -Infinity}', '{"k":1} x', '{"k":1}{"k":2}', '{"k":1}] [', '{"k":1}} {', '{"k":1},{"k":2}', '{"k":1}, "b"', '{"k":1}, "b":1', '{"a":1,"a":2}', "[1]", '"s"', "null", "",
             '{"k":1,}', "{'k':1}", '{"k":01}', '{"k":1e400}', '{"k":"\\ud800"}', '{"k":"a\tb"}', "{k:1}", '{"k": {"v": [1, {}]}}', "{}", '{"k": ' + "[" * 1100 + "]" * 1100 + "}", "// c", '{"k":1}//']
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id long, line string")
    for nan in (False, True):
        got = {r["id"]: r["why"] for r in df.select("id", jsonl.check("line", nan).alias("why")).collect()}
        assert got == {k: jsonl.line_error(c, nan) for k, c in enumerate(cases)}
    taken = {r["id"] for r in df.where(jsonl.is_object(F.col("line"))).collect()}
    assert all(jsonl.line_error(cases[k]) is None for k in taken) and len(taken) >= 6


def test_verdicts_of_validity():
    body = dict.fromkeys(validity.SCORES, 4) | {"issue_summary": "s", "needs_manual_check": False}
    assert validity.verdict_of(json.dumps(body))["parse_status"] == "ok"
    assert validity.verdict_of("```json\n" + json.dumps(body) + "\n```")["overall_score"] == 4
    low = validity.verdict_of(json.dumps(body | {"constraint_preservation": 3}))
    assert low["needs_manual_check"] and "forced" in low["parse_status"]
    for bad in (True, 0, 6, 4.0, "4"):
        out = validity.verdict_of(json.dumps(body | {"overall_score": bad}))
        assert out["overall_score"] == -1 and out["needs_manual_check"] and out["parse_status"].startswith("invalid")
    for bad in ("", None, "so: " + json.dumps(body), "[]", json.dumps(body | {"more": 1}), json.dumps(body | {"needs_manual_check": "false"})):
        assert validity.verdict_of(bad)["semantic_preservation"] == -1


def test_verdicts_as_columns(spark):
    body = dict.fromkeys(validity.SCORES, 4) | {"issue_summary": "s" * 400, "needs_manual_check": False}
    whole = json.dumps(body)
    cases = [whole, f"```json\n{whole}\n```", f"```\n{whole}```", f" \u3000{whole}\n", "", None, "so: " + whole, "[]", whole + " x", whole + "}", f"```{whole}", json.dumps(body | {"more": 1})]
    cases += [json.dumps(body | {"overall_score": x}) for x in (True, 0, 1, 3, 5, 6, 4.0, "4", None)] + [json.dumps(body | {"constraint_preservation": 2, "needs_manual_check": True})]
    cases += [json.dumps(body | {"needs_manual_check": "false"}), json.dumps(body | {"issue_summary": 1}), json.dumps({k: v for k, v in body.items() if k != "overall_score"}), whole[:-1] + ', "overall_score": 2}']
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id long, r string")
    got = {r["id"]: r["v"].asDict() for r in df.select("id", validity.parse_verdict(F.col("r")).alias("v")).collect()}
    assert got == {k: {c: v for c, v in validity.verdict_of(r).items()} for k, r in enumerate(cases)}


def test_calls_retry_and_carry_errors(spark):
    waits, tries = [], []

    def chat(messages):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("status 429")
        return " " if len(tries) == 2 else "[[7]]"

    assert judging.ask(chat, [], sleep=waits.append) == ("[[7]]", None) and waits == [10.0, 5.0]
    assert judging.ask(lambda m: "", [], sleep=waits.append)[1] == "blank response"
    rows = spark.createDataFrame([(1, [("user", "hello")])], "id long, messages array<struct<role:string,content:string>>")
    out = judging.grade(rows, lambda: lambda m: f"Rating: [[{len(m[0]['content'])}]]").first()
    assert (out["score"], out["error"]) == (5.0, None)
    assert judging.grade(rows).first()["score"] == 7.0


def test_publish_replaces_what_it_was_made_from(spark, tmp_path):
    at = str(tmp_path / "rows")
    assert not published.exists(spark, at)
    for k in range(4):
        now = spark.createDataFrame([(2, f"c{k}"), (3 + k, "d")], "id long, v string")
        published.publish(merge.upsert(published.read(spark, at), now, "id") if k else now, at, "parquet", ("id",))
    assert [tuple(r) for r in published.read(spark, at).collect()] == [(2, "c3"), (3, "d"), (4, "d"), (5, "d"), (6, "d")]
    assert len(list((tmp_path / "rows" / "data").iterdir())) == 2  # the version before stays for its readers


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    at, schema = str(tmp_path / "rows"), "seq long, id long, v string"
    merge_batch(spark.range(100).selectExpr("id as seq", "id", "'old' as v"), at, ["id"], parts=4)
    batch = spark.createDataFrame([(k, 95 + k, "new") for k in range(10)], schema)

    def dies(*_, **__):
        raise OSError("gone")

    monkeypatch.setattr(published, "commit", dies)
    with pytest.raises(OSError):
        merge_batch(batch, at, ["id"])
    monkeypatch.undo()
    assert published.read(spark, at).where("v = 'old'").count() == published.read(spark, at).count() == 100
    for _ in range(2):  # run again, and once more as after a restart
        merge_batch(batch, at, ["id"])
        rows = {r["id"]: r["v"] for r in published.read(spark, at).collect()}
        assert len(rows) == 105 and {rows[k] for k in range(95)} == {"old"} and {rows[k] for k in range(95, 105)} == {"new"}


def test_batches_write_only_the_parts_they_touch(spark, tmp_path):
    at = str(tmp_path / "rows")
    merge_batch(spark.range(1000).selectExpr("id as seq", "id", "'old' as v"), at, ["id"], parts=16)
    before = published.parts(spark, at)
    merge_batch(spark.createDataFrame([(1, 7, "new"), (0, 7, "older")], "seq long, id long, v string"), at, ["id"], parts=99)
    after = published.parts(spark, at)
    assert len(before) == len(after) == 16 and sum(before[k] != after[k] for k in before) == 1
    assert published.read(spark, at).where("v <> 'old'").select("id", "v").collect() == [(7, "new")] and published.read(spark, at).count() == 1000


def test_stream_of_upserts(spark, tmp_path):
    source = tmp_path / "in"
    for rows in [[(1, 1, "a"), (2, 2, "b"), (3, 1, "c")], [(4, 2, "d"), (5, 9, "e")]]:
        spark.createDataFrame(rows, "seq long, id long, v string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("seq long, id long, v string").parquet(str(source))
        merge_stream(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "checkpoint"), parts=4).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in published.read(spark, str(tmp_path / "out")).collect()) == [(1, "c"), (2, "d"), (9, "e")]


def test_report_files(tmp_path):
    assert [sinks.number(x, 2) for x in (2.675, 0.125, None, 3)] == ["2.67", "0.12", "NaN", "3"]
    path = tmp_path / "t.csv"
    sinks.write_csv([{"a": 1.5, "b": float("nan")}], str(path), ["a", "b", "c"], {"single": {"c"}}, table="single")
    assert path.read_text() == "a,b,c\n1.5000,NaN,\n"
    with pytest.raises(ValueError):
        sinks.write_csv([{"z": 1}], str(path), ["a"])
    assert "N/A" in sinks.leaderboard_text([{"m": "x", "s": None}], ["m", "s"])


def test_csv_and_digests(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'two\nlines "quoted"')]
    assert sinks.manifest_lines(files.digests(spark, str(tmp_path)))[0].endswith("  a.csv")


def test_secrets_in_whole_documents(spark, tmp_path):
    """Each form is found wherever a text holds it, in rows of any id; forms that fall short are not."""
    from assayer.plans.catalog import QUERIES

    long = "word " * 20_000
    cases = [("x sk-" + "a1" * 16 + " y", "OpenAI-style key"), ("ghp_" + "Zz" * 10, "GitHub token"), ("AKIA" + "Q7" * 8, "AWS access key"), ("hf_" + "b" * 29, ""), ("hf_" + "b" * 30, "Hugging Face token"), ("plain", ""), ("", ""), (None, "")]
    cases += [(long + f"AKIA{'Q7' * 8} github_pat_{'z' * 20}, hf_{'c' * 40}", "GitHub token,AWS access key,Hugging Face token")]
    spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["found"] for r in QUERIES["secret_scan_documents"](spark, str(tmp_path)).collect()}
    assert got == {k: found for k, (_, found) in enumerate(cases)}


def test_answers_and_pairs_with_gaps(spark, sf_dir):
    """Every question, model and pair is there, with what is missing; nothing is left out by its id."""
    q = spark.createDataFrame([(i, "math") for i in (81, 82, 83)], "question_id long, category string")
    rows = [(1, "en", "j", "m0", 81), (2, "en", "j", "m1", 81), (3, "en", "j", "m2", 81), (4, "en", "j", "m0", 82), (5, "en", "j", "m2", 82), (6, "ko", "j", "m0", 83), (7, "en", "j", "m0", 99)]
    found = spark.createDataFrame(rows, "seq long, lang string, judge_id string, model_id string, question_id long")
    got = {(r["lang"], r["model_id"], r["question_id"]): r["state"] for r in coverage.answers(q, found, "lang", "judge_id").collect()}
    have = {(r[1], r[3], r[4]) for r in rows}
    runs = [("en", "m0"), ("en", "m1"), ("en", "m2"), ("ko", "m0")]
    assert got == {(*r, i): "met" if (*r, i) in have else "missing" for r in runs for i in (81, 82, 83)}
    pairs = {(r["model_a"], r["model_b"], r["question_id"]): (r["seq_a"], r["seq_b"], r["state"]) for r in coverage.paired_answers(q, found, "lang", "judge_id").collect()}
    seq = {("m0", 81): 1, ("m1", 81): 2, ("m2", 81): 3, ("m0", 82): 4, ("m2", 82): 5}
    want = {(a, b, i): (seq.get((a, i)), seq.get((b, i))) for a, b in (("m0", "m1"), ("m0", "m2"), ("m1", "m2")) for i in (81, 82, 83)}
    assert pairs == {k: (*v, "met" if None not in v else "missing") for k, v in want.items()}
    keys = ["judge_id", "model_id", "question_id"]
    expected = spark.createDataFrame([("j", "m0", 1), ("k", "m0", 1)], "judge_id string, model_id string, question_id long")
    observed = spark.createDataFrame([("j", "m0", 1), ("k", "m0", 2)], "judge_id string, model_id string, question_id long")
    assert sorted(map(tuple, coverage.gaps(expected, observed, *keys).collect())) == [("j", "m0", 1, "met"), ("k", "m0", 1, "missing"), ("k", "m0", 2, "unexpected")]

    from assayer.plans.catalog import QUERIES

    j = QUERIES["dedup_single"](spark, sf_dir).collect()
    assert sum(r["state"] == "met" for r in QUERIES["join_qa_all"](spark, sf_dir).collect()) == len(j)
    assert len({(r["model_a"], r["model_b"]) for r in QUERIES["join_pair_all"](spark, sf_dir).select("model_a", "model_b").distinct().collect()}) == 15
    assert {r[0] for r in QUERIES["coverage_gaps_judges"](spark, sf_dir).select("judge_id").distinct().collect()} == {r["judge_id"] for r in j}
