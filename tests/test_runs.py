"""Resumed runs of every protocol, strict aggregation, sources of whole folders, imports."""

from __future__ import annotations

import json
from contextlib import nullcontext

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import fingerprints
from assayer.operators import aggregation, coverage, gates, protocols, published, release, resume
from assayer.sources import files, jsonl

BACKEND = fingerprints.identity("test", "http://localhost")
ANSWERS = "question_id long, model_id string, choices array<struct<index:int,turns:array<string>>>, tstamp double, input_sha256 string"


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(81, "math", ["q1 of 81", "q2 of 81"], ["r1", "r2"]), (82, "writing", ["q1 of 82", "q2 of 82"], None), (83, "coding", ["q1 of 83", "q2 of 83"], ["r1", " "])]
    return spark.createDataFrame(rows, schemas.QUESTION).cache()


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(q, m, [(0, [f"{m} one {q}", f"{m} two {q}"])], 1.0, "h") for q in (81, 82, 83) for m in ("m0", "m1", "m2") if (q, m) != (83, "m2")]
    return spark.createDataFrame(rows, ANSWERS).cache()


def failing(word):
    """A service that fails on messages that hold a word."""

    def make():
        def chat(messages):
            text = messages[-1]["content"]
            if word in text:
                raise RuntimeError("refused")
            return "Both. [[C]]" if "Assistant A" in text else "Good. Rating: [[8]]" if "<answer>" in text or "Assistant 1" in text else f"answer to: {text}"

        return chat

    return make


def test_generation_is_resumed(spark, questions, tmp_path):
    at = str(tmp_path / "answers")
    units = protocols.generation_units(questions, ["m0", "m1"], BACKEND, system="be brief")

    def call(make):
        return lambda pending, journal: protocols.generate(pending, make, attempts=1, delay=0, journal=journal)

    with pytest.raises(resume.IncompleteRun, match="2 units"):
        resume.run(spark, at, units, resume.GENERATION, call(failing("q2 of 82")), ANSWERS)
    kept = published.read(spark, at).collect()
    assert [(r["question_id"], r["model_id"]) for r in kept] == [(81, "m0"), (81, "m1"), (83, "m0"), (83, "m1")]
    assert kept[0]["choices"][0]["turns"] == ["answer to: be brief\n\nq1 of 81", "answer to: q2 of 81"]
    stamps = {(r["question_id"], r["model_id"]): r["tstamp"] for r in kept}
    final = resume.run(spark, at, units, resume.GENERATION, call(failing("nothing")), ANSWERS)
    assert final.count() == 6 and all(r["tstamp"] == stamps[r["question_id"], r["model_id"]] for r in final.collect() if (r["question_id"], r["model_id"]) in stamps)
    # A changed question is stale even if its new call fails; one that is no longer asked goes.
    changed = questions.where("question_id <> 83").withColumn("turns", F.expr("transform(turns, x -> concat('new ', x))"))
    units = protocols.generation_units(changed, ["m0", "m1"], BACKEND, system="be brief")
    final = resume.run(spark, at, units, resume.GENERATION, call(failing("new")), ANSWERS, allow_partial=True)
    assert final.count() == 0
    other = protocols.generation_units(questions, ["m0"], fingerprints.identity("another")).select("input_sha256")
    assert other.intersect(protocols.generation_units(questions, ["m0"], BACKEND).select("input_sha256")).count() == 0


def test_single_grades_are_resumed(spark, questions, answers, tmp_path):
    at = str(tmp_path / "single")
    units = protocols.single_units(questions, answers, "judge", BACKEND)
    missing = protocols.unanswered(questions, answers, ["m0", "m1", "m2"], "judge")
    with pytest.raises(resume.IncompleteRun, match="'why': 'missing'"):
        resume.run(spark, at, units, resume.SINGLE, lambda p, journal: protocols.grade_single(p, failing("nothing"), journal=journal), schemas.SINGLE, missing)
    rows = published.read(spark, at).collect()
    assert len(rows) == 8 and {(r["score_turn1"], r["score_turn2"], r["avg_score"]) for r in rows} == {(8.0, 8.0, 8.0)}
    # Broken records are called again, sound ones are not; a reference that plain grading does not use makes nothing stale.
    broken = published.read(spark, at).selectExpr("* except (judgment_turn2)", "if(model_id = 'm1', ' ', judgment_turn2) as judgment_turn2").select(*published.read(spark, at).columns)
    published.publish(broken, at, "parquet")
    called = []

    def call(pending, journal):
        called.extend(sorted(tuple(r) for r in pending.select("question_id", "model_id").collect()))
        return protocols.grade_single(pending)

    units = protocols.single_units(questions.selectExpr("question_id", "category", "turns", "array('x', 'y') as reference"), answers, "judge", BACKEND)
    resume.run(spark, at, units, resume.SINGLE, call, schemas.SINGLE)
    assert called == [(81, "m1"), (82, "m1"), (83, "m1")]
    again = resume.run(spark, at, units, resume.SINGLE, call, schemas.SINGLE, resume=False)
    assert len(called) == 11 and again.count() == 8


@pytest.mark.parametrize("references", [False, True])
def test_pairs_are_resumed(spark, questions, answers, tmp_path, references):
    at = str(tmp_path / f"pairs{references}")
    units = protocols.pair_units(questions, answers, "judge", BACKEND, references=references)
    asked = {81} if references else {81, 82, 83}
    with pytest.raises(resume.IncompleteRun) if not references else nullcontext():
        missing = protocols.unanswered_pairs(protocols.with_references(questions) if references else questions, answers, ["m0", "m1", "m2"], "judge")
        resume.run(spark, at, units, resume.PAIRWISE, lambda p, journal: protocols.judge_pairs(p, failing("nothing"), journal=journal), schemas.PAIRWISE, missing)
    rows = published.read(spark, at).collect()
    assert {r["question_id"] for r in rows} == asked and {r["winner"] for r in rows} == {"tie"} and {r["turn"] for r in rows} == {2}
    assert len(rows) == (3 if references else 7)
    assert resume.pending_units(published.read(spark, at), units, resume.PAIRWISE).count() == 0
    odd = published.read(spark, at).withColumn("winner", F.lit("m0"))
    assert resume.pending_units(odd, units, resume.PAIRWISE).count() == len(rows)


def test_reference_grades_are_resumed(spark, questions, answers, tmp_path):
    at = str(tmp_path / "reference")
    units = protocols.reference_single_units(questions, answers, "judge", BACKEND)
    final = resume.run(spark, at, units, resume.REFERENCE_SINGLE, lambda p, journal: protocols.grade_reference_single(p, failing("nothing"), journal=journal), schemas.SINGLE)
    assert sorted((r["question_id"], r["score_turn1"], r["score_turn2"], r["judgment_turn1"], r["avg_score"]) for r in final.collect()) == [(81, -1.0, 8.0, "", None)] * 3
    declared = protocols.reference_single_units(questions, answers, "judge", BACKEND, selection="historical-declared")
    assert sorted({r[0] for r in declared.select("question_id").collect()}) == [81, 83]
    with pytest.raises(ValueError):
        protocols.with_references(questions, "other")


def _records(models, ids):
    single = [(q, m, "j", 5.0, 6.0, "a", "b", "math", 1.0, "h", None, k) for k, (q, m) in enumerate((q, m) for q in ids for m in models)]
    pairs = [(q, a, b, "j", "tie", "x", "y", "tie", "tie", 2, "math", 1.0, "h", k) for k, (q, a, b) in enumerate((q, a, b) for q in ids for a in models for b in models if a < b)]
    return single, pairs


def test_strict_aggregation(spark):
    ids, models = [81, 82], ["m0", "m1", "m2"]
    q = spark.createDataFrame([(i, "math", ["a", "b"], ["r", "s"]) for i in ids], schemas.QUESTION)
    single, pairs = _records(models, ids)
    s = spark.createDataFrame(single, f"{schemas.SINGLE}, seq long")
    p = spark.createDataFrame(pairs, f"{schemas.PAIRWISE}, seq long")
    found = aggregation.aggregate(s, p, s, q)
    assert {(r["model_id"], r["overall"], r["expected"]) for r in found.single.collect()} == {(m, 5.5, 4) for m in models}
    assert {(r["model_id"], r["overall"], r["n_expected_pairs"], r["n_games"]) for r in found.win_rates.collect()} == {(m, 0.5, 4, 4) for m in models}
    assert {(r["model_id"], r["overall"]) for r in found.reference.collect()} == {(m, 6.0) for m in models}
    for odd in ((s.where("seq > 0"), p, s), (s, p.where("seq > 0"), s), (s, p, s.where("seq > 0"))):
        with pytest.raises(gates.GateError):
            aggregation.aggregate(*odd, q, selection="usable-turn2")
        aggregation.aggregate(*odd, q, selection="usable-turn2", allow_partial=True).single.count()
    with pytest.raises(gates.GateError, match="1 missing, 1 unexpected"):
        coverage.require_met(coverage.single_gaps(s.where("model_id = 'm0'").replace(82, 99, "question_id"), q, s.where("model_id = 'm0'")), "single")
    with pytest.raises(gates.GateError):
        aggregation.aggregate(s, p, s, q, models=[*models, "m9"])
    with pytest.raises(gates.GateError, match="multiple judge_id"):
        aggregation.aggregate(s.unionByName(s.replace("j", "other", "judge_id")), p, s, q)
    alone = aggregation.aggregate(s, p, s, models=["m0", "m1", "m9"]).win_rates.collect()
    assert {(r["model_id"], r["n_games"]) for r in alone} == {("m0", 2), ("m1", 2), ("m9", 0)}


def test_folders_of_judgments(spark, tmp_path):
    root = tmp_path / "data"
    for lang, judge, name, ids in (("en", "j1", "m a", (81, 82)), ("en", "j1", "m b", (81,)), ("ko", "j2", "m a", (83,))):
        folder = root / lang / "judgments" / "fam" / judge / "single_grade"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.jsonl").write_text("".join(json.dumps({"question_id": i, "model_id": "named", "judge_id": judge, "score_turn1": 3}) + "\n" for i in ids))
    rows = jsonl.judgments(spark, str(root), "single_grade", schemas.SINGLE).orderBy("seq").collect()
    assert [(r["lang"], r["judge_key"], r["protocol"], r["file_name"], r["question_id"], r["model_id"]) for r in rows] == [
        ("en", "j1", "single_grade", "m a", 81, "named"), ("en", "j1", "single_grade", "m a", 82, "named"),
        ("en", "j1", "single_grade", "m b", 81, "named"), ("ko", "j2", "single_grade", "m a", 83, "named"),
    ]
    folder = str(root / "en" / "judgments" / "fam" / "j1" / "single_grade")
    assert jsonl.stems(spark, folder) == ["m a", "m b"] and jsonl.stems(spark, folder + "/none") == []


def test_question_files_and_written_lines(spark, tmp_path):
    good = [{"question_id": i, "category": "math", "turns": ["a", "b"], "reference": None} for i in (83, 81)]
    at = tmp_path / "q.jsonl"
    at.write_text("\n".join(map(json.dumps, good)))
    assert [r["question_id"] for r in jsonl.questions(spark, str(at)).collect()] == [81, 83]
    for odd in (good[0], good[0] | {"question_id": 90, "turns": ["a"]}):
        at.write_text("\n".join(map(json.dumps, [*good, odd])))
        with pytest.raises(gates.GateError):
            jsonl.questions(spark, str(at))
    at.write_text('{"question_id": 1, "category": "x", "turns": ["a"], "score": NaN}\n# kept\n')
    schema = "question_id long, score double"
    assert jsonl.read(spark, str(at), schema, nan=True).collect()[0]["score"] != 0
    with pytest.raises(PySparkException):
        jsonl.read(spark, str(at), schema, nan=True, comments=False).count()
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "한글", 1.5), (2, None, None)], "id long, t string, x double")
    assert jsonl.write(df, out) == 2 and jsonl.write(df.limit(1), out, "append") == 1
    lines = sorted(r[0] for r in spark.read.text(out).collect())
    assert lines == ['{"id":1,"t":"한글","x":1.5}', '{"id":1,"t":"한글","x":1.5}', '{"id":2,"t":null,"x":null}']
    with pytest.raises(PySparkException, match="no JSON"):
        jsonl.write(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "nan"))


def test_imports_and_listings(spark, tmp_path):
    for name in ("run/en/a.jsonl", "run/ko/b.jsonl", "tree/.git/x", "tree/src/a.py", "tree/src/p.egg-info/y", "tree/.env.local", "tree/log.LOG", "tree/한 글/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    pairs = [(str(tmp_path / "run" / lang), str(tmp_path / "data" / lang)) for lang in ("en", "ko")]
    with pytest.raises(ValueError):
        files.import_folders(spark, pairs, lambda: False)
    assert not (tmp_path / "data" / "en").exists() and not (tmp_path / "data" / "ko").exists()
    files.import_folders(spark, pairs, lambda: (tmp_path / "data" / "ko" / "b.jsonl").exists())
    with pytest.raises(FileExistsError):
        files.import_folders(spark, pairs, lambda: True)
    assert sorted(map(tuple, files.listing(spark, str(tmp_path / "tree")).collect())) == [("src/a.py", 4), ("한 글/c.txt", 4)]
    assert [r["path"] for r in files.digests(spark, str(tmp_path / "data")).orderBy("path").collect()] == ["en/a.jsonl", "ko/b.jsonl"]


def test_golden_cells_and_answers(spark, answers, questions):
    results = spark.createDataFrame([("a", 1.004), ("b", 2.0)], "k string, x double")
    golden = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 1.0)], "k string, x double")
    assert {(r["k"], r["ok"]) for r in release.equal_cells(results, golden, ["k"], "x", 0.005).collect()} == {("a", True), ("b", False), ("c", False)}
    named = answers.selectExpr("*", "'en' as lang", "model_id as file_name")
    checks = {r["name"]: r["ok"] for r in release.answer_checks(named, questions.selectExpr("*", "'en' as lang"), ["m0", "m1", "m2"]).collect()}
    assert checks == {"models": True, "ids": False, "records": True}


def test_exact_numbers_of_questions(spark, questions):
    gates.require_questions(questions, 3)
    for odd, said in ((questions.limit(2), "exactly 3"), (questions.unionByName(questions.limit(1)), "repeated"), (questions.withColumn("turns", F.array(F.lit("one"))), "exactly 2 turns")):
        with pytest.raises(gates.GateError, match=said):
            gates.require_questions(odd, 3)
    gates.require_complete(questions.where("false"))
    with pytest.raises(gates.GateError, match="3 rows"):
        gates.require_complete(questions.select("question_id"))
