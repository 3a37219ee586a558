"""Runs that are killed and taken up again: at each publish, inside a task, and while another writer publishes."""

from __future__ import annotations

import os
import threading
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import fingerprints
from assayer.operators import gates, merge, protocols, published, resume, translation
from assayer.operators.journal import Journal
from assayer.operators.judging import respond

BACKEND = fingerprints.identity("test", "http://localhost")
ANSWERS = "question_id long, model_id string, choices array<struct<index:int,turns:array<string>>>, tstamp double, input_sha256 string"


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, "math" if i % 2 else "writing", [f"첫째 {i}", f"둘째 {i}"], [f"답 {i}", " "] if i % 2 else None) for i in range(81, 87)]
    return spark.createDataFrame(rows, schemas.QUESTION).cache()


def counting(folder, dies_at=None, refuses=None):
    """A service that notes each call it answers in a file, and kills its process once, at a word."""
    folder = str(folder)

    def make():
        def chat(messages):
            text = messages[-1]["content"]
            if refuses and refuses in text:
                raise RuntimeError("refused")
            if dies_at and dies_at in text and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
            with open(f"{folder}/calls", "a", encoding="utf-8") as f:
                f.write(repr(text) + "\n")
            return '{"semantic_preservation": 5, "difficulty_preservation": 4, "constraint_preservation": 5, "overall_score": 5, "issue_summary": "", "needs_manual_check": false}' if "Original:" in text else f"en({text[-5:]})"

        return chat

    return make


def calls(folder):
    at = folder / "calls"
    return Counter(at.read_text(encoding="utf-8").splitlines()) if at.exists() else Counter()


def test_killed_inside_a_task(spark, questions, tmp_path):
    """The worker's process dies; what it and others had answered before is not asked again."""
    at, make = str(tmp_path / "answers"), counting(tmp_path, dies_at="둘째 84")
    units = protocols.generation_units(questions, ["m0", "m1"], BACKEND).repartition(2)

    def run():
        return resume.run(spark, at, units, resume.GENERATION, lambda p, journal: protocols.generate(p, make, attempts=1, delay=0, journal=journal), ANSWERS)

    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)python worker exited|crashed"):
        run()
    before = calls(tmp_path)
    assert before and (tmp_path / "died").exists()
    assert run().count() == 12
    assert len(calls(tmp_path)) == 12 and set(calls(tmp_path).values()) == {2}  # two models have the same texts
    assert not os.path.exists(f"{at}.journal")


@pytest.mark.parametrize("staged", [False, True])
def test_killed_at_each_publish(spark, questions, tmp_path, monkeypatch, staged):
    real, at = published.publish, str(tmp_path / "translated")
    make, units = counting(tmp_path), translation.units(questions, BACKEND)

    def run():
        return resume.run(
            spark, at, units, resume.TRANSLATION, lambda p, journal: translation.translate(p, make, attempts=1, delay=0, journal=journal), translation.TRANSLATED, staged=staged
        )

    for killed_at in range(1, 4 + staged):
        done = []

        def publish(*args, killed_at=killed_at, done=done, **more):
            done.append(1)
            if len(done) == killed_at:
                raise KeyboardInterrupt
            return real(*args, **more)

        monkeypatch.setattr(published, "publish", publish)
        with pytest.raises(KeyboardInterrupt):
            run()
        assert not (staged and published.exists(spark, at))
    monkeypatch.setattr(published, "publish", real)
    assert run().count() == 6
    assert sum(calls(tmp_path).values()) == 12 + 3 + 3 and max(calls(tmp_path).values()) <= 3  # blank references are three units' own
    assert not os.path.exists(f"{at}.stage") or not staged


def test_tasks_that_are_tried_again(spark, tmp_path):
    """A second attempt of a plan reads what the first one wrote."""
    df = spark.range(4).select("id", F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("q"), "id").alias("content"))).alias("messages")).repartition(2)
    journal = Journal(str(tmp_path / "journal"), ("id",))
    asked = respond(df, counting(tmp_path), journal=journal)
    assert asked.count() == 4 and asked.count() == 4
    assert set(calls(tmp_path).values()) == {1}
    assert journal.answers(spark).count() == 4
    assert respond(df.repartition(3), counting(tmp_path), journal=journal).where("response is not null").count() == 4
    assert respond(df, None, journal=Journal(str(tmp_path / "none"), ("id",))).count() == 4 and not (tmp_path / "none").exists()
    assert sum(calls(tmp_path).values()) == 4


def test_answers_of_no_use_are_asked_again(spark, questions, tmp_path):
    at, asked = str(tmp_path / "single"), []
    answers = questions.select("question_id", F.lit("m0").alias("model_id"), F.array(F.struct(F.lit(0).alias("index"), F.array(F.lit("a"), F.lit("b")).alias("turns"))).alias("choices"))
    units = protocols.single_units(questions, answers, "judge", BACKEND)
    odd = units.withColumn("input_sha256", F.lit("other"))

    def call(pending, journal):
        asked.append(pending.count())
        return protocols.grade_single(pending.withColumn("input_sha256", F.lit("made of something else")) if len(asked) == 1 else pending, counting(tmp_path), journal=journal)

    with pytest.raises(resume.IncompleteRun):
        resume.run(spark, at, units, resume.SINGLE, call, schemas.SINGLE)
    assert resume.run(spark, at, units, resume.SINGLE, call, schemas.SINGLE).count() == 6
    assert asked == [6, 6] and resume.pending_units(published.read(spark, at), odd, resume.SINGLE).count() == 6


# Translations.
def test_a_staged_run_keeps_the_old_table(spark, questions, tmp_path):
    at, units = str(tmp_path / "back"), translation.units(questions, BACKEND)

    def run(make, of=units, **more):
        call = lambda p, journal: translation.translate(p, make, attempts=1, delay=0, journal=journal)
        return resume.run(spark, at, of, resume.TRANSLATION, call, translation.TRANSLATED, staged=True, **more)

    first = {r["question_id"]: r["tstamp"] for r in run(counting(tmp_path)).collect()}
    rows = {r["question_id"]: r for r in published.read(spark, at).collect()}
    assert rows[81]["turns"] == ["en(첫째 81)", "en(둘째 81)"] and rows[81]["reference"][0] == "en(답 81)" and rows[82]["reference"] is None
    for resumed in (True, False):  # a failure leaves the old table, whether or not the run begins anew
        with pytest.raises(resume.IncompleteRun):
            run(counting(tmp_path, refuses="85"), translation.units(questions, fingerprints.identity("another")), resume=resumed)
        assert {r["question_id"]: r["tstamp"] for r in published.read(spark, at).collect()} == first
    made = sum(calls(tmp_path).values())
    other = translation.units(questions, fingerprints.identity("another"))
    assert run(counting(tmp_path), other).count() == 6
    assert sum(calls(tmp_path).values()) == made + 4  # the five others are kept from the stage
    assert resume.pending_units(published.read(spark, at), units, resume.TRANSLATION).count() == 6


def test_mock_translations_never_count(spark, questions, tmp_path):
    at = str(tmp_path / "mock")
    mocked = translation.units(questions, BACKEND, translation.MOCK)
    resume.run(spark, at, mocked, resume.TRANSLATION, lambda p, journal: translation.translate(p, None, journal=journal), translation.TRANSLATED)
    back = published.read(spark, at)
    assert resume.pending_units(back, mocked, resume.TRANSLATION).count() == 0
    assert resume.pending_units(back, translation.units(questions, BACKEND), resume.TRANSLATION).count() == 6
    assert translation.stale(back, questions, translation.MOCK).count() == 0 and translation.stale(back, questions).count() == 6
    changed = questions.withColumn("category", F.when(F.col("question_id") == 81, "stem").otherwise(F.col("category")))
    assert [r[0] for r in translation.stale(back, changed, translation.MOCK).collect()] == [81]


def test_scores_of_translations(spark, questions, tmp_path):
    original = questions.withColumn("turns", F.transform("turns", lambda t: F.concat(F.lit("the first text of "), t)))
    back = original.withColumn("turns", F.when(F.col("question_id") == 82, F.array(F.get("turns", F.lit(0)), F.lit("other"))).otherwise(F.col("turns")))
    translation.require_alike(original, questions, back, 6)
    for odd in (back.where("question_id <> 81"), back.withColumn("category", F.lit("x")), back.withColumn("turns", F.array(F.lit("a"), F.lit(" ")))):
        with pytest.raises(gates.GateError):
            translation.require_alike(original, questions, odd, 6)
    units, at = translation.score_units(original, questions, back, BACKEND), str(tmp_path / "scores")

    def run(make):
        return resume.run(spark, at, units, resume.VALIDITY, lambda p, journal: translation.score(p, make, attempts=1, delay=0, journal=journal), translation.SCORED)

    with pytest.raises(resume.IncompleteRun, match="'question_id': 83"):
        run(counting(tmp_path, refuses="첫째 83"))
    made = sum(calls(tmp_path).values())
    scored = run(counting(tmp_path))
    assert sum(calls(tmp_path).values()) - made == 2 and made == 11  # the second turn of 83 was answered, but the run had come to its end
    rows = {r["question_id"]: r for r in translation.items(scored).collect()}
    assert (rows[81]["bleu_avg"], rows[81]["overall_avg"], rows[81]["difficulty_turn2"], rows[81]["needs_manual_check"]) == (1.0, 5.0, 4, False)
    assert (rows[82]["bleu_turn1"], rows[82]["bleu_turn2"], rows[82]["bleu_avg"]) == (1.0, 0.0, 0.5)
    table = {r["category"]: r for r in translation.categories(translation.items(scored)).collect()}
    assert set(table) == {"math", "writing", None} and table[None]["n"] == 6 and table[None]["overall_mean"] == 5.0
    for mode, status, overall in ((translation.MOCK, "ok: mock", 4.0), (translation.BLEU_ONLY, "not run: BLEU only", None)):
        own = translation.score(translation.score_units(original, questions, back, BACKEND, mode))
        assert {(r["parse_status_turn1"], r["overall_avg"]) for r in translation.items(own).collect()} == {(status, overall)}
        assert own.where(resume.VALIDITY.whole()).count() == 6


# Several writers.
def test_writers_lose_no_update(spark, tmp_path):
    at, failed = str(tmp_path / "table"), []

    def write(first):
        try:
            for k in range(first, first + 100, 20):
                rows = spark.createDataFrame([(i, f"of {first}") for i in range(k, k + 20)], "id long, who string")
                merge.upsert_published(rows, at, "id")
        except Exception as e:  # a thread's error would be lost
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (0, 100, 50)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    rows = {r["id"]: r["who"] for r in published.read(spark, at).collect()}
    assert sorted(rows) == list(range(200)) and rows[0] == "of 0" and rows[199] == "of 100" and rows[60] in ("of 0", "of 50")


def test_a_late_writer_is_refused(spark, tmp_path):
    at = str(tmp_path / "table")
    one = spark.createDataFrame([(1,)], "id long")
    published.publish(one, at, "parquet")
    base = published.version(spark, at)
    for _ in range(4):
        published.publish(one, at, "parquet")
    with pytest.raises(published.Conflict):
        published.publish(one.limit(0), at, "parquet", base=base)
    assert published.read(spark, at).count() == 1 and len(os.listdir(f"{at}/data")) == 2
    with pytest.raises(ZeroDivisionError):  # not a conflict
        published.update(spark, at, lambda df: 1 / 0)


# Pairs.
def test_pairs_in_list_order_and_turned_records(spark, questions, tmp_path):
    at = str(tmp_path / "pairs")
    answers = questions.select("question_id", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("c"))).alias("model_id"))
    answers = answers.withColumn("choices", F.array(F.struct(F.lit(0).alias("index"), F.array(F.concat(F.lit("one "), "model_id"), F.lit("two")).alias("turns"))))
    listed = protocols.pair_units(questions, answers, "judge", BACKEND, models=["b", "a", "c"])
    assert {tuple(r) for r in listed.select("model_a", "model_b").distinct().collect()} == {("b", "a"), ("b", "c"), ("a", "c")}
    by_name = protocols.pair_units(questions, answers, "judge", BACKEND)

    def judge():
        return lambda m: "[[A]]" if m[-1]["content"].find("one b") < m[-1]["content"].find("one a") else "[[B]]"

    resume.run(spark, at, by_name, resume.PAIRWISE, lambda p, journal: protocols.judge_pairs(p, judge, journal=journal), schemas.PAIRWISE)
    asked = []

    def call(pending, journal):
        asked.append(pending.count())
        return protocols.judge_pairs(pending, judge, journal=journal)

    final = resume.run(spark, at, listed, resume.PAIRWISE, call, schemas.PAIRWISE)
    assert asked == [0] and final.count() == 18
    row = final.where("model_a = 'b' and model_b = 'a'").first()
    old = {(r["winner_ab"], r["winner_ba"], r["winner"]) for r in protocols.judge_pairs(listed.where("model_b = 'a'"), judge).collect()}
    assert {(row["winner_ab"], row["winner_ba"], row["winner"])} == old
    missing = protocols.unanswered_pairs(questions, answers.where("model_id <> 'a'"), ["b", "a", "c"], "judge")
    assert {(r["model_a"], r["model_b"]) for r in missing.collect()} == {("b", "a"), ("a", "c")}
