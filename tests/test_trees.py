"""Files of a release as they lie on disk: written trees, odd names, scans, manifests, cells; and grids of any size."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer import schemas
from assayer.operators import aggregation, audit, coverage, metrics, release
from assayer.sources import files, jsonl

ODD = ("command-r+", "p%20q", "odd%zz", "한 글", "a=b,c")


def test_written_tree_is_read_back(spark, tmp_path):
    root = str(tmp_path / "en")
    rows = [(i, m, "j", float(i)) for m in ODD for i in (83, 81, 82)]
    df = spark.createDataFrame(rows, "question_id long, model_id string, judge_id string, score_turn1 double").repartition(5)
    assert jsonl.write_tree(df, root, jsonl.judgment_file(F.lit("fam"), F.col("judge_id"), F.lit("single_grade"), F.col("model_id")), ["question_id"]) == 5
    folder = tmp_path / "en" / "judgments" / "fam" / "j" / "single_grade"
    assert sorted(os.listdir(folder)) == sorted(f"{m}.jsonl" for m in ODD)
    for m in ODD:
        assert [json.loads(x)["question_id"] for x in (folder / f"{m}.jsonl").read_text(encoding="utf-8").splitlines()] == [81, 82, 83]
    back = jsonl.judgments(spark, str(tmp_path), "single_grade", schemas.SINGLE)
    got = {(r["lang"], r["judge_key"], r["protocol"], r["file_name"], r["model_id"]) for r in back.collect()}
    assert got == {("en", "j", "single_grade", m, m) for m in ODD}
    # A failing job leaves the old tree, and nothing beside it.
    with pytest.raises(PySparkException):
        jsonl.write_tree(df.withColumn("score_turn1", F.lit(float("nan"))), root, F.lit("all.jsonl"), ["question_id"])
    with pytest.raises(ValueError):
        jsonl.write_tree(df, root, F.lit("../all.jsonl"), ["question_id"])
    assert os.listdir(tmp_path) == ["en"] and len(os.listdir(folder)) == 5
    pairs = df.select("question_id", F.lit("x/y").alias("a"), F.col("model_id").alias("b"))
    assert jsonl.write_tree(pairs, root, jsonl.judgment_file(F.lit("f"), F.lit("j"), F.lit("pairwise"), F.col("a"), F.col("b")), ["question_id"]) == 5
    assert sorted(os.listdir(tmp_path / "en" / "judgments" / "f" / "j" / "pairwise")) == sorted(f"x_y_vs_{m}.jsonl" for m in ODD)
    assert not folder.exists() and os.listdir(tmp_path) == ["en"]


def test_folders_make_a_whole_matrix(spark, tmp_path):
    """What ``judgments`` reads is what the checks of a release take."""
    models, ids = ["m+1", "m%202"], [81, 82]
    q = spark.createDataFrame([(i, "math", ["a", "b"], ["r", "s"]) for i in ids], schemas.QUESTION).withColumn("lang", F.lit("en"))
    grades = [(i, m, "j", 5.0, 6.0, "x", "y", "math", 1.0, "h", None) for i in ids for m in models]
    single = spark.createDataFrame(grades, schemas.SINGLE)
    pairs = spark.createDataFrame([(i, *models, "j", "tie", "x", "y", "tie", "tie", 2, "math", 1.0, "h") for i in ids], schemas.PAIRWISE)
    name = {p: jsonl.judgment_file(F.lit("f"), F.lit("k"), F.lit(p), F.col("model_id")) for p in ("single_grade", "single_grade_ref")}
    columns = [c for c in single.columns]
    every = single.select(*columns).withColumn("_at", name["single_grade"]).unionByName(single.withColumn("_at", name["single_grade_ref"]))
    jsonl.write_tree(every.drop("_at"), str(tmp_path / "x"), F.lit("one.jsonl"), ["question_id"])
    for protocol, df, at in (("single_grade", single, name["single_grade"]), ("single_grade_ref", single, name["single_grade_ref"]), ("pairwise", pairs, jsonl.judgment_file(F.lit("f"), F.lit("k"), F.lit("pairwise"), F.col("model_a"), F.col("model_b")))):
        jsonl.write_tree(df, str(tmp_path / protocol), at, ["question_id"])
        (tmp_path / "data" / "en" / "judgments" / "f" / "k").mkdir(parents=True, exist_ok=True)
        os.rename(tmp_path / protocol / "judgments" / "f" / "k" / protocol, tmp_path / "data" / "en" / "judgments" / "f" / "k" / protocol)
    read = {p: jsonl.judgments(spark, str(tmp_path / "data"), p, schemas.PAIRWISE if p == "pairwise" else schemas.SINGLE) for p in ("single_grade", "single_grade_ref", "pairwise")}
    judges = spark.createDataFrame([("k", "j")], "judge_key string, judge_id string")
    matrix = release.matrix(read["single_grade"], read["single_grade_ref"], read["pairwise"], q, models, judges)
    assert [(r["lang"], r["judge_key"], r["records"], r["complete"]) for r in matrix.collect()] == [("en", "k", 10, True)]
    odd = {"single_grade": read["single_grade"].where("question_id <> 81 or model_id <> 'm+1'")}
    assert not release.matrix(odd["single_grade"], read["single_grade_ref"], read["pairwise"], q, models, judges).first()["complete"]
    checks = release.judgment_checks(matrix, 10).first()
    assert checks["complete"] and checks["total"]


def test_numbers_at_any_depth(spark, tmp_path):
    good = "1.5D"
    for k, (kind, bad) in enumerate((("array({0})", "double('NaN')"), ("named_struct('a', array(named_struct('b', {0})))", "double('Infinity')"), ("map('k', {0})", "float('-Infinity')"), ("map({0}, 1)", "double('NaN')"))):
        df = spark.range(1).select(F.expr(kind.format(good)).alias("v"), F.lit(None).cast("array<double>").alias("none"))
        assert jsonl.numbers_checked(df).count() == 1
        with pytest.raises(PySparkException, match="no JSON"):
            jsonl.numbers_checked(spark.range(1).select(F.expr(kind.format(bad)).alias("v"))).collect()
        assert k >= 0
    assert jsonl.write(spark.range(2).select(F.array(F.lit(1.5), F.lit(None).cast("double")).alias("v")), str(tmp_path / "o")) == 2


def test_grids_of_any_size(spark):
    """20,000 questions for six models."""
    asked = spark.range(20_000).select(F.col("id").alias("question_id"), F.lit("math").alias("category"))
    models = spark.createDataFrame([(f"m{k}",) for k in range(6)], "model_id string")
    grid = coverage.grid(models, asked.select("question_id"))
    assert grid.count() == 120_000 and grid.distinct().count() == 120_000
    records = grid.where("question_id <> 77")
    gaps = coverage.single_gaps(records, asked, models).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in gaps} == {"met": 119_994, "missing": 6}
    plan = grid._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert coverage.product(models, asked.where("false")).count() == 0
    nulls = spark.createDataFrame([(None,), ("x",), ("x",)], "v string")
    assert sorted(map(tuple, coverage.product(models.limit(1), nulls).collect()), key=str) == [("m0", "x"), ("m0", None)]


def test_aggregation_without_questions(spark):
    """One record: as many samples are expected as it has, and nobody knows the coverage."""
    single = spark.createDataFrame([(81, "m0", "j", 5.0, -1.0, "a", "b", "math", 1.0, "h", None, 1)], f"{schemas.SINGLE}, seq long")
    pairs = spark.createDataFrame([], f"{schemas.PAIRWISE}, seq long")
    found = aggregation.aggregate(single, pairs, single.where("false"))
    row = found.single.first()
    assert (row["expected"], row["observed"], row["failures"], row["coverage"]) == (2, 2, 1, None)
    assert [(r["model_id"], r["n_games"]) for r in found.win_rates.collect()] == [("m0", 0)]
    many = spark.range(12_000).select(F.concat(F.lit("m"), F.lpad("id", 6, "0")).alias("model_id"))
    games = many.select(F.lit("m000000").alias("model_a"), F.col("model_id").alias("model_b")).where("model_b <> 'm000000'")
    games = games.withColumns({"winner": F.col("model_b"), "category": F.lit("math")})
    rates = metrics.win_rates(games, [], 1, many)
    assert rates.count() == 12_000 and rates.where("overall = 1.0").count() == 11_999
    assert rates.where("model_id = 'm000000'").first()["n_expected_pairs"] == 11_999


def test_paths_are_as_on_disk(spark, tmp_path):
    for name in ODD:
        (tmp_path / f"{name}.txt").write_text("x")
    assert {r["path"] for r in files.digests(spark, str(tmp_path)).collect()} == {f"{m}.txt" for m in ODD}
    assert {r["path"] for r in files.listing(spark, str(tmp_path)).collect()} == {f"{m}.txt" for m in ODD}


# Cells.
def test_cells_of_tables(spark):
    mine = spark.createDataFrame([("a", 1.0, 5, "x"), ("b", 2.0, 6, None), ("c", float("nan"), 7, "z")], "judge string, mean double, n long, note string")
    golden = spark.createDataFrame([("a", "1.004", "5", "x"), ("b", "2.0", "8", ""), ("c", "nan", "7", "z")], "judge string, mean string, n string, note string")
    sides = [audit.cells(df, ["judge"], "t5") for df in (golden, mine)]
    assert [tuple(r) for r in audit.audit_cells(*sides, within=0.005).collect()] == [("t5", "b", "n", "changed", "8", "6")]
    assert {r["column"] for r in audit.audit_cells(*sides).collect()} == {"mean", "n"}
    lost = audit.cells(mine.where("judge <> 'b'").withColumn("more", F.lit(1)).drop("note"), ["judge"], "t5")
    found = {(r["row"], r["column"], r["fault"]) for r in audit.audit_cells(sides[0], lost, 0.005).collect()}
    assert found == {("b", None, "row missing"), (None, "note", "column missing"), (None, "more", "column added")}
    twice = audit.cells(mine.unionByName(mine.where("judge = 'a'")), ["judge"], "t5")
    assert {(r["row"], r["fault"]) for r in audit.audit_cells(sides[0], twice, 0.005).where("fault like '%repeated%'").collect()} == {("a", "row repeated, actual")}
    checks = audit.table_checks(audit.audit_cells(*sides, within=0.005), ["t5", "t6"])
    assert {(r["name"], r["ok"]) for r in checks.collect()} == {("t5", False), ("t6", True)}


# Trees.
KEY = "sk-" + "a1" * 20


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    texts = {
        "README.md": "read", "LICENSE": "terms", "src/a.py": "x = 1\n" * 1000, "data/en/questions.jsonl": "{}\n", "data/results/t+1.csv": "a,b\n", "data/ko/answers/한 글.jsonl": "{}\n",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    listed = [n for n in texts if n.startswith("data/")]
    lines = [f"{hashlib.sha256((root / n).read_bytes()).hexdigest()}  {n}" for n in listed]
    (root / "data" / "MANIFEST.sha256").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return root


def test_a_clean_tree(spark, tree):
    assert audit.tree_faults(spark, str(tree)).collect() == []


def test_faults_of_a_tree(spark, tree):
    place = tree / "data" / "MANIFEST.sha256"
    lines = place.read_text(encoding="utf-8").splitlines()
    (tree / "data" / "en" / "questions.jsonl").write_text("{ }\n")
    (tree / "data" / "ko" / "answers" / "한 글.jsonl").unlink()
    (tree / "data" / "en" / "notes.txt").write_text("note")
    (tree / "data" / "results" / "new.csv").write_text("a")
    (tree / "paper.TEX").write_text("x")
    (tree / "plot.png").write_bytes(b"\x89PNG")
    (tree / "docs.md").write_text("x")
    (tree / "LICENSE").unlink()
    (tree / "big.json").write_text("line\n" * 300_000 + f"key {KEY}\n")
    (tree / "broken.txt").write_bytes(f"{KEY}\n".encode() + b"\xff\xfe\n")
    (tree / "binary.bin").write_bytes(b"\x00" + KEY.encode())
    place.write_text("\n".join([*lines, lines[0], "no manifest line"]) + "\n", encoding="utf-8")
    found = sorted((r["rule"], r["path"]) for r in audit.tree_faults(spark, str(tree)).collect())
    assert found == [
        ("Markdown", "docs.md"), ("figure", "plot.png"), ("licence", "LICENSE"), ("manifest: changed", "data/en/questions.jsonl"), ("manifest: extra", "data/results/new.csv"),
        ("manifest: line", "no manifest line"), ("manifest: missing", "data/ko/answers/한 글.jsonl"), ("manifest: repeated", "data/en/questions.jsonl"),
        ("manuscript", "paper.TEX"), ("not published", "data/en/notes.txt"), ("secret", "big.json"),
    ]


def test_scan_of_all_files(spark, tree):
    (tree / "b.bin").write_bytes(KEY.encode() + b"\nAKIA" + b"A" * 16)
    (tree / "c.bin").write_bytes(KEY.encode() + b"\n\xc3\x28")
    (tree / "empty.txt").write_text("")
    assert sorted((r["path"], r["form"]) for r in audit.scan(spark, str(tree), every=True).collect()) == [("b.bin", "AWS access key"), ("b.bin", "OpenAI-style key")]
    assert audit.scan(spark, str(tree)).collect() == []
