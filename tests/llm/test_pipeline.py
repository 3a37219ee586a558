"""Each stage of the corpus pipeline, and the whole of it, against plain versions on a small fixture."""

from __future__ import annotations

import random

import pytest

from tests.llm import brute

tokenizers_at = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["_page", "kept", "n_bytes", "n_removed", "n_spans", "carried", "rest", "toxicity_score", "quality_score", "pattern", "_row", "_key", "_text", "id", "score", "component_id", "piece", "length", "salt"]
INSULTS = ("scumbag", "vermin", "filthrat")


def _prose(rng: random.Random, words: int) -> str:
    own = [rng.choice(("river", "stone", "garden", "letter", "evening", "house", "market", "window", "forest", "bridge")) + rng.choice(("", "s", "let", "ward", "ish", "like")) for _ in range(words)]
    return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(own))


@pytest.fixture(scope="module")
def made():
    """(id, text, kind) rows: prose, toxic prose, junk, copies, near copies, shared passages and awkward texts."""
    rng, rows = random.Random(4), []
    for _ in range(160):
        rows.append((len(rows) + 1, _prose(rng, 60), "prose"))
    for _ in range(60):
        w = _prose(rng, 60).split()
        for k in rng.sample(range(60), 4):
            w[k] = rng.choice(INSULTS)
        rows.append((len(rows) + 1, " ".join(w), "toxic"))
    for _ in range(40):
        rows.append((len(rows) + 1, " ".join(rng.choice(("###", "$$$ %%", "BUY NOW !!!", "<<<>>>")) for _ in range(40)), "junk"))
    for k in range(6):
        rows.append((len(rows) + 1, rows[k][1], "copy"))
        rows.append((len(rows) + 1, rows[20 + k][1] + " the end", "near"))
    passage = _prose(rng, 70)
    for _ in range(8):
        rows.append((len(rows) + 1, f"{_prose(rng, 30)} {passage} {_prose(rng, 30)}", "shared"))
    rows += [(1000, None, "odd"), (1001, "", "odd"), (None, _prose(rng, 50), "odd"), (None, None, "odd"), (7, rows[6][1], "again"), (1003, "word " * 3, "odd"), (1004, _prose(rng, 9000), "long")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, made):
    rows = [(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t, _) in enumerate(made)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def folder(docs, made, spark, tmp_path_factory):
    """Tables as the driver lays them out."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(kind != "junk"), int(kind == "toxic")) for i, _, kind in made if i is not None and kind in ("prose", "toxic", "junk")]
    spark.createDataFrame([*labels, (None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


STAGES = dict(pipeline.STAGES)
FILTERS = ("quality classifier", "toxicity", "n-gram Jaccard join", "suffix-array dedup")


@pytest.mark.parametrize("name", FILTERS)
def test_stages_carry_columns_of_their_own_names(spark, docs, folder, name):
    from pyspark.sql import functions as F

    more = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING), F.struct(F.lit(1).alias("a.b")).alias("a.b"))
    out = STAGES[name](spark, more, folder)
    assert out.columns == more.columns and out.schema == more.schema
    plain = STAGES[name](spark, docs, folder)
    assert rows_of(out) == rows_of(plain)
    assert all(r["kept"] == (None if r["doc_id"] is None else f"kept{r['doc_id']}") for r in out.select("doc_id", "kept").collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_an_empty_table(spark, docs, folder, name):
    assert STAGES[name](spark, docs.where("false"), folder).count() == 0


def test_quality_stage(spark, docs, folder, made):
    """The scores decide, and they are those of the operator; planted junk goes and prose stays."""
    from assayer.llm.quality_model import weak_quality

    kept = rows_of(STAGES["quality classifier"](spark, docs, folder))
    good = [r for r in weak_quality(docs, carry=True).collect() if r["quality_score"] >= 0.5]
    assert kept == sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in good), key=repr)
    ids = {r[0] for r in kept}
    of = {k: {i for i, _, kind in made if kind == k} for k in ("prose", "junk")}
    assert not of["junk"] & ids and len(of["prose"] & ids) >= 0.97 * len(of["prose"])


def test_toxicity_stage(spark, docs, folder, made):
    kept = rows_of(STAGES["toxicity"](spark, docs, folder))
    ids = {r[0] for r in kept}
    of = {k: {i for i, _, kind in made if kind == k} for k in ("prose", "toxic")}
    assert len(of["toxic"] & ids) <= 0.05 * len(of["toxic"]) and len(of["prose"] & ids) >= 0.97 * len(of["prose"])
    assert {1000, 1001} <= ids
    assert set(kept) <= set(rows_of(docs))


def test_jaccard_stage(spark, docs, folder, made):
    kept = rows_of(STAGES["n-gram Jaccard join"](spark, docs, folder))
    named = {i: t for i, t, _ in made if i is not None}
    of = brute.similar(list(named.items()))
    assert kept == [r for r in rows_of(docs) if r[0] is None or of[r[0]][1] == r[0]]


def test_suffix_stage(spark, docs, folder, made):
    got = rows_of(STAGES["suffix-array dedup"](spark, docs, folder))
    want = sorted((i, gone.decode(errors="ignore")) for (i, gone) in brute.kept_bytes([(i if i is not None else -1, t) for i, t, _ in made]))
    assert sorted((r[0] if r[0] is not None else -1, r[1]) for r in got) == want
    assert all(r[4] is None or r[4] == len(r[1]) for r in got)


def test_whole_pipeline(spark, docs, folder):
    """``run`` is its stages one after the other, each on what the one before kept."""
    own = docs
    for name in FILTERS:
        own = spark.createDataFrame(STAGES[name](spark, own, folder).collect(), SCHEMA)
    want = STAGES["best-fit packing"](spark, own, folder)
    got = pipeline.run(spark, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)
    placed = [(r["sequence_id"], r["offset"], r["length"]) for r in got.collect()]
    filled: dict = {}
    for s, offset, length in sorted(placed):
        assert filled.get(s, 0) == offset
        filled[s] = offset + length
    assert max(filled.values()) <= 2048
