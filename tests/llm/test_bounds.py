"""What learnt operators are fitted on stays bounded, and nothing is left behind when an operator fails."""

from __future__ import annotations

import os

import numpy as np
import pytest

from assayer.llm import jaccard, quality_model, quality_rules, toxicity
from assayer.llm.tables import shared_dir


@pytest.fixture(scope="module")
def repeated(spark):
    """60,000 rows of two keys."""
    return spark.range(60_000).selectExpr("id % 2 as doc_id", "concat('some words of text number ', id % 5) as text").repartition(8)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 1, 1), (0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_a_key_teaches_once(spark, repeated, labels, monkeypatch):
    sample = toxicity.labelled_sample(repeated, labels, "doc_id", "text", "toxic", 1).collect()
    assert len(sample) == 1 and sample[0]["_label"] == 1 and sample[0]["_text"] == "some words of text number 0"
    seen = []
    monkeypatch.setattr(quality_rules, "fitted", lambda rows, fit: seen.append(rows.count()) or fit(rows.toArrow()))
    assert quality_rules.decide(repeated, labels, max_labelled=2).count() == 60_000
    assert seen[0] <= 2
    assert quality_model.weak_quality(repeated, max_train=2).count() == 60_000


def test_tables_go_when_an_operator_fails(spark, repeated, monkeypatch):
    def fails(*_):
        raise RuntimeError("in the middle")

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    monkeypatch.setattr(jaccard, "components", fails)
    with pytest.raises(RuntimeError, match="in the middle"):
        jaccard.similar_groups(repeated)
    left = set(os.listdir(at)) - before
    assert all(not os.path.exists(f"{at}/{x}/1") for x in left)  # at most the table of members, which goes when the driver ends


def test_coded_counters():
    counts = np.array([0, 1, 63, 64, 100, 1000, 10**6, 10**8])
    values = jaccard._VALUES[jaccard._coded(counts)]
    assert (values[:3] == counts[:3]).all() and (np.abs(values[3:] / counts[3:] - 1) < 0.05).all()


def test_common_shingles_rank_last_within_the_noise():
    """As in 6 GB of documents: 400 texts to a counter, shingles of 40 texts among those of one."""
    rng = np.random.default_rng(5)
    counts = rng.poisson(400, 1 << 16)
    counts[: 1 << 12] += 40
    often = jaccard.Frequencies(counts.astype(np.float32))
    values = (np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)) + rng.integers(0, 2**48, 1 << 16, np.uint64)
    texts = rng.permutation(1 << 16).reshape(-1, 64)
    first = np.take_along_axis(texts, np.lexsort((values[texts], often.rank(values[texts])), 1)[:, :13], 1)
    assert (first < 1 << 12).mean() < 0.01  # of all there are 6 %
    assert not often(values[(counts > 400) & (counts < 470)]).any() and (np.diff(often.rank(values)[np.argsort(counts)]) >= 0).all()
    assert jaccard.Frequencies(np.float32([1e12] + [0] * 7)).rank(values[-1:]).dtype == np.int16


def test_marks_lose_no_pair(spark):
    """Sets around the threshold, with marks of the same, of twice and of more than twice the length."""
    rng = np.random.default_rng(3)
    sets, pairs = [], []
    for size in [1, 2, 30, 250, 257, 500, 520, 1000, 1030, 2100] * 6:
        base = rng.integers(0, 2**63, size, np.uint64)
        for keep in (1.0, 0.95, 0.9, 0.85, 0.6, 0.2):
            other = np.concatenate([base[: max(1, int(keep * size))], rng.integers(0, 2**63, int(rng.integers(0, 1 + size // 8)), np.uint64)])
            pairs.append((len(sets), len(sets) + 1))
            sets += [base, other]
    values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    marks = jaccard.set_marks(rows, values, len(sets)).to_pylist()
    assert {len(m) for m in marks} == {4, 8, 16, 32, 64}
    both = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    table = spark.createDataFrame([(k, len(sets[a]), marks[a], len(sets[b]), marks[b]) for k, (a, b) in enumerate(pairs)], "k long, n long, x array<long>, m long, y array<long>")
    for percent in (80, 30):
        alike = {k for k, (a, b) in enumerate(pairs) if 100 * both[k] >= percent * (len(sets[a]) + len(sets[b]) - both[k])}
        kept = {r["k"] for r in table.where(jaccard._may_be_alike(*map(jaccard.F.col, "nxmy"), percent)).collect()}
        assert alike <= kept
        if percent == 80:
            large = [k for k, (a, _) in enumerate(pairs) if len(sets[a]) >= 250]
            assert len(alike) > 100 and not [k for k in large if k in kept and 100 * both[k] < 50 * len(np.union1d(sets[pairs[k][0]], sets[pairs[k][1]]))]


def test_texts_go_only_to_pairs_that_may_be_alike(spark, monkeypatch):
    seen, verify = spark.sparkContext.accumulator(0), jaccard.verify_batches

    def counted(batches, *more):
        def each():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return verify(each(), *more)

    monkeypatch.setattr(jaccard, "verify_batches", counted)
    passages = [" ".join(f"p{k}x{j}" for j in range(20)) for k in range(12)]
    chosen = [(k, *sorted((k + step) % 12 for step in steps)) for k in range(12) for steps in ((1, 3, 6, 7), (2, 5, 8, 9))]
    rows = [(i, " ".join(passages[k] for k in c)) for i, c in enumerate(chosen)]
    rows.append((24, rows[7][1].rsplit(" ", 1)[0] + " new"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: k for k in range(24)} | {24: 7}
    assert 1 <= seen.value <= 4  # many more share enough shingles of their prefixes
