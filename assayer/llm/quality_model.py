"""Quality classifier from weak labels: labellers vote, EM weighs them, a hashed linear scorer learns.

Heuristic labellers vote good, bad or nothing on whole texts. Counts of the vote patterns over all
rows (3 to the number of labellers at most) go to the driver, where expectation-maximisation
estimates how accurate each labeller is. The posteriors of a bounded sample then train a logistic
scorer on hashed features, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from assayer.llm import words as W
from assayer.llm.quality_rules import COUNTS, SHARES, features, statistics, text_statistics
from assayer.llm.tables import Scratch, fitted, read, schema_of

BITS = 16


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(1)).when(good, F.lit(2)).otherwise(F.lit(0))


#: Labellers: when a text looks bad, and when it looks good. They overlap: each fault is seen by two or more.
LABELLERS: dict[str, tuple[str, str]] = {
    "symbols": ("symbols_a_word > 0.15", "false"),
    "symbol_letters": ("n_symbols > 0.02 * word_chars", "false"),
    "repeats": ("repeat_share > 0.25", "false"),
    "lines": ("duplicate_lines_a_word > 0.02", "false"),
    "case": ("upper_share > 0.4", "false"),
    "bangs": ("bangs_a_word > 0.3", "false"),
    "length": ("words < 20", "false"),
    "variety": ("distinct_share < 0.25", "false"),
    "prose": (
        "words < 15 or upper_share > 0.5",
        "words >= 20 and symbols_a_word < 0.05 and repeat_share < 0.1 and upper_share < 0.15 and bangs_a_word < 0.05",
    ),
    "plain": ("lower_share < 0.3 or distinct_share < 0.15", "lower_share > 0.5 and distinct_share > 0.3 and symbols_a_word < 0.1 and bangs_a_word < 0.1"),
}


def votes(stats: DataFrame) -> DataFrame:
    """Adds ``pattern``: one digit for each labeller (0 nothing, 1 bad, 2 good)."""
    return stats.withColumn("pattern", F.concat(*(_vote(F.expr(bad), F.expr(good)).cast("string") for bad, good in LABELLERS.values())))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior that a pattern is good, P(vote | class) as (labellers, class, vote), prior of good).

    Starts from the majority of votes; votes are smoothed by one row each, so rare votes stay possible.
    """
    n = len(patterns)
    good = (patterns == 2).sum(1)
    bad = (patterns == 1).sum(1)
    posterior = np.where(bad > good, 0.02, np.where(good > bad, 0.98, 0.5))
    chances, prior = np.zeros((patterns.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for vote in range(3):
            chances[:, :, vote] = ((patterns == vote).T @ weight.T) + 1
        chances /= chances.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.log(chances)
        both = np.stack([sum(logs[k, c, patterns[:, k]] for k in range(patterns.shape[1])) + np.log(prior if c else 1 - prior) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(both[0] - both[1], -500, 500)))
        if n == 0 or np.abs(new - posterior).max() < 1e-9:
            posterior = new
            break
        posterior = new
    return posterior, chances, float(prior)


def hashed_features(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and value: words, their shapes, and steps of the text's statistics."""
    w = W.words(W.plain(batch.column(text)))
    kinds = np.zeros(256, np.uint64)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = 1, 2, 3, 4
    kinds[list(b".,;")], kinds[list(b"!?")], kinds[list(b"#*$%&|<>")] = 5, 6, 7
    n = len(w.start)
    rows, keys, values = [], [], []
    if n:
        share = 1 / np.sqrt(np.maximum(1, w.counts))[w.doc]
        size = np.minimum(w.end - w.start, 20).astype(np.uint64)
        first, last = kinds[w.data[w.start]], kinds[w.data[w.end - 1]]
        previous = np.zeros(n, np.uint64)
        hashes = w.hashes()
        previous[1:] = hashes[1:] == hashes[:-1]
        second = kinds[w.data[np.minimum(w.start + 1, w.end - 1)]]
        shape = W.mix(((first * np.uint64(8) + second) * np.uint64(8) + last) * np.uint64(64) + size * np.uint64(2) + previous + np.uint64(1 << 20))
        mark = W.mix(last + first * np.uint64(8) + np.uint64(1 << 30))
        for h in (hashes, shape, mark):
            rows.append(w.doc)
            keys.append(h >> np.uint64(64 - BITS))
            values.append(share)
    stats = next(statistics(iter([batch]), "_row", text)) if "_row" in batch.schema.names else None
    if stats is not None:
        count = {c: stats.column(c).to_numpy().astype(float) for c in COUNTS}
        each = np.arange(batch.num_rows)
        for k, (a, b) in enumerate(SHARES.values()):
            x = np.divide(count[a], count[b], out=np.zeros(len(each)), where=count[b] > 0)
            step = np.floor(np.log2(x + 1e-3) * 2).astype(np.int64) + 64
            rows.append(each)
            keys.append(W.mix(np.uint64((k + 1) << 40) + step.astype(np.uint64)) >> np.uint64(64 - BITS))
            values.append(np.ones(len(each)))
        step = np.floor(np.log2(count["n_words"] + 1)).astype(np.uint64)
        rows.append(each)
        keys.append(W.mix(np.uint64(99 << 40) + step) >> np.uint64(64 - BITS))
        values.append(np.ones(len(each)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64), np.concatenate(values)


def _numbered(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text)], ["_row", text])


def feature_rows(batches: Iterator[pa.RecordBatch], text: str, rest: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, text):
        row, key, value = hashed_features(_numbered(batch, text), text)
        code, at = np.unique(row * (1 << BITS) + key, return_inverse=True)
        total = np.bincount(at, value, len(code))
        bounds = pa.array(np.searchsorted(code >> BITS, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array((code & ((1 << BITS) - 1)).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(total.astype(np.float32)))]
        yield pa.RecordBatch.from_arrays([*lists, *(batch.column(c) for c in rest)], ["keys", "values", *rest])


def fit_linear(keys: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, epochs: int = 30, rate: float = 0.05, ridge: float = 1e-5, seed: int = 3) -> np.ndarray:
    """Weights of the hashed features and, at last, the bias, by Adam on soft labels."""
    weights = np.zeros((1 << BITS) + 1, np.float64)
    if not len(keys):
        return weights
    m1, m2, rng, tick = np.zeros_like(weights), np.zeros_like(weights), np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(keys))
        for a in range(0, len(order), 128):
            mine = order[a : a + 128]
            row = np.repeat(np.arange(len(mine)), [len(keys[i]) for i in mine])
            k, v = np.concatenate([keys[i] for i in mine]), np.concatenate([values[i] for i in mine])
            logit = np.bincount(row, weights[k] * v, len(mine)) + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[mine]) / len(mine)
            g = np.bincount(k, v * error[row], len(weights)) + ridge * weights
            g[-1] = error.sum()
            tick += 1
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            weights -= rate * (m1 / (1 - 0.9**tick)) / (np.sqrt(m2 / (1 - 0.99**tick)) + 1e-8)
    return weights


def fit(sample: pa.Table) -> np.ndarray:
    """Weights learnt on rows of features and ``_good``, whatever their order."""
    if not sample.num_rows:
        return fit_linear([], [], np.zeros(0))
    sample = sample.take(pc.sort_indices(sample.select(["_key"]), [("_key", "ascending")]))
    lists = [[np.asarray(x) for x in sample.column(c).to_pylist()] for c in ("keys", "values")]
    return fit_linear(*lists, sample.column("_good").to_numpy())


def score_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, text: str, rest: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, text):
        row, key, value = hashed_features(_numbered(batch, text), text)
        logit = np.bincount(row, weights[key] * value, batch.num_rows) + weights[-1]
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score)], [*rest, "quality_score"])


def weak_quality(df: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = 4_000, carry: bool = False) -> DataFrame:
    """Key and ``quality_score`` (0 to 1, higher is better) of every row; with ``carry`` all its other columns too.

    ``max_train`` bounds the rows whose hashed features train the scorer: those whose hashed key is
    smallest, fitted in one task. Vote patterns are counted over all rows. Null text counts as empty;
    repeated rows and rows without a key are scored each for itself, but only one row of a key trains; an empty
    table gives no rows; a column already named ``quality_score`` is replaced.
    """
    df = df.drop("quality_score")
    own = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    spark = df.sparkSession
    scratch = Scratch(spark)
    try:
        stats = scratch(votes(features(text_statistics(own, "_key", "_text"))).select("_key", "pattern"))
        counted = stats.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3 ** labellers rows at most
        patterns = np.array([[int(c) for c in r["pattern"]] for r in counted], np.int64).reshape(len(counted), len(LABELLERS))
        posterior, _, _ = expectation_maximisation(patterns, np.array([r["n"] for r in counted], float))
        known = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(counted, posterior, strict=True)], "pattern string, _good double")
        sample = stats.where("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(max_train).groupBy("_key").agg(F.min("pattern").alias("pattern"))
        chosen = sample.join(F.broadcast(known), "pattern").select("_key", "_good")  # max_train rows at most
        rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
        rows = rows.groupBy("_key").agg(F.min("_text").alias("_text"), F.min("_good").alias("_good"))
        features_of = schema_of(rows, ["_key", "_good"])
        features_of = StructType([StructField("keys", ArrayType(IntegerType())), StructField("values", ArrayType(FloatType())), *features_of.fields])
        shared = spark.sparkContext.broadcast(fitted(rows.mapInArrow(lambda it: feature_rows(it, "_text", ["_key", "_good"]), features_of), fit))  # a fixed size
    finally:
        scratch.clear()
    out = df if carry else df.select(key, text)
    rest = [c for c in out.columns if carry or c != text]
    return out.mapInArrow(lambda it: score_batches(it, shared.value, text, rest), schema_of(df, rest, ("quality_score", DoubleType())))


def op9_quality_model(spark, sf_dir: str) -> DataFrame:
    """Every document's score and whether it is kept (score at least 0.5)."""
    return weak_quality(read(spark, sf_dir, "documents")).withColumn("kept", F.col("quality_score") >= 0.5)
