"""Importance resampling towards a target corpus, over a stored sparse matrix of hashed n-grams.

Each document becomes a row of counts by bucket; rows are written as blocks in compressed sparse row form.
Column sums of the stored blocks give both distributions, a product of each block with the vector of gains
gives the documents' weights, and Gumbel noise on them turns the highest scores into a sample without replacement.
Scores are put in order by ranges, so no task sees more than its range and no rank is taken in the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.tables import Scratch, materialize, read, shuffle_partitions

BLOCK = "ids array<{kind}>, n_words array<long>, row_at array<long>, buckets binary, counts binary"
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lower_words(column: pa.Array) -> W.Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a column after A-Z became a-z."""
    data, at = W.raw(W.plain(column))
    data = W._LOWER[data]
    n = len(data)
    solid = np.append(_SOLID[data], False)
    edge = np.zeros(n + 1, bool)  # places where a text begins or ends
    edge[at] = True
    start = np.flatnonzero(solid[:n] & (edge[:n] | ~np.concatenate([[False], solid[: n - 1]])[:n]))
    end = np.flatnonzero(solid[:n] & (edge[1:] | ~solid[1:])) + 1
    first = np.searchsorted(start, at)
    return W.Words(data, at, start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def bucket_numbers(w: W.Words, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every run of ``size`` words: crc32 of the words joined by one space, taken once for each distinct run."""
    hashes, at = W.windows(w.hashes(), w.doc, size, seed=11)
    _, seen, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    joined, start, end = w.data.tobytes(), w.start, w.end
    crc = np.fromiter((zlib.crc32(b" ".join(joined[start[k] : end[k]] for k in range(i, i + size))) % buckets for i in at[seen].tolist()), np.int64, len(seen))
    return w.doc[at], crc[inverse]


def matrix_blocks(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, key: str, text: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Compressed sparse rows: the place of each row's first entry, then bucket and count of each entry."""
    for batch in W.slices(batches, text):
        w = lower_words(batch.column(text))
        found = [bucket_numbers(w, size, buckets) for size in range(1, longest + 1)]
        cells, counts = np.unique(np.concatenate([row * buckets + bucket for row, bucket in found]), return_counts=True)
        row_at = np.searchsorted(cells, np.arange(batch.num_rows + 1) * buckets)
        ids = batch.column(key)
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, pa.int64())) for c in (w.counts, row_at)),
                *(pa.array([c.astype("<u4").tobytes()], pa.binary()) for c in (cells % buckets, counts)),
            ],
            ["ids", "n_words", "row_at", "buckets", "counts"],
        )


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number in the batch; row starts, buckets and counts of each block."""
    for k in range(batch.num_rows):
        row_at = batch.column("row_at")[k].values.to_numpy()
        yield k, row_at, *(np.frombuffer(batch.column(c)[k].as_buffer(), "<u4").astype(np.int64) for c in ("buckets", "counts"))


def column_sums(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts by bucket over the blocks of a task, without zeros."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, bucket, count in _entries(batch):
            total += np.bincount(bucket, count, buckets).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def products(batches: Iterator[pa.RecordBatch], gains: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Each row's number of features and the floored mean of their gains: the matrix times the gains, by its row sums."""
    for batch in batches:
        for k, row_at, bucket, count in _entries(batch):
            sums = [np.concatenate([[0], np.cumsum(v)])[row_at] for v in (count, count * gains[bucket])]
            n, gain = (np.diff(s) for s in sums)
            weight = np.where(n > 0, gain // np.maximum(n, 1), 0)
            own = pa.array(np.arange(len(n)))
            block = pa.array(np.full(len(n), batch.column("block")[k].as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[k].values, batch.column("n_words")[k].values, pa.array(n), pa.array(weight), block, own],
                ["id", "n_words", "n_features", "weight", "block", "own"],
            )


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, each bucket counted once more than it occurs."""
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    ratio = ((target.get(b, 0) + 1) * float(s_all) / ((source.get(b, 0) + 1) * float(t_all)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise that a key has for good, from the first eight hex digits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at``: place of a row in its task."""
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows))], [*batch.schema.names, "at"])
        n += batch.num_rows


def resample(
    df: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text", target_key: str = "item_id",
) -> DataFrame:
    """One row per row of ``df``: key, n_features, weight, score, rank.

    ``rank`` is null for rows that are not drawn. ``percent`` of the rows with ``least_words`` words are drawn by highest
    score, ties to the smaller key. Null and empty texts have no features and weight 0. Rows that repeat a key have the same noise
    and count each for itself, in any order where their scores are equal. Rows without a key have no score and are
    neither drawn nor counted. An empty table gives no rows, an empty target counts as uniform. Other columns are left out.

    To the driver go two vectors of ``buckets`` numbers and the histogram of scores, whose whole numbers span 200,000 values
    at most for counts below 2^53; ranks come from sorted ranges of the rows at or above the last score drawn.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    try:
        def matrix(docs: DataFrame, key: str) -> DataFrame:
            kind = docs.schema[key].dataType.simpleString()
            rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
            blocks = rows.mapInArrow(lambda it: matrix_blocks(it, longest, buckets, "id", "text", kind), BLOCK.format(kind=kind))
            return scratch(blocks.withColumn("block", F.monotonically_increasing_id()))

        def sums(blocks: DataFrame) -> dict[int, int]:
            counted = blocks.select("row_at", "buckets", "counts").mapInArrow(lambda it: column_sums(it, buckets), "bucket long, n long")
            return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most `buckets` rows

        kind = df.schema[key].dataType.simpleString()
        blocks = matrix(df, key)
        gains = bucket_gains(sums(blocks), sums(matrix(target, target_key)), buckets)
        weighed = blocks.mapInArrow(lambda it: products(it, gains, kind), f"id {kind}, n_words long, n_features long, weight long, block long, own long")
        scored = scratch(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
        eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
        histogram = sorted(((r["score"], r["n"]) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
        draw = percent * sum(n for _, n in histogram) // 100
        above, last = 0, math.inf  # the last score drawn
        for score, n in histogram:
            if above >= draw:
                break
            above, last = above + n, score
        chosen = eligible & (F.col("score") >= last) if draw else F.lit(False)
        order = [F.col("score").desc(), F.col("id"), F.col("block"), F.col("own")]
        n_ranges = max(shuffle_partitions(spark), above // 1_000_000 + 1)
        columns = f"id {kind}, n_features long, weight long, score long, part int"
        ranged = scored.where(chosen).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
        ordered = scratch(ranged.select("id", "n_features", "weight", "score", F.spark_partition_id().alias("part")).mapInArrow(_numbered, f"{columns}, at long"))
        before, total = [], 0
        for r in sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a number for each range
            before.append((r["part"], total))
            total += r["n"]
        ordered = ordered.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
        rank = F.col("before") + F.col("at") + 1
        drawn = ordered.select("id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
        rest = scored.where(~chosen).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        return materialize(drawn.unionByName(rest).withColumnRenamed("id", key))
    finally:
        scratch.clear()


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: DuckDB: crc32 by its definition, eight steps of the polynomial for each byte of a distinct word.
OP12_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
texts AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
each AS (SELECT side, id, r, unnest(w) AS word FROM words),
hex AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each)),
octets AS (SELECT word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hex),
bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM octets, crc_table),
counted AS (SELECT side, bucket, count(*) AS n FROM each JOIN bucketed USING (word) GROUP BY ALL),
sizes AS (SELECT coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s_all, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t_all FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(max(n) FILTER (side = 1), 0) + 1)::DOUBLE * (any_value(s_all) + 10000) / ((coalesce(max(n) FILTER (side = 0), 0) + 1)::DOUBLE * (any_value(t_all) + 10000))))::BIGINT AS gain
  FROM counted, sizes GROUP BY bucket),
weights AS (
  SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM each JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (
  SELECT *, CASE WHEN n_features >= 20 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) END AS k,
    count(*) FILTER (n_features >= 20 AND score IS NOT NULL) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM ranked
"""
