"""Embedding near-duplicates: sign hashing in several tables, exact cosines, connected components.

Equal vectors are first brought together, so copies cost nothing further. Random hyperplanes give each
distinct vector one bucket in every table. Large buckets are split into blocks that meet pairwise;
a block pair yields, for each vector, a weighted count and one edge to its local component, never
the pairs themselves. A pair counts only in the first table in which both share a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.graph import components, roots
from assayer.llm.tables import Scratch, materialize, read


def tables_for(rows: int, threshold: float, recall: float, bucket: int = 128) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` rows, and tables enough for the recall at the threshold."""
    bits = min(60, max(6, math.ceil(math.log2(max(2, rows) / bucket))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    return flat, sizes


@lru_cache(2)
def hyperplanes(seed: int, dim: int, many: int) -> np.ndarray:
    """Whole numbers, so that signs do not depend on the order of a sum: with those of ``signs`` all sums are exact."""
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, many)) * (1 << 16))


def signs(x: np.ndarray, seed: int, bits: int, tables: int, first: int | None = None) -> np.ndarray:
    """Bucket number of each vector in the first tables (all, if not said)."""
    first = tables if first is None else first
    whole = np.rint(x / np.abs(x).max(1, keepdims=True) * (1 << 20))
    above = whole @ hyperplanes(seed, x.shape[1], bits * tables)[:, : bits * first] >= 0
    return above.reshape(len(x), first, bits) @ (1 << np.arange(bits, dtype=np.int64))


def sign_codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One bucket number for each table; hyperplanes follow from the seed and the dimension."""
    for batch in batches:
        flat, sizes = _vectors(batch.column("v"))
        codes = np.zeros((batch.num_rows, tables), np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            codes[mine] = signs(flat[at[mine][:, None] + np.arange(dim)], seed, bits, tables)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
        lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sizes.astype(np.int32)), lists], ["rep", "dim", "codes"])


def verify_block(group: pa.Table, threshold: float, seed: int, bits: int, tables: int) -> pa.Table:
    """Links within one block, or between its two sides: weights of partners and local components."""
    table, bi, bj = (group.column(c)[0].as_py() for c in ("table", "bi", "bj"))
    rep, weight, block = (group.column(c).to_numpy() for c in ("rep", "n", "block"))
    x = group.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(rep), -1)
    scaled = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((scaled * scaled).sum(1))
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    known = np.full((len(rep), table), -1, np.int64)  # buckets in earlier tables, of vectors with a link
    firsts, seconds = [], []
    for a in range(0, len(left), 512):  # 512 rows of the matrix at a time
        own = left[a : a + 512]
        i, j = np.nonzero((scaled[own] @ scaled[right].T) / (norm[own][:, None] * norm[right]) >= threshold)
        i, j = own[i], right[j]
        if bi == bj:
            i, j = i[i < j], j[i < j]
        if table:
            asked = np.unique(np.concatenate([i, j]))
            asked = asked[known[asked, 0] < 0]
            for c in range(0, len(asked), 4096):
                known[asked[c : c + 4096]] = signs(x[asked[c : c + 4096]], seed, bits, tables, table)
        for c in range(0, len(i), 1 << 18):
            p, q = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
            new = ~(known[p] == known[q]).any(1)
            firsts.append(p[new])
            seconds.append(q[new])
    i, j = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (firsts, seconds))
    links = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
    root = roots(i, j, len(rep))
    some = np.flatnonzero(links > 0)
    return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[root[some]]})


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.999, block: int = 1024, seed: int = 1) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
    only vectors of one dimension are compared. Cosines are in double precision. ``recall`` is the
    chance that a pair right at the threshold shares a bucket; closer pairs have a higher one. Rows
    that repeat a key or a vector count each for itself: rows of one vector link with each other. Rows
    without a key get no links and no component and are kept. Other columns are left out; an empty table gives no rows.
    """
    element = df.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if element in ("float", "double") else F.col(vector).cast("array<double>")  # floats stay as they are, half the size
    element = element if element in ("float", "double") else "double"
    zero = F.lit(0).cast(element)
    usable = F.coalesce(
        F.col(key).isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.when(usable, F.transform(v, lambda x: x + zero)).alias("v"))  # -0.0 and 0.0 are one value
    same = ["h1", "h2"]  # 128 bits of a vector, by which its rows find its class again
    rows = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = scratch(rows.where("v is not null").groupBy("v", *same).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    bits, tables = tables_for(classes.count(), threshold, recall)
    coded = classes.select("rep", "v").mapInArrow(lambda it: sign_codes(it, bits, tables, seed), "rep long, dim int, codes array<long>")
    # Buckets and blocks are settled on narrow rows; then each vector is sent once for each block pair it is in.
    placed = scratch(coded.select("rep", "dim", F.posexplode("codes").alias("table", "code")))
    sizes = placed.groupBy("dim", "table", "code").agg(F.count("*").alias("size")).where("size > 1")
    met = (
        placed.join(sizes, ["dim", "table", "code"])
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "dim", "table", "code", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        .join(classes.select("rep", "n", "v"), "rep")
    )
    found = scratch(
        met.groupBy("dim", "table", "code", "bi", "bj").applyInArrow(lambda t: verify_block(t, threshold, seed, bits, tables), "rep long, links long, root long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    of_class = materialize(
        classes.select("rep", "n", *same).join(links, "rep", "left").join(named.withColumnRenamed("id", "rep"), "rep", "left")
        .select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    scratch.clear()
    joined = rows.where("v is not null").select("id", *same).join(of_class, same).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: DuckDB: every pair by brute force, then the smallest id reachable by links.
OP1_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(u, w) AS (SELECT u, w FROM pairs UNION SELECT r.u, p.w FROM reach r JOIN pairs p ON r.w = p.u),
least AS (SELECT u, min(w) AS m FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
"""
