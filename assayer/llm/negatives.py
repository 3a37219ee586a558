"""Hard negatives by k-means inverted lists with stored radii.

Every row is in the list of its nearest centroid; lists keep their centroid and the radius of their rows about it. An
anchor q visits lists by the Cauchy-Schwarz bound q.c + |q| r on any score in them, skips lists whose bounds
lie outside its windows of scores, and stops when the bound falls strictly below the k-th score found. Lists are
visited in rounds that grow by a constant factor: in a round anchors are sent to blocks of lists, each block
answers with its best rows alone, and the k-th scores after it decide who goes on. No row is missed: a list is
left out only when none of its rows could be among the first k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.tables import Scratch, fitted, materialize, read

#: Scores are whole numbers; windows and scores are cut at what a long holds.
LEAST, MOST = -(1 << 62), 1 << 62
#: Rows of a cell that are sent to the others of an anchor in pieces of this many scores.
CELLS = 1 << 20
#: Rows (list, slice of anchors) that are broadcast; beyond it they are joined.
FEW_ROWS = 500_000


@dataclass(frozen=True)
class Lists:
    """Centroids, radii and sizes of all lists: as many as ``lists_for`` says, whatever the input."""

    centroid: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def lists_for(rows: int) -> int:
    """About a list for each row of a square, 1024 at most."""
    return int(min(1024, max(1, 2 ** round(math.log2(max(1, rows)) / 2))))


def block_rows(rows: int) -> int:
    """Rows of a list that go to one task: 256 on small inputs, up to 65,536."""
    return int(min(65_536, max(256, rows // 128)))


def whole(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, one row of doubles for each vector of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def k_means(sample: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows spread over the sample; empty ones keep their place."""
    distinct = np.unique(sample, axis=0)
    centroid = distinct[np.unique(np.linspace(0, len(distinct) - 1, many).astype(int))].copy()
    for _ in range(rounds):
        own = nearest(sample, centroid)
        n = np.bincount(own, minlength=len(centroid))
        total = np.zeros_like(centroid)
        np.add.at(total, own, sample)
        centroid = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroid)
    return centroid


def nearest(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    half = (centroid * centroid).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centroid.T - half, 1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def assigned(batches: Iterator[pa.RecordBatch], centroids: dict[int, np.ndarray], base: dict[int, int], scale: float) -> Iterator[pa.RecordBatch]:
    """Adds each row's list and its distance from the centroid; lists of all dimensions are numbered through."""
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        list_of, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            x = whole(batch.column("v").take(pa.array(mine)), scale)
            own = nearest(x, centroids[dim])
            list_of[mine] = own + base[dim]
            distance[mine] = np.sqrt(((x - centroids[dim][own]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list_of), pa.array(distance)], [*batch.schema.names, "list", "distance"])


def visits(batches: Iterator[pa.RecordBatch], lists: dict[int, Lists], base: dict[int, int], scale: float, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """(anchor columns, list): lists that an anchor still has to visit, of those that begin behind ``first`` and before ``last`` rows by bound.

    ``lo``, ``hi`` and ``kth`` are an anchor's windows and k-th scores (null while fewer are found).
    """
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        lo, hi, kth = (batch.column(c).to_pylist() for c in ("lo", "hi", "kth"))
        rows, lists_of = [], []
        for dim in np.unique(sizes).tolist():
            if dim not in lists:
                continue
            index = lists[dim]
            mine = np.flatnonzero(sizes == dim)
            q = whole(batch.column("v").take(pa.array(mine)), scale)
            middle, reach = q @ index.centroid.T, np.sqrt((q * q).sum(1))[:, None] * index.radius
            slack = 1 + 1e-9 * (np.abs(middle) + reach)  # sums of doubles are not exact
            low, high = middle - reach - slack, middle + reach + slack
            order = np.argsort(-high, axis=1, kind="stable")
            before = np.cumsum(index.rows[order], axis=1) - index.rows[order]
            due = np.zeros_like(high, bool)
            np.put_along_axis(due, order, (before >= first) & (before < last), 1)
            for k, i in enumerate(mine.tolist()):
                wanted = np.zeros(len(index.rows), bool)
                for a, b, t in zip(lo[i], hi[i], kth[i], strict=True):
                    wanted |= (high[k] >= (a if t is None else max(a, t))) & (low[k] <= b)
                found = np.flatnonzero(wanted & due[k])
                rows.append(np.full(len(found), i))
                lists_of.append(found + base[dim])
        if rows:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(np.concatenate(lists_of), pa.int32())], [*batch.schema.names, "list"])


def scores_of(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where they are exact in them, else in Python's integers, cut at a long's limits."""
    bound = np.sqrt((q * q).sum(1).max()) * np.sqrt((y * y).sum(1).max())
    if bound < 1 << 52:
        return (q @ y.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, w, strict=True)) for w in y] for u in q], object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def best_of_block(anchors: pa.Table, rows: pa.Table, same: bool, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """For each anchor and window the first ``k`` rows of the block, and none below the k-th score already found."""
    held = rows.sort_by([("id", "ascending"), ("h", "ascending")])
    ident, h, label = (held.column(c).to_numpy() for c in ("id", "h", "label"))
    distinct = np.append(True, (ident[1:] != ident[:-1]) | (h[1:] != h[:-1]))
    ident, h, label = ident[distinct], h[distinct], label[distinct]
    y = whole(held.column("v").combine_chunks(), scale)[distinct]
    n = len(ident)
    lo, hi, kth = (anchors.column(c).to_pylist() for c in ("lo", "hi", "kth"))
    anchor, anchor_h, own_label = (anchors.column(c).to_numpy() for c in ("anchor", "anchor_h", "anchor_label"))
    q = whole(anchors.column("v").combine_chunks(), scale)
    step = max(1, CELLS // n)
    for c in range(0, len(anchor), step):
        part = slice(c, c + step)
        score = scores_of(q[part], y)
        allowed = (own_label[part, None] == label) == same
        if same:
            allowed &= anchor[part, None] != ident
        own = list(zip(lo[part], hi[part], kth[part], strict=True))
        for w in range(max(len(a) for a, _, _ in own)):
            least = np.array([max(a[w], LEAST if t[w] is None else t[w]) if w < len(a) else MOST for a, _, t in own])
            most = np.array([b[w] if w < len(b) else LEAST for _, b, _ in own])
            at, col = np.nonzero(allowed & (score >= least[:, None]) & (score <= most[:, None]))
            if not len(at):
                continue
            value = score[at, col]
            order = np.lexsort((col, -value, at))  # columns are in order of ids
            at, col, value = at[order], col[order], value[order]
            begin = np.searchsorted(at, at)
            first = np.arange(len(at)) - begin < k
            at, col, value = at[first], col[first], value[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (anchor[part][at], anchor_h[part][at], np.full(len(at), w, np.int32), ident[col], h[col], value)],
                ["anchor", "anchor_h", "window", "id", "h", "score"],
            )


FOUND = "anchor long, anchor_h long, window int, id long, h long, score long"


class Index:
    """Lists of all rows (id, h, label, v), stored in a scratch folder; fitted on a bounded sample, holding every row."""

    def __init__(self, rows: DataFrame, scratch: Scratch, scale: float, sample_rows: int):
        self.scratch, self.scale = scratch, scale
        stored = scratch(rows)
        counts = {r["dim"]: r["n"] for r in stored.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
        if len(counts) > 1000:
            raise ValueError("vectors of more than 1000 different lengths")
        self.n = sum(counts.values())
        share = min(1.0, sample_rows / max(1, self.n))
        drawn = stored.where(F.pmod(F.xxhash64("h", "id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).dropDuplicates(["h"]).limit(2 * sample_rows)
        sizes = {dim: lists_for(n) for dim, n in counts.items()}

        def fit(sample: pa.Table) -> dict[int, np.ndarray]:
            out = {dim: np.zeros((1, dim)) for dim in sizes}
            if sample.num_rows:
                v = sample.column("v").combine_chunks()
                length = v.value_lengths().to_numpy()
                for dim in np.unique(length).tolist():
                    out[dim] = k_means(whole(v.take(pa.array(np.flatnonzero(length == dim))), scale), sizes[dim])
            return out

        centroids = fitted(drawn.select("v"), fit)
        self.base, at = {}, 0
        for dim in sorted(centroids):
            self.base[dim], at = at, at + len(centroids[dim])
        base, kind = self.base, rows.schema["v"].dataType.simpleString()
        columns = f"id long, h long, label long, v {kind}, row long, list int, distance double"
        self.rows = scratch(stored.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda it: assigned(it, centroids, base, scale), columns))
        found = {r["list"]: r for r in self.rows.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()}  # a row a list
        self.lists = {}
        for dim, c in centroids.items():
            own = [found.get(base[dim] + k) for k in range(len(c))]
            radius, n = np.array([r["radius"] if r else -1.0 for r in own]), np.array([r["n"] if r else 0 for r in own])
            self.lists[dim] = Lists(c, np.maximum(radius, 0), n)
        size = block_rows(self.n)
        blocks = rows.sparkSession.createDataFrame([(k, -(-r["n"] // size)) for k, r in sorted(found.items())], "list int, blocks long")
        self.placed = self.rows.join(F.broadcast(blocks), "list").select("id", "h", "label", "v", "list", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"))
        self.blocks = blocks

    def search(self, anchors: DataFrame, same: bool, k: int, growth: int = 16, slice_rows: int = 16_384) -> DataFrame:
        """(anchor, anchor_h, window, id, h, score): for each anchor and window (lo, hi) the first ``k`` rows of its own label, or of others."""
        spark, n_anchors = anchors.sparkSession, anchors.count()
        slices = -(-max(1, n_anchors) // slice_rows)
        anchors = anchors.withColumn("slice", F.pmod(F.xxhash64("anchor", "anchor_h"), F.lit(slices)).cast("int"))
        lists, base, scale = self.lists, self.base, self.scale
        kind = anchors.schema["v"].dataType.simpleString()
        columns = f"anchor long, anchor_h long, anchor_label long, v {kind}, lo array<long>, hi array<long>, slice int, kth array<long>, list int"
        found, first, last = None, 0, block_rows(self.n)
        while first < self.n or found is None:
            if found is None:
                now = anchors.withColumn("kth", F.transform("lo", lambda x: F.lit(None).cast("long")))
            else:
                full = F.when(F.count("*") >= k, F.min("score")).alias("kth")
                reached = found.groupBy("anchor", "anchor_h", "window").agg(full).groupBy("anchor", "anchor_h").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("m"))
                known = anchors.join(reached, ["anchor", "anchor_h"], "left")
                now = known.withColumn("kth", F.transform("lo", lambda x, i: F.try_element_at("m", i.cast("int")))).drop("m")
            to_visit = now.select("anchor", "anchor_h", "anchor_label", "v", "lo", "hi", "slice", "kth").mapInArrow(
                lambda it, a=first, b=last: visits(it, lists, base, scale, a, b), columns
            )
            to_visit = self.scratch(to_visit)
            wanted = to_visit.select("list", F.col("slice").alias("to_slice")).distinct().withColumnRenamed("list", "to_list")
            if len(self.lists) and slices * sum(len(x.rows) for x in self.lists.values()) <= FEW_ROWS:
                wanted = F.broadcast(wanted)
            sent = self.placed.join(wanted, F.col("list") == F.col("to_list")).drop("to_list")
            asked = to_visit.join(F.broadcast(self.blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("blocks")

            def answer(a: pa.Table, r: pa.Table) -> pa.Table:
                none = pa.schema([("anchor", pa.int64()), ("anchor_h", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("score", pa.int64())])
                return pa.Table.from_batches(list(best_of_block(a, r, same, k, scale)) if a.num_rows and r.num_rows else [], none)

            new = asked.groupBy("list", "block", "slice").cogroup(sent.groupBy("list", "block", "to_slice")).applyInArrow(answer, FOUND)
            every = (new if found is None else found.unionByName(new)).distinct()
            best = Window.partitionBy("anchor", "anchor_h", "window").orderBy(F.col("score").desc(), "id", "h")
            found = self.scratch(every.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k"))
            first, last = last, last * growth
        return found


def hard_negatives(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, sample_rows: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are whole inner products. ``anchors`` says which rows are anchors.
    Rows with a null key, label or vector, an empty vector, or a component that is null, not finite or not finite when scaled
    take no part; only vectors of one length are compared. Rows that are equal in key, label and vector count once, others each
    for itself. A positive is a row of another key with the anchor's label; ties go to the smaller key. Anchors without
    positives, and windows without rows, give no rows; nor does an empty table. Scores beyond 2^62 are cut there.
    Other columns are left out. Centroids are fitted on about ``sample_rows`` rows, twice as many at most.
    """
    scratch = Scratch(df.sparkSession)
    try:
        v = F.col(vector)
        if df.schema[vector].dataType.elementType.simpleString() not in ("float", "double"):
            v = v.cast("array<double>")
        usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
        rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & usable)
        rows = rows.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(label).cast("long"), v).alias("h"), F.col(label).cast("long").alias("label"), v.alias("v"), anchors.alias("is_anchor"))
        index = Index(rows.drop("is_anchor"), scratch, scale, sample_rows)
        own = rows.where("is_anchor").select(F.col("id").alias("anchor"), F.col("h").alias("anchor_h"), F.col("label").alias("anchor_label"), "v").dropDuplicates(["anchor", "anchor_h"])
        own = scratch(own)
        everything = own.withColumns({"lo": F.array(F.lit(LEAST)), "hi": F.array(F.lit(MOST))})
        found = index.search(everything, True, positives)
        order = Window.partitionBy("anchor", "anchor_h").orderBy(F.col("score").desc(), "id", "h")
        best = scratch(found.select("anchor", "anchor_h", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.row_number().over(order) - 1).alias("window")))
        # floor and ceiling of the window's ends, in whole numbers
        p = F.col("p.positive_score")
        ends = best.groupBy("anchor", "anchor_h").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("p"))  # `positives` rows at most
        lo = F.transform("p", lambda x: -_floor_percent(-x["positive_score"], low))
        hi = F.transform("p", lambda x: _floor_percent(x["positive_score"], high))
        asked = own.join(ends, ["anchor", "anchor_h"]).select("anchor", "anchor_h", "anchor_label", "v", lo.alias("lo"), hi.alias("hi"))
        mined = index.search(scratch(asked), False, negatives)
        rank = F.row_number().over(Window.partitionBy("anchor", "anchor_h", "window").orderBy(F.col("score").desc(), "id", "h")).cast("int")
        out = mined.withColumn("rank", rank).join(best, ["anchor", "anchor_h", "window"])
        return materialize(out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    finally:
        scratch.clear()


def _floor_percent(x: Column, percent: int) -> Column:
    """floor(percent * x / 100) in decimals, so that no product overflows."""
    return F.floor(x.cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


#: DuckDB: every anchor against every row.
OP11_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
