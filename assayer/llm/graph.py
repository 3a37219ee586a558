"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.tables import Scratch, materialize

#: Edges that one task joins up by itself.
LOCAL_EDGES = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating stars: each node hands the smallest node next to it to the others.

    ``edges`` are (u, v) with u > v. Minima are pre-aggregated before the shuffle and met again by a
    join; where one node has very many neighbours, adaptive execution splits its side of that join.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(turned) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u <> v").distinct()


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest of ``n`` nodes reachable from each by the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)  # whole trees are hung under the smaller root
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: each node with the smallest one that the task's edges reach."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(at[: len(u)], at[len(u) :], len(nodes))
        some = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every node of ``edges`` (u long, v long); the smallest id names a component.

    Self-loops and nulls are ignored, repeated edges count once; no edges give no rows. Each task first
    joins up its own edges; where all fit in one task (``LOCAL_EDGES``) that is all, else rounds of
    alternating stars follow until nothing changes.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def contracted(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
        tasks = n // LOCAL_EDGES + 1
        return scratch(df.repartition(tasks).mapInArrow(_joined_up, "u long, v long")), tasks == 1

    def digest(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, done = contracted(now, now.count())
    before = None if done else digest(now)
    for _ in range(max_rounds):
        if done:
            break
        now = scratch(_star(_star(now, large=True), large=False))
        after = digest(now)
        done, before = after == before, after
    else:
        if not done:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    top = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    out = materialize(now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(top))
    scratch.clear()
    return out
