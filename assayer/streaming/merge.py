"""Incremental upserts of a stream of records: each micro-batch is merged and published."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators import published
from assayer.operators.dedup import newest
from assayer.operators.merge import upsert


def merge_batch(batch: DataFrame, path: str, keys: list[str], seq: str = "seq", parts: int = 32) -> None:
    """Upserts a batch into a table of ``parts`` parts by hashed key; only parts that it touches are written anew.

    ``parts`` holds for a new table, an old one keeps its number. Readers see all of a batch or none of it; a batch that is merged again changes nothing.
    If another writer publishes in the meantime, ``published.Conflict`` is raised and nothing changes: the stream's restart merges the batch again.
    """
    spark = batch.sparkSession
    base = published.version(spark, path)
    now = published.parts(spark, path, base)
    parts = len(now) or parts
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")
    last = newest(batch, [F.col(k) for k in keys], [F.col(seq).desc()]).withColumn("_part", part)
    touched = [r[0] for r in last.select("_part").distinct().collect()]  # at most ``parts``
    if not touched and now:
        return
    held = [p for p in touched if now.get(p)]
    if held:
        old = published.read(spark, path, only=held, number=base)
        last = upsert(old.withColumn("_part", part), last, *keys)
    folder = uuid.uuid4().hex
    last.repartition("_part").write.partitionBy("_part").parquet(f"{path}/{published.DATA}/{folder}")
    published.commit(spark, path, {str(p): "" for p in range(parts)} | now | {p: f"{folder}/_part={p}" for p in touched}, base=base)


def merge_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, seq: str = "seq", parts: int = 32) -> StreamingQuery:
    """Keeps the last record of each key in the published table ``path`` (``published.read``).

    ``seq`` orders records of one batch; a later batch wins over an earlier one.
    """

    def merge(batch: DataFrame, _: int) -> None:
        merge_batch(batch, path, keys, seq, parts)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
