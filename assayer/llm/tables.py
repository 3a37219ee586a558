"""Reading tables, keeping intermediate results and sizing shuffles."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from assayer.llm.words import release


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where all run on one machine (tests) and none is named, a folder of our own is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-assayer-"))
    return sc.getCheckpointDir()


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. Deleted when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/assayer-{uuid.uuid4().hex}"
    out = _written(df, path)
    fs, at = _folder(df.sparkSession, path)
    fs.deleteOnExit(at)
    return out


class Scratch:
    """Tables of one computation in a folder of its own; ``clear`` deletes them when its result is written or has failed."""

    def __init__(self, spark: SparkSession):
        self._spark, self._root, self._n = spark, f"{shared_dir(spark)}/assayer-{uuid.uuid4().hex}", 0
        self._at: dict[int, int] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        self._n += 1
        self._at[id(out := _written(df, f"{self._root}/{self._n}"))] = self._n
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, if any; the driver then collects its garbage, by which shuffles of earlier steps go too."""
        for table in tables:
            fs, at = _folder(self._spark, f"{self._root}/{self._at.pop(id(table))}")
            fs.delete(at, True)
        gc.collect()
        self._spark._jvm.System.gc()

    def clear(self) -> None:
        fs, at = _folder(self._spark, self._root)
        fs.delete(at, True)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of a bounded sample, in one task: only the model comes to the driver. An empty sample gives a table without columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            model = pickle.dumps(fit(pa.Table.from_batches(held)))
            held.clear()
            release()
            yield pa.RecordBatch.from_pydict({"model": [model]})

    row = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(row[0]["model"]) if row else fit(pa.table({}))


def schema_of(df: DataFrame, columns: list[str], *more: tuple[str, DataType]) -> StructType:
    """Fields of ``df`` by these names, and further ones."""
    return StructType([*(df.schema[c] for c in columns), *(StructField(n, t) for n, t in more)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pages_for(df: DataFrame, text: str, page_bytes: int) -> int:
    """How many pages of about ``page_bytes`` hold the column, at least one for each shuffle partition."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), int(total // page_bytes) + 1)
