"""CSV of strings, raw bytes with digests, and tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quotes may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def below(spark: SparkSession, root: str, path: Column) -> Column:
    """A file's path relative to the folder ``root``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    base = re.sub("^file:/+", "file:/", whole.rstrip("/"))
    return F.substring(F.regexp_replace(path, "^file:/+", "file:/"), F.lit(len(base) + 2), F.length(path))


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, digest) of every file below ``path``; paths are relative to it, as in a manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(below(spark, path, F.col("path")).alias("path"), F.sha2("content", 256).alias("digest"))


# What no release lists.
IGNORED_FOLDERS = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "build", "dist", "venv")
IGNORED_ENDINGS = (".lock", ".log", ".pyc", ".pyo")


def listed(path: Column) -> Column:
    """Whether a relative path belongs to a release: no caches, builds, logs or files of settings."""
    parts = F.split(path, "/")
    name, folders = F.try_element_at(parts, F.lit(-1)), F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(folders, lambda p: p.isin(*IGNORED_FOLDERS) | F.endswith(p, F.lit(".egg-info")))
    ending = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    return ~hidden & ~ending.isin(*IGNORED_ENDINGS) & (name != ".env") & ~F.startswith(name, F.lit(".env."))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of a release's files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(below(spark, root, F.col("path")).alias("path"), F.col("length").alias("size")).where(listed(F.col("path")))


def import_folders(spark: SparkSession, pairs: list[tuple[str, str]], verify: Callable[[], bool]) -> None:
    """Copies folders to places that are still free; if a copy fails or ``verify`` says no, what was copied goes again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    ends = [(jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b)) for a, b in pairs]
    of = [(a.getFileSystem(conf), b.getFileSystem(conf)) for a, b in ends]
    for (_, to), (_, fs) in zip(ends, of, strict=True):
        if fs.exists(to):
            raise FileExistsError(to.toString())
    copied = []
    try:
        for (at, to), (source, target) in zip(ends, of, strict=True):
            copied.append((target, to))
            if not jvm.org.apache.hadoop.fs.FileUtil.copy(source, at, target, to, False, conf):
                raise OSError(f"cannot copy {at.toString()}")
        if not verify():
            raise ValueError("what was imported is not complete")
    except BaseException:
        for fs, to in copied:
            fs.delete(to, True)
        raise
