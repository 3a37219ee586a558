"""Tables that are published as a whole: a manifest names the folders that make up a version.

New folders are written beside the old ones, then a manifest with the next number is put into place.
Readers take the manifest with the largest number, so they see the old or the new version, and a writer that dies
before that leaves the old one as it was. Only folders that no kept manifest names are deleted.

Writers do not wait for each other. A manifest's number is taken by one of them alone; another that was
derived from the same version finds it taken, reads again, and derives its change anew (``update``). Putting a manifest into place must
fail where there is one: a hard link does so on local disks, a rename on HDFS; on object stores give a file system that offers it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "_manifests", "data"
#: Manifests outlive their folders, so that a late writer finds its number taken.
MOST_MANIFESTS, LATE = 1000, 4


class Conflict(OSError):
    """Another writer published a version in the meantime."""


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = file_system(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def version(spark: SparkSession, path: str) -> int:
    """Number of the current version; 0 if none is published."""
    return max(_numbers(spark, path), default=0)


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    fs, at = file_system(spark, f"{path}/{MANIFESTS}/{number:09d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def parts(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """Part and folder of a version, else of the current one (an empty one for a part without rows); nothing if none is published."""
    number = version(spark, path) if number is None else number
    return _manifest(spark, path, number) if number else {}


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, only: list[str] | None = None, number: int | None = None) -> DataFrame:
    """The current version or the one with a number, or some of its parts."""
    found = parts(spark, path, number)
    folders = [f"{path}/{DATA}/{folder}" for part, folder in sorted(found.items()) if folder and (only is None or part in only)]
    reader = spark.read.format(fmt).schema(schema) if schema else spark.read.format(fmt)
    return reader.load(folders)


def _put(spark: SparkSession, temporary, final, fs) -> bool:
    """Moves a file to a place that must be free; whether it was."""
    if final.toUri().getScheme() in (None, "file"):
        a, b = (spark._jvm.java.io.File(p.toUri().getPath()) for p in (temporary, final))
        try:
            spark._jvm.java.nio.file.Files.createLink(b.toPath(), a.toPath())
        except Py4JJavaError:
            if b.exists():
                return False
            raise
        return True
    return fs.rename(temporary, final)


def commit(spark: SparkSession, path: str, folders: dict[str, str], keep: int = 2, base: int | None = None) -> None:
    """Makes these folders (below ``data``) the current version and deletes those of versions before the last ``keep``.

    ``base``: the version that they were derived from; raises ``Conflict`` if it is not the current one any more.
    """
    numbers = _numbers(spark, path)
    number = (max(numbers, default=0) if base is None else base) + 1
    fs, temporary = file_system(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    _, final = file_system(spark, f"{path}/{MANIFESTS}/{number:09d}.json")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    taken = max(numbers, default=0) >= number or not _put(spark, fs.makeQualified(temporary), fs.makeQualified(final), fs)
    if fs.exists(temporary):
        fs.delete(temporary, False)
    if taken:
        raise Conflict(f"another writer published {path}")
    every = [*(n for n in numbers if n < number), number]
    stays, old = every[-keep:], every[:-keep][-LATE:]  # what a writer that died has not deleted is found by the next ones
    held = {"", *(f.split("/")[0] for k in stays for f in _manifest(spark, path, k).values())}
    gone = {f.split("/")[0] for k in old for f in _manifest(spark, path, k).values()} - held
    for folder in gone:
        fs.delete(file_system(spark, f"{path}/{DATA}/{folder}")[1], True)
    for k in every[:-MOST_MANIFESTS]:
        fs.delete(file_system(spark, f"{path}/{MANIFESTS}/{k:09d}.json")[1], False)


def _written(df: DataFrame, path: str, fmt: str, sort_within: tuple[str, ...]) -> str:
    folder = uuid.uuid4().hex
    (df.orderBy(*sort_within) if sort_within else df).write.format(fmt).save(f"{path}/{DATA}/{folder}")
    return folder


def publish(df: DataFrame, path: str, fmt: str = "json", sort_within: tuple[str, ...] = (), base: int | None = None) -> None:
    """``df`` becomes the whole table; it may be derived from the version it replaces.

    With ``sort_within`` the rows of the table are in that order over all its files (range partitions). With ``base``
    it is refused (``Conflict``) if another version than that is current; else the last writer wins.
    """
    spark, folder = df.sparkSession, _written(df, path, fmt, sort_within)
    while True:
        try:
            return commit(spark, path, {"": folder}, base=base)
        except Conflict:
            if base is not None:
                file_system(spark, path)[0].delete(file_system(spark, f"{path}/{DATA}/{folder}")[1], True)
                raise


def update(
    spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], fmt: str = "parquet", schema: str | None = None,
    sort_within: tuple[str, ...] = (), attempts: int = 50, keep: int = 8,
) -> None:
    """Publishes ``change`` of the current version (None if there is none), safe with any number of writers.

    If another writer was faster, its version is read and changed again; no update is lost. ``keep`` versions stay, so that
    slow writers still find the one that they read.
    """
    for k in range(attempts):
        base, folder = version(spark, path), None
        try:
            now = read(spark, path, fmt, schema, number=base) if base else None
            folder = _written(change(now), path, fmt, sort_within)
            return commit(spark, path, {"": folder}, keep, base)
        except (Conflict, PySparkException, Py4JJavaError, OSError):
            if folder:
                file_system(spark, path)[0].delete(file_system(spark, f"{path}/{DATA}/{folder}")[1], True)
            if version(spark, path) == base:  # no other writer: the change itself failed
                raise
            time.sleep(min(1.0, 0.05 * (k + 1)))
    raise Conflict(f"{path} is written by others all the time")
