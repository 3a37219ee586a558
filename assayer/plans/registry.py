"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.operators import dedup
from assayer.plans.carriers import carrier
from assayer.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Carriers and generic tables by name, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return carrier(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def single(self) -> DataFrame:
        return dedup.single(self["j_single"])

    @property
    def pairs(self) -> DataFrame:
        return dedup.pairwise(self["j_pair"])


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register
