"""Every registered query of the main library against its SQL, on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from assayer.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = rows(QUERIES[name](spark, sf_dir).toArrow())
    if name in ORACLES:
        assert got == rows(duck.sql(ORACLES[name]).to_arrow_table())
