"""Every telemetry query against its DuckDB SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from wardlake.plans import ingestion, states
from wardlake.plans.queries import QUERIES, SQL

assert ingestion and states  # register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


def listed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = listed(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(SQL[name])
    assert got == listed(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.collect()) > 0 and df.columns
