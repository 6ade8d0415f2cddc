"""Every query with a DuckDB oracle agrees with it (rows, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from rolefit.sources.tables import TABLES
from tests.conftest import SF_SMALL

ORACLES = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows, cols = df.collect(), df.columns
    rel = duck.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(cols) == sorted(dcols)
    oi = sorted(range(len(cols)), key=lambda i: cols[i])
    od = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted((tuple(_norm(r[i]) for i in oi) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in od) for r in drows), key=repr)
    assert a == b


def test_every_query_has_a_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 60
