"""Registered queries vs their DuckDB oracles on sf0.001 (fast subset)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tieout.registry import QUERIES, oracle_sql
from tieout.sources.fixtures import BASE_TABLES

from .conftest import SF_SMALL

FAST = ["a1_ledger_clean", "a3_deposits_clean", "b1_ledger_client_item", "b6_ledger_client_item_tree",
        "d2_best_payroll_client", "d4_unified_matches", "e1_client_summary", "e5_variance_analysis",
        "k3_cart_links", "e7_match_trace"]


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_of_the_library_has_an_oracle():
    assert set(oracle_sql()) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    want = _rows([d[0] for d in rel.description], rel.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in rel.description)
    assert got == want
