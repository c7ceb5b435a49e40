"""Every registered report query against its SQL oracle on the smallest fixture,
with its plan free of Python nodes."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from ledgerlens.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        t = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and math.isnan(v):
                v = None
            if hasattr(v, "isoformat"):
                v = str(v)[:10]
            t.append(v)
        out.append(tuple(t))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query_matches_oracle(spark, con, name):
    df = queries.REGISTRY[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    cols = df.columns
    got = _norm(df.collect(), cols)
    cur = con.execute(oracle.Q[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    want = _norm(cur.fetchall(), dcols)
    assert got == want


def test_every_query_has_an_oracle():
    assert set(queries.REGISTRY) == set(oracle.Q) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 5
