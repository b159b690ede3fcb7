"""Registered queries against their SQL on the smallest tables.

A sample of each family by default; TIDEPANEL_ALL=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ("M3 M8 M9 M14 M17 C1 C5 C7 C9 C10 G5 G6 T4 T8 T10 T15 T20 T23 T24 T30 T31 T34 E1 E2 E3 P4 P5 P9 P11 J3 J5 J8 J12 K3 K5 "
          "U3 V1 V6 V10 V13 X3 X4 X5 X8 X10 X12 R3 R6 R7 L1 L3 Q2 Q4 A8 S1 S6 S12 S14 S16 S17 W1 W3 F2").split()
KEYS = sorted(entry.oracle_sql()) if os.environ.get("TIDEPANEL_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(v):
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*names).collect())
    cur = duck.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    where = [cols.index(n) for n in names]
    assert got == sorted(tuple(cell(r[i]) for i in where) for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_but_the_fitted_models():
    from tidepanel import plans
    plans.load()
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"X11", "L2"} and set(plans.QUERIES) <= set(entry.queries())


def test_sparse_weights_find_the_signal(spark, table):
    from tidepanel.operators import compose as cp
    rows = [(f"2024-01-{d:02d}", str(c), float(c - 2), float((c * 3 + d) % 5 - 2), 0.1 * (c - 2)) for d in range(1, 11) for c in range(5)]
    df = table(rows, "date string, code string, good double, noise double, target double")
    model = cp.l1_weights(df, ["good", "noise"], "target", 0.05)
    assert model.coefficients[0] > 0.5 and abs(model.coefficients[1]) < 0.05
