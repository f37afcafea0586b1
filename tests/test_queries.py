"""Every registered query with SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from eventloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}") + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duck.execute(sql)
    want = rows([d[0] for d in con.description], con.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6), (name, a, b)


def test_entry_runs_and_no_plan_is_a_cartesian_product(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    for name in ("in_intervals", "have_intervals", "trig_fr_box", "ccg_count", "interp_previous", "interval_union"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
