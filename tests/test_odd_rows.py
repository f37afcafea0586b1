"""Queries on rows that the given tables lack, held against their SQL in DuckDB."""

import math
from itertools import product

import duckdb
import pytest

from eventloom.plans import registry

NAN, INF = float("nan"), float("inf")


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def compared(spark, at, name):
    """Both results, sorted, with floats to their last digit."""
    df = registry.queries()[name](spark, str(at))
    con = duckdb.connect()
    for f in at.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    sql = con.execute(registry.oracle_sql()[name])
    places = [[d[0] for d in sql.description].index(c) for c in df.columns]
    return sorted([shown(v) for v in r] for r in df.collect()), sorted([shown(r[i]) for i in places] for r in sql.fetchall())


@pytest.mark.parametrize("name", ["elementwise", "values_divided"])
def test_divisions_by_nothing_and_of_nothing(spark, tmp_path, name):
    values = [None, -2.0, -0.0, 0.0, 0.285, 25.0, INF, NAN]
    rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in vs) + f", {i})" for i, vs in enumerate(product(values, values, values)))
    duckdb.sql(f"""SELECT CAST(k AS BIGINT) AS l_orderkey, 1 AS l_linenumber, CAST(q AS DOUBLE) AS l_quantity, CAST(d AS DOUBLE) AS l_discount, CAST(p AS DOUBLE) AS l_extendedprice, 0.05::DOUBLE AS l_tax
    FROM (VALUES {rows}) v(q, d, p, k)""").write_parquet(str(tmp_path / "lineitem.parquet"))
    got, want = compared(spark, tmp_path, name)
    assert len(got) == len(want) == 512
    assert got == want


def test_places_of_equal_minima_are_the_first(spark, tmp_path):
    price = "CASE WHEN i % 9 = 0 THEN NULL WHEN i % 31 = 0 THEN 'nan'::DOUBLE ELSE i * 37 % 5 END"
    duckdb.sql(f"""SELECT i % 11 AS l_suppkey, CASE WHEN i % 13 <> 0 THEN i * 7919 % 10007 END AS l_orderkey, CAST(i % 7 AS INTEGER) AS l_linenumber, {price} AS l_extendedprice
    FROM range(20000) r(i) UNION ALL SELECT 11, 1, 1, NULL UNION ALL SELECT 12, NULL, 1, 2.0""").write_parquet(str(tmp_path / "lineitem.parquet"))
    got, want = compared(spark, tmp_path, "second_output")
    assert len(got) == 13
    assert got == want


@pytest.mark.parametrize("left_out", ["false", "event_id % 7 = 3 OR event_id % 11 = 5"])
def test_drift_of_few_pulses_is_that_of_least_squares(spark, tmp_path, left_out):
    duckdb.sql(f"""SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 60000000 + i * i * 7919 % 50000000) AS ts, 0::BIGINT AS user_id, 'purchase' AS event_type, 0.0 AS value
    FROM (SELECT i, i AS event_id FROM range(300) r(i)) WHERE NOT ({left_out})""").write_parquet(str(tmp_path / "events.parquet"))
    got, want = compared(spark, tmp_path, "clock_drift")
    assert got == want
