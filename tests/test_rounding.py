import random

import duckdb
from pyspark.sql import functions as F

from eventloom.functions.scalar import rounded
from eventloom.operators import sync


def test_rounding_is_that_of_the_sql(spark):
    r = random.Random(1)
    values = [0.285, 1.005, 2.675, -1.005, 1e300, float("inf"), float("nan"), 123456789012.3455, *[r.randrange(10**7) / 1000 for _ in range(3000)], *[r.randrange(10**6) / r.choice([0.03, 0.08, 0.0007]) for _ in range(3000)]]
    con = duckdb.connect()
    for places in (2, 4, 9):
        got = [x.v for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").select("i", rounded(F.col("x"), places).alias("v")).orderBy("i").collect()]
        want = [con.execute(f"SELECT round(CAST(? AS DOUBLE), {places})", [v]).fetchone()[0] for v in values]
        assert [repr(v) for v in got] == [repr(v) for v in want]


def test_usual_distance_of_many_pulses_is_exact(spark):
    r = random.Random(2)
    first = [(k * 1_000_000,) for k in range(25_000)]
    second = [(t + 200_000 + r.randrange(100_000),) for t, in first]
    d = sorted(b[0] - a[0] for a, b in zip(first, second, strict=True))
    middle = d[(len(d) - 1) // 2]
    pairs = sync.matched_with_gaps(spark.createDataFrame(first, "t long"), spark.createDataFrame(second, "t long"), 10_000).collect()
    assert sorted(y - x for x, y in pairs) == [v for v in d if abs(v - middle) <= 10_000]
