from pyspark.sql import functions as F

from eventloom.operators import ordered


def test_no_frame_runs_up_to_the_last_row(spark):
    """Such a frame is summed anew for each row, which is quadratic in the rows of a bucket."""
    q, table = spark.range(300).select((F.col("id") * 7).alias("t")), spark.range(200).select((F.col("id") * 11).alias("t"), (F.col("id") * 2).alias("v"))
    for mode in ("previous", "next"):
        for width in (100, 10_000):
            out = ordered.asof(q, table, ["v"], mode, width=width)
            assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
            for t, v in out.select("t", "v").collect():
                hits = [k for k in range(200) if (k * 11 <= t if mode == "previous" else k * 11 >= t)]
                assert v == ((hits[-1] if mode == "previous" else hits[0]) * 2 if hits else None)
