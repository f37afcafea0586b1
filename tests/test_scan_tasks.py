from pyspark.sql import functions as F

from eventloom.operators import scans


def test_few_bytes_of_blocks_are_spread_over_tasks(spark):
    """By their bytes alone all blocks would meet in one task."""
    rows = spark.range(400).select((F.col("id") % 40).alias("key"), F.expr("id div 40").alias("bin"), F.array(F.lit(0.0), F.lit(-1.0)).alias("e"), F.array(*[F.lit(x) for x in (0.9, 0.1, 0.1, 0.9)]).alias("a"), F.array_repeat(F.lit(0.5), 2).alias("start"))
    out = scans.hidden_states(rows, ("key",), "bin", 2, width=4)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
