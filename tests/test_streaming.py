from datetime import datetime, timedelta

from eventloom.streaming import events as S

START = datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, v double"


def feed(spark, tmp_path, batches, f, mode="append"):
    """Runs a streaming query over one file a batch; the last batch moves the watermark on."""
    src = str(tmp_path / "in")
    for rows in [[], *batches]:
        spark.createDataFrame([(u, START + timedelta(seconds=t), v) for u, t, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"out_{tmp_path.name.replace('-', '_')}"
    q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


BATCHES = [[("a", 0, 1.0), ("a", 5, None), ("b", 7, 2.0)], [("a", 30, 3.0), ("a", 31, None), ("b", 32, None)], [("a", 4000, 0.0)], [("a", 8000, 0.0)]]


def test_rates(spark, tmp_path):
    got = feed(spark, tmp_path, BATCHES, lambda s: S.rates(s, ["user"], "10 seconds", "10 seconds", "1 minute"))
    n = {(r.user, int((r.t0 - START).total_seconds())): (r.n, r.rate) for r in got}
    assert n[("a", 0)] == (2, 0.2) and n[("b", 0)] == (1, 0.1) and n[("a", 30)] == (2, 0.2)


def test_runs(spark, tmp_path):
    got = feed(spark, tmp_path, BATCHES, lambda s: S.runs(s, ["user"], "10 seconds", "1 minute"))
    assert sorted((r.user, int((r.t0 - START).total_seconds()), r.n) for r in got)[:4] == [("a", 0, 2), ("a", 30, 2), ("a", 4000, 1), ("b", 7, 1)]


def test_latest_value(spark, tmp_path):
    got = feed(spark, tmp_path, BATCHES, lambda s: S.latest_value(s, "user", "v", "1 hour"))
    assert sorted((r.user, r.held) for r in got) == [("a", 1.0), ("a", 3.0), ("b", 2.0)]


def test_in_intervals_is_the_batch_join(spark):
    e = spark.createDataFrame([("a", START), ("a", START + timedelta(seconds=9)), ("b", START)], "user string, ts timestamp")
    i = spark.createDataFrame([("a", START, START + timedelta(seconds=9))], "user string, t0 timestamp, t1 timestamp")
    assert S.in_intervals(e, i, "user", "1 minute").count() == 1
