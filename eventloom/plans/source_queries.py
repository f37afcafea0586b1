"""Queries that write tables to recording files and read them back: what comes back must be what SQL sees in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.scalar import convert_by_type
from eventloom.functions.timing import MINUTE
from eventloom.plans.interval_queries import EV
from eventloom.plans.registry import query
from eventloom.sources import recordings, records
from eventloom.sources.tables import events, scratch, table

_KINDS = ("click", "view", "purchase", "signup", "error")
_TYPE = f"1(time:1i8,user:1i4,kind:({','.join(f'{k}:{i}' for i, k in enumerate(_KINDS))})1i1,high:1b4,place:(x,y)2f4,marks:((flags)Even:1,Third:2)1u1,label:8c1,value:1f8)42"


def _stored(spark, sf):
    """Events as record files of one type, read back."""
    ev = events(spark, sf)
    marks = F.concat_ws("_", F.when(F.col("event_id") % 2 == 0, "Even"), F.when(F.col("event_id") % 3 == 0, "Third"))
    rows = ev.select(
        F.col("t").alias("Time"), F.col("user_id").cast("int").alias("User"), F.col("event_type").alias("Kind"), (F.col("value") > 50).alias("High"),
        F.array((F.col("user_id") * 0.5).cast("float"), (F.col("event_id") % 16).cast("float")).alias("Place"), marks.alias("Marks"), F.concat(F.lit("é"), F.col("event_type")).alias("Label"), F.col("value").alias("Value"),
    )
    folder = scratch(spark, "records")
    records.write_records(rows, folder, _TYPE).agg(F.sum("n")).first()
    return records.read_records(spark, folder)


@query(f"""WITH {EV} SELECT t AS "Time", CAST(user_id AS INTEGER) AS "User", event_type AS "Kind", value > 50 AS "High", user_id * 0.5 AS x, CAST(event_id % 16 AS DOUBLE) AS y,
concat_ws('_', CASE WHEN event_id % 2 = 0 THEN 'Even' END, CASE WHEN event_id % 3 = 0 THEN 'Third' END) AS "Marks", substr('é' || event_type, 1, 7) AS "Label", value AS "Value" FROM ev""")
def record_files(spark, sf):
    """Enumerations, flags, truth values, vectors, texts and numbers of record files."""
    place = F.col("Place")
    return _stored(spark, sf).select("Time", "User", "Kind", "High", place[0].cast("double").alias("x"), place[1].cast("double").alias("y"), "Marks", "Label", "Value")


@query(f'WITH {EV} SELECT event_type AS "Kind", CAST(count(*) AS BIGINT) AS n, min(t) AS first, max(t) AS last FROM ev GROUP BY 1')
def record_file_summary(spark, sf):
    return _stored(spark, sf).groupBy("Kind").agg(F.count(F.lit(1)).alias("n"), F.min("Time").alias("first"), F.max("Time").alias("last"))


@query(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT name, position AS place, kind, CAST(size AS BIGINT) AS size, CAST(size * n AS BIGINT) AS stored FROM n, (VALUES ('Time', 0, 'i8', 8), ('User', 8, 'i4', 4), ('Kind', 12, 'i1', 1), ('High', 13, 'b4', 4), ('Place', 17, 'f4', 8), ('Marks', 25, 'u1', 1), ('Label', 26, 'c1', 8), ('Value', 34, 'f8', 8)) v(name, position, kind, size)")
def record_layout(spark, sf):
    """Columns of a type text with their places in a row, and the bytes that the stored events take in each."""
    own = records.leaves(records.parse_type(_TYPE))
    dtype = records.layout(own)
    n = _stored(spark, sf).agg(F.count(F.lit(1)).alias("n"))  # one row
    columns = spark.createDataFrame([(t.name, int(dtype.fields[t.name][1]), t.kind, int(dtype.fields[t.name][0].itemsize)) for t in own], "name string, place int, kind string, size long")
    return columns.crossJoin(F.broadcast(n)).select("name", "place", "kind", "size", (F.col("size") * F.col("n")).alias("stored"))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def npy_files(spark, sf):
    """Vectors as NPY arrays with their id as the first number, read back in ranges of rows."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    folder = scratch(spark, "npy")
    recordings.write_npy(rows, folder, "v").agg(F.sum("n")).first()
    v = F.col("values")
    back = recordings.read_npy(spark, folder)
    total = F.aggregate(F.slice(v, 2, 1 << 20), F.lit(0.0), lambda a, b: a + b)
    return back.select(v[0].cast("long").alias("vec_id"), F.round(total, 6).alias("total"), (F.size(v) - 1).cast("long").alias("n"))


@query(f"""WITH {EV}, m AS (SELECT user_id % 4 AS channel, t // {MINUTE} AS sample, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT CAST(channel * 100000 + sample // 1024 AS BIGINT) AS timestamp, round(sum(n) * 0.195, 6) AS total, CAST(count(*) AS BIGINT) AS filled FROM m GROUP BY 1""")
def continuous_files(spark, sf):
    """Counts by minute as block-wise channel files, read back in microvolts."""
    m = events(spark, sf).groupBy((F.col("user_id") % 4).alias("channel"), F.expr(f"t div {MINUTE}L").alias("sample")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    stamp = F.col("channel") * 100000 + F.expr("sample div 1024")
    blocks = m.groupBy(stamp.alias("timestamp")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("sample", F.lit(1024)).alias("k"), "n"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long")), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)))
    folder = scratch(spark, "continuous")
    recordings.write_continuous(blocks.select("timestamp", filled.alias("samples")), folder).agg(F.sum("n")).first()
    back = recordings.read_continuous(spark, folder)
    return back.select("timestamp", F.round(F.aggregate("samples", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.size(F.filter("samples", lambda x: x > 0)).cast("long").alias("filled"))


_CHANNELS = ["left", "right", "lick", "reward"]


@query(f"""WITH {EV}, r AS (SELECT t // 1000 AS ts, user_id % 4 + 1 AS channel, value > 50 AS rising FROM ev) SELECT ts - 1000 AS timestamp, round((ts - 1000) / 30000.0, 9) AS t, CAST(channel AS INTEGER) AS channel,
CASE channel WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'lick' ELSE 'reward' END AS channel_name, rising, 'Dig' AS type FROM r""")
def event_row_files(spark, sf):
    """Events as digital lines in rows of 16 bytes, read back against a start."""
    rows = events(spark, sf).select(F.expr("t div 1000L").alias("timestamp"), (F.col("user_id") % 4 + 1).cast("int").alias("channel"), (F.col("value") > 50).alias("rising"))
    folder = scratch(spark, "events")
    recordings.write_event_rows(rows, folder).agg(F.sum("n")).first()
    back = recordings.read_event_rows(spark, folder, _CHANNELS, 1000)
    return back.select("timestamp", F.round("t", 9).alias("t"), "channel", "channel_name", "rising", "type")


@query(f"WITH {EV} SELECT 'World' || event_type AS name, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(t) * 10 AS first FROM ev GROUP BY 1")
def log_files(spark, sf):
    """Events as log lines, read back as typed series by name."""
    lines = events(spark, sf).select(F.format_string("[%d] World.%s (System.Double) = %s", F.col("t") * 10, F.col("event_type"), F.col("value").cast("string")).alias("value"))
    folder = scratch(spark, "log")
    lines.write.text(folder)
    back = recordings.read_log(spark, folder).where("name is not null")
    number = convert_by_type(F.col("type"), F.col("value"))["as_double"]
    return back.withColumn("x", number).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"), F.min("ticks").alias("first"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'unknown' END AS priority FROM orders")
def evolved_session(spark, sf):
    """Saved tables of an older schema, without a column, and a newer one, loaded together with a default."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("priority"))
    old, new = scratch(spark, "session"), scratch(spark, "session")
    o.where("o_orderkey % 2 = 1").drop("priority").write.parquet(old)
    o.where("o_orderkey % 2 = 0").write.parquet(new)
    return recordings.load_evolved(spark, [old, new], {"priority": "unknown"})


@query("SELECT n_name AS name, concat('Assets/', n_name) AS path, substr(md5(n_name), 1, 32) AS guid, n_nationkey % 3 = 0 AS is_dir FROM nation")
def asset_table(spark, sf):
    """Name, path, guid and kind of side-car texts."""
    from eventloom.operators.recording import assets

    text = F.concat(F.lit("fileFormatVersion: 2\nguid: "), F.md5("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("\nfolderAsset: yes")).otherwise(F.lit("")))
    return assets(table(spark, sf, "nation").select(F.concat(F.lit("Assets/"), F.col("n_name"), F.lit(".meta")).alias("path"), text.alias("value")))


@query("SELECT CAST(n_nationkey AS BIGINT) AS channel, n_name AS name, CAST(n_regionkey AS BIGINT) AS grp FROM nation")
def xml_files(spark, sf):
    """A side-car of channels written as XML and read back."""
    folder = scratch(spark, "xml")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("channel"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("grp"))
    n.write.format("xml").option("rootTag", "parameters").option("rowTag", "unit").save(folder)
    return spark.read.format("xml").option("rowTag", "unit").schema("channel long, name string, grp long").load(folder)
