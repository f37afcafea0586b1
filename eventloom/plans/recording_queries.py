"""Queries of recording operators, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions.timing import HOUR, MINUTE
from eventloom.operators import recording as R
from eventloom.plans.interval_queries import EV
from eventloom.plans.registry import query
from eventloom.sources.tables import events, table

_E = f"WITH {EV}"
_SIG = f"""{_E}, h AS (SELECT user_id % 4 AS channel, t // {HOUR} AS sample, count(*) AS n FROM ev GROUP BY 1, 2), s AS (SELECT channel, sample, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT channel, sample FROM (SELECT unnest(range(0, 4)) AS channel), (SELECT unnest(range(0, (SELECT max(sample) + 1 FROM h))) AS sample)) LEFT JOIN h USING (channel, sample))"""


def _signal(spark, sf):
    h = events(spark, sf).groupBy((F.col("user_id") % 4).alias("channel"), F.expr(f"t div {HOUR}L").alias("sample")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    last = h.agg(F.max("sample").alias("last"))  # one row
    grid = spark.range(4).select(F.col("id").alias("channel")).crossJoin(F.broadcast(last)).select("channel", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("sample"))
    return grid.join(h, ["channel", "sample"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


@query(f"{_SIG} SELECT CAST(channel AS BIGINT) AS channel, CAST(sample AS BIGINT) AS sample, value * 0.5 AS value FROM s WHERE channel IN (1, 3) AND sample BETWEEN 100 AND 299")
def load_samples(spark, sf):
    """A time range of two channels of a signal stored as blocks, scaled."""
    return R.samples(R.blocks(_signal(spark, sf), 64), [1, 3], 100, 300, 0.5)


@query(f"{_SIG}, g AS (SELECT CAST(unnest(range(0, (SELECT 2 * max(sample) + 1 FROM s))) AS BIGINT) AS k), p AS (SELECT channel, k, k / 2.0 AS u FROM g, (SELECT DISTINCT channel FROM s)) SELECT CAST(p.channel AS BIGINT) AS channel, p.k AS sample, round(a.value + (coalesce(b.value, a.value) - a.value) * (u - floor(u)), 6) AS value FROM p JOIN s a ON a.channel = p.channel AND a.sample = CAST(floor(u) AS BIGINT) LEFT JOIN s b ON b.channel = p.channel AND b.sample = CAST(floor(u) AS BIGINT) + 1")
def resample_linear(spark, sf):
    """Twice the rate by linear interpolation."""
    return R.resample(_signal(spark, sf), 1.0, 2.0).withColumn("value", F.round("value", 6))


@query(f"{_SIG} SELECT CAST(channel AS BIGINT) AS channel, CAST(sample AS BIGINT) AS sample, median(value) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM s")
def median_filter(spark, sf):
    return R.running_median(_signal(spark, sf), 2)


_SPAN = 30 * 86400.0


@query(f"""{_E}, d AS (SELECT user_id AS unit, t / 1e6 AS t, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) / 1e6 AS d FROM ev), b AS (SELECT unit, floor(t / 86400) AS b, count(*) AS n, count(*) FILTER (WHERE d IS NULL OR d > 600) AS k FROM d GROUP BY 1, 2), u AS (SELECT unit, sum(n) AS n, sum(k) AS kept, sum(n * n) AS q FROM b GROUP BY 1)
SELECT unit, CAST(n AS BIGINT) AS n, CAST(kept AS BIGINT) AS kept, round(n / {_SPAN}, 12) AS rate, round(sqrt((q - n * n / 30.0) / 29) / (n / 30.0), 9) AS cv FROM u""")
def unit_quality(spark, sf):
    """Rate, CV of daily counts and spikes kept after removing close ones."""
    s = events(spark, sf).select(F.col("user_id").alias("unit"), (F.col("t") / F.lit(1e6)).alias("t"))
    return R.units(s, _SPAN, 86400.0, 600.0).select("unit", "n", "kept", F.round("rate", 12).alias("rate"), F.round("cv", 9).alias("cv"))


@query("""WITH g AS (SELECT CAST(n_regionkey AS BIGINT) AS "group", CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY "group") - n AS first FROM g) SELECT c AS channel, "group", CAST(c - first AS BIGINT) AS place FROM r, (SELECT unnest(range(CAST(0 AS BIGINT), CAST(25 AS BIGINT))) AS c) WHERE c >= first AND c < first + n""")
def channel_location(spark, sf):
    """Group and place of global channel numbers, groups being regions of nations."""
    g = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("group")).agg(F.count(F.lit(1)).alias("n_channels"))
    return R.locate_channels(spark.range(25).withColumnRenamed("id", "channel"), g)


@query("SELECT n_nationkey, CASE regexp_replace(concat(CASE WHEN n_nationkey % 2 = 0 THEN 'l' ELSE 'r' END, upper(n_name[1]), lower(n_name[2:])), '^[lr]', '') WHEN 'France' THEN 'FR' WHEN 'Germany' THEN 'DE' ELSE concat(upper(n_name[1]), lower(n_name[2:])) END AS region FROM nation")
def region_names(spark, sf):
    n = table(spark, sf, "nation")
    side = F.when(F.col("n_nationkey") % 2 == 0, "l").otherwise("r")
    name = F.concat(side, F.upper(F.substring("n_name", 1, 1)), F.lower(F.substr("n_name", F.lit(2))))
    return R.rename_regions(n.select("n_nationkey", name.alias("region")), {"France": "FR", "Germany": "DE"})


@query(f"""{_E}, i AS (SELECT user_id AS trial, arg_max(value, t) AS value FROM ev GROUP BY 1), f AS (SELECT user_id AS trial, event_type AS name, min(t) AS t FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2), p AS (SELECT DISTINCT t AS pulse FROM ev WHERE event_type = 'error'),
m AS (SELECT f.trial, f.name, CASE WHEN p.pulse - f.t < {10 * MINUTE} THEN p.pulse ELSE f.t END AS t FROM f ASOF LEFT JOIN p ON f.t <= p.pulse)
SELECT i.trial, i.value, min(CASE WHEN name = 'click' THEN t END) AS t_click, min(CASE WHEN name = 'view' THEN t END) AS t_view FROM i LEFT JOIN m ON m.trial = i.trial GROUP BY 1, 2""")
def trial_table(spark, sf):
    """Trials by user: last value, first click and view, moved to the next error within ten minutes."""
    ev = events(spark, sf)
    log = ev.select(F.col("user_id").alias("trial"), F.col("event_type").alias("name"), "t")
    return R.trial_table(ev.select(F.col("user_id").alias("trial"), "t", "value"), log, ["click", "view"], ev.where("event_type = 'error'").select("t").distinct(), 10 * MINUTE)


_CAL = """WITH g AS (SELECT vec_id, vec_id % 5 AS dot, CAST(embedding[1] AS DOUBLE) AS gx, CAST(embedding[2] AS DOUBLE) AS gy FROM embeddings), m AS (SELECT dot, median(gx) AS gx, median(gy) AS gy, count(*) AS w FROM g GROUP BY 1)"""


@query(f"{_CAL} SELECT dot, round(gx, 9) AS gx, round(gy, 9) AS gy, CAST(w AS BIGINT) AS w FROM m")
def gaze_medians(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 5).alias("dot"), F.col("embedding")[0].cast("double").alias("gx"), F.col("embedding")[1].cast("double").alias("gy"))
    return e.groupBy("dot").agg(F.round(F.median("gx"), 9).alias("gx"), F.round(F.median("gy"), 9).alias("gy"), F.count(F.lit(1)).alias("w"))


_DOTS = [(0, 0.5, 0.5), (1, 0.1, 0.1), (2, 0.9, 0.1), (3, 0.1, 0.9), (4, 0.9, 0.9)]
_VALUES = ", ".join(map(str, _DOTS))
_DET = "(w * (xx * yy - xy * xy) - sx * (sx * yy - xy * sy) + sy * (sx * xy - xx * sy))"


def _solved(c: str) -> str:
    a = f"(z{c} * (xx * yy - xy * xy) - sx * (x{c} * yy - xy * y{c}) + sy * (x{c} * xy - xx * y{c})) / {_DET} AS {c}0"
    b = f"(w * (x{c} * yy - xy * y{c}) - z{c} * (sx * yy - xy * sy) + sy * (sx * y{c} - x{c} * sy)) / {_DET} AS {c}1"
    d = f"(w * (xx * y{c} - x{c} * xy) - sx * (sx * y{c} - x{c} * sy) + z{c} * (sx * xy - xx * sy)) / {_DET} AS {c}2"
    return f"{a}, {b}, {d}"


@query(f"""WITH g AS (SELECT vec_id, vec_id % 5 AS dot, CAST(embedding[1] AS DOUBLE) AS gx, CAST(embedding[2] AS DOUBLE) AS gy FROM embeddings), m AS (SELECT dot, median(gx) AS gx, median(gy) AS gy, count(*) AS w FROM g GROUP BY 1),
d AS (SELECT * FROM (VALUES {_VALUES}) v(dot, p, q)), s AS (SELECT sum(w) AS w, sum(w * gx) AS sx, sum(w * gy) AS sy, sum(w * gx * gx) AS xx, sum(w * gx * gy) AS xy, sum(w * gy * gy) AS yy, sum(w * p) AS zp, sum(w * gx * p) AS xp, sum(w * gy * p) AS yp, sum(w * q) AS zq, sum(w * gx * q) AS xq, sum(w * gy * q) AS yq FROM m JOIN d USING (dot)),
k AS (SELECT {_solved("p")}, {_solved("q")} FROM s) SELECT vec_id, dot, round(gx, 9) AS gx, round(gy, 9) AS gy, round(p0 + p1 * gx + p2 * gy, 6) AS x, round(q0 + q1 * gx + q2 * gy, 6) AS y FROM g, k""")
def gaze_calibration(spark, sf):
    """Gaze mapped to the screen by a weighted plane through five dots."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("dot"), F.col("embedding")[0].cast("double").alias("gx"), F.col("embedding")[1].cast("double").alias("gy"))
    out = R.calibrate(e, spark.createDataFrame(_DOTS, "dot long, x double, y double"))
    return out.select("vec_id", "dot", *[F.round(k, n).alias(k) for k, n in (("gx", 9), ("gy", 9), ("x", 6), ("y", 6))])


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:3] AS g FROM embeddings), t AS (SELECT * FROM (VALUES ('x', [1.0, 0.0, 0.0]), ('y', [0.0, 1.0, 0.0]), ('z', [0.0, 0.0, 1.0])) v(name, t)),
a AS (SELECT vec_id, name, degrees(acos(greatest(least(list_inner_product(g, t::DOUBLE[]) / sqrt(list_inner_product(g, g)), 1.0), -1.0))) AS angle FROM e, t) SELECT vec_id, CASE WHEN min(angle) <= 60 THEN arg_min(name, angle) END AS name, round(min(angle), 4) AS angle FROM a GROUP BY 1""")
def nearest_target(spark, sf):
    """Axis of the smallest angle to each vector's first three components."""
    e = table(spark, sf, "embeddings").select("vec_id", F.lit(1).alias("frame"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("gaze"))
    t = spark.createDataFrame([(1, "x", [1.0, 0.0, 0.0]), (1, "y", [0.0, 1.0, 0.0]), (1, "z", [0.0, 0.0, 1.0])], "frame int, name string, target array<double>")
    return R.nearest_target(e, F.broadcast(t), ["frame"], 60.0).select("vec_id", "name", F.round("angle", 4).alias("angle"))  # three rows


@query()
def discriminant_subspace(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("half"), "label", "embedding")
    return R.discriminant_subspace(e, ["half"], "label", "embedding", 3)


@query(f"""{_E}, g AS (SELECT CAST(unnest(range(0, 43200)) AS BIGINT) * {MINUTE} AS t), p AS (SELECT t AS e FROM ev WHERE event_type = 'purchase'), n AS (SELECT g.t, min(abs(g.t - e)) AS gap FROM g JOIN p ON g.t >= e - {10 * MINUTE} AND g.t <= e + {10 * MINUTE} GROUP BY 1)
SELECT CAST(count(*) FILTER (WHERE gap <= {MINUTE}) AS BIGINT) AS positives, CAST((SELECT count(*) FROM g) - count(*) AS BIGINT) AS far FROM n""")
def event_detector_samples(spark, sf):
    """Minutes near a purchase, and those outside the exclusion, all of which count with share 1."""
    g = spark.range(43200).select((F.col("id") * F.lit(MINUTE)).alias("t"))
    rows = R.event_samples(g, events(spark, sf).where("event_type = 'purchase'").select("t"), MINUTE, 10 * MINUTE, 1.0, 5, HOUR)
    return rows.agg(F.sum((F.col("y") == 1).cast("long")).alias("positives"), F.sum((F.col("y") == 0).cast("long")).alias("far"))


# sorts and sets


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def sort_permutation(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey AS key, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def concat_arrays(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_custkey").alias("key"), F.lit("c").alias("kind")).union(s.select("s_suppkey", F.lit("s")))


@query("SELECT DISTINCT p_brand, p_type FROM part INTERSECT SELECT p_brand, p_type FROM part WHERE p_size > 25")
def set_intersection(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_brand", "p_type").intersect(p.where("p_size > 25").select("p_brand", "p_type"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem")
def array_sizes(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query(f"{_E}, p AS (SELECT *, user_id % 5 AS part FROM ev), m AS (SELECT part, avg(value) AS m FROM p GROUP BY 1) SELECT a.part, round(a.m - b.m, 9) AS step FROM m a JOIN m b ON b.part = (a.part + 1) % 5")
def neighbour_partitions(spark, sf):
    """Each partition against the next, the last against the first."""
    m = events(spark, sf).groupBy((F.col("user_id") % 5).alias("part")).agg(F.avg("value").alias("m"))
    return m.join(m.select(((F.col("part") + 4) % 5).alias("part"), F.col("m").alias("n")), "part").select("part", F.round(F.col("m") - F.col("n"), 9).alias("step"))
