"""Queries of grouped statistics, tuning and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.timing import HOUR
from eventloom.operators import stats
from eventloom.plans.interval_queries import EV
from eventloom.plans.registry import query
from eventloom.sources.tables import events, table

V = """WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim FROM embeddings)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double")).withColumn("dim", F.col("dim").cast("long"))


_M = "m AS (SELECT dim, label, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM v GROUP BY 1, 2)"


@query(f"{V}, {_M} SELECT p.dim, p.label AS a, q.label AS b, round((q.mean - p.mean) / sqrt(((p.n - 1) * p.sd * p.sd + (q.n - 1) * q.sd * q.sd) / (p.n + q.n - 2)), 6) AS d FROM m p JOIN m q ON p.dim = q.dim AND p.label <> q.label")
def cohens_d(spark, sf):
    return stats.cohens_d(vectors(spark, sf), "label", ["dim"], "x").select("dim", "a", "b", F.round("d", 6).alias("d"))


@query(f"{V} SELECT dim, label, CAST(count(*) AS BIGINT) AS n, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS BIGINT) AS df FROM v GROUP BY 1, 2")
def ttest_t(spark, sf):
    return stats.t_test(vectors(spark, sf), ["dim", "label"], "x").select("dim", "label", "n", F.round("t", 6).alias("t"), "df")


@query(f"""{V}, g AS (SELECT dim, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM v GROUP BY 1, 2), o AS (SELECT dim, avg(x) AS m FROM v GROUP BY 1)
SELECT dim, round((sum(n * (g.m - o.m) * (g.m - o.m)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS f, CAST(count(*) - 1 AS BIGINT) AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g JOIN o USING (dim) GROUP BY dim""")
def anova_f(spark, sf):
    return stats.anova(vectors(spark, sf), "label", ["dim"], "x").select("dim", F.round("f", 6).alias("f"), "df1", "df2")


@query(f"""{V}, g AS (SELECT dim, label, count(*) AS n, avg(x) AS m FROM v GROUP BY 1, 2), o AS (SELECT dim, avg(x) AS m, var_pop(x) * count(*) AS t FROM v GROUP BY 1)
SELECT round((SELECT sum(n * (g.m - o.m) * (g.m - o.m)) FROM g JOIN o USING (dim)) / (SELECT sum(t) FROM o), 9) AS share""")
def var_explained_trace(spark, sf):
    return stats.var_explained(vectors(spark, sf), "label", "dim", "x").select(F.round("share", 9).alias("share"))


_SIM = """SELECT p.label AS a, q.label AS b, round(avg(r), 6) AS r FROM (SELECT p.vec_id AS i, q.vec_id AS j, corr(p.x, q.x) AS r FROM v p JOIN v q ON p.dim = q.dim GROUP BY 1, 2) JOIN (SELECT DISTINCT vec_id, label FROM v) p ON p.vec_id = i JOIN (SELECT DISTINCT vec_id, label FROM v) q ON q.vec_id = j GROUP BY 1, 2"""


@query(f"{V} {_SIM}")
def similarity_pearson(spark, sf):
    return stats.class_similarity(vectors(spark, sf), "vec_id", "label", "dim", "x").select("a", "b", F.round("r", 6).alias("r"))


@query(V.replace("v AS", "v0 AS") + ", v AS (SELECT vec_id, label, dim, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2.0 AS x FROM v0) " + _SIM)
def similarity_spearman(spark, sf):
    return stats.class_similarity(stats.ranked(vectors(spark, sf), "vec_id", "x"), "vec_id", "label", "dim", "x").select("a", "b", F.round("r", 6).alias("r"))


@query("""WITH c AS (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2), g AS (SELECT avg(m) AS m FROM c), a AS (SELECT f, avg(m) AS m FROM c GROUP BY 1), b AS (SELECT s, avg(m) AS m FROM c GROUP BY 1)
SELECT NULL::VARCHAR AS l_returnflag, NULL::VARCHAR AS l_linestatus, round(m, 6) AS effect FROM g UNION ALL SELECT f, NULL, round(a.m - g.m, 6) FROM a, g UNION ALL SELECT NULL, s, round(b.m - g.m, 6) FROM b, g
UNION ALL SELECT c.f, c.s, round(c.m - a.m - b.m + g.m, 6) FROM c JOIN a USING (f) JOIN b USING (s), g""")
def marginal_cube(spark, sf):
    return stats.marginals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("effect", F.round("effect", 6))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_MAP = f"""WITH e AS (SELECT user_id % 4 AS region, CAST(floor(value / 20) AS BIGINT) AS bx, {_K} // 20 AS "by", CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS r FROM events),
k AS (SELECT * FROM e WHERE bx BETWEEN 0 AND 4 AND "by" BETWEEN 0 AND 4), n AS (SELECT region, bx, "by", count(*) AS n, avg(r) AS mean FROM k GROUP BY 1, 2, 3), t AS (SELECT region, sum(n) AS t FROM n GROUP BY 1),
map AS (SELECT t.region, x.bx, y.by, n.mean, coalesce(n.n, 0) / t.t AS occupancy FROM t, (SELECT unnest(range(CAST(0 AS BIGINT), CAST(5 AS BIGINT))) AS bx) x, (SELECT unnest(range(CAST(0 AS BIGINT), CAST(5 AS BIGINT))) AS "by") y LEFT JOIN n ON n.region = t.region AND n.bx = x.bx AND n.by = y.by)"""


def _map(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("region"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    return stats.tuning(e, F.floor(F.col("value") / 20), F.floor(F.col("k") / 20), 5, 5, ["region"], F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))


@query(f'{_MAP} SELECT region, bx, "by", round(mean, 9) AS mean, round(occupancy, 9) AS occupancy FROM map')
def tuning_2d(spark, sf):
    return _map(spark, sf).select("region", "bx", "by", F.round("mean", 9).alias("mean"), F.round("occupancy", 9).alias("occupancy"))


@query(f"""{_MAP}, p AS (SELECT *, mean / sum(mean) OVER (PARTITION BY region) AS p FROM map), q AS (SELECT *, sum(p * occupancy) OVER (PARTITION BY region) AS r FROM p)
SELECT region, round(coalesce(sum(CASE WHEN p > 0 THEN p * occupancy * log2(p / r) END), 0), 9) AS bits FROM q GROUP BY region""")
def mutual_information(spark, sf):
    return stats.mutual_information(_map(spark, sf), ["region"]).select("region", F.round("bits", 9).alias("bits"))


_DEC = f"""WITH {EV}, h AS (SELECT t // {HOUR} AS sample, CAST(least(floor(avg(value) / 10), 9) AS BIGINT) AS bin FROM ev GROUP BY 1),
u AS (SELECT unnest(range(CAST(0 AS BIGINT), CAST(4 AS BIGINT))) AS unit), c AS (SELECT h.sample, u.unit, CAST(count(e.t) AS BIGINT) AS r FROM h CROSS JOIN u LEFT JOIN ev e ON e.t // {HOUR} = h.sample AND e.user_id % 4 = u.unit GROUP BY 1, 2),
l AS (SELECT unit, bin, avg(r) + 0.01 AS l FROM c JOIN h USING (sample) GROUP BY 1, 2), o AS (SELECT bin, count(*) / (SELECT count(*) FROM h) AS occ FROM h GROUP BY 1),
s AS (SELECT c.sample, l.bin, round(sum(r * ln(l) - l) + any_value(ln(occ)), 9) AS s FROM c JOIN l USING (unit) JOIN o ON o.bin = l.bin GROUP BY 1, 2),
d AS (SELECT sample, arg_max(bin, ROW(s, -bin)) AS guess FROM s GROUP BY 1)"""


def _decoded(spark, sf):
    ev = events(spark, sf).withColumn("sample", F.expr(f"t div {HOUR}L"))
    h = ev.groupBy("sample").agg(F.least(F.floor(F.avg("value") / 10), F.lit(9)).cast("long").alias("bin"))
    got = ev.groupBy("sample", (F.col("user_id") % 4).alias("unit")).agg(F.count(F.lit(1)).alias("r"))
    cells = h.select("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("unit"))
    counts = cells.join(got, ["sample", "unit"], "left").withColumn("r", F.coalesce("r", F.lit(0).cast("long")))
    rates = counts.join(h, "sample").groupBy("unit", "bin").agg((F.avg("r") + F.lit(0.01)).alias("l"))
    n = h.agg(F.count(F.lit(1)).alias("n"))
    occ = h.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).select("bin", (F.col("k") / F.col("n")).alias("occ"))  # one row
    return stats.bayes_decode(counts, rates, occ).withColumnRenamed("bin", "guess").join(h, "sample")


@query(f"{_DEC} SELECT sample, h.bin, d.guess FROM d JOIN h USING (sample)")
def bayes_decode(spark, sf):
    return _decoded(spark, sf).select("sample", "bin", "guess")


@query(f"{_DEC} SELECT round(avg(abs(guess - bin)), 9) AS mean_error, round(stddev_samp(abs(guess - bin)), 9) AS sd_error FROM d JOIN h USING (sample)")
def decode_accuracy(spark, sf):
    e = F.abs(F.col("guess") - F.col("bin"))
    return _decoded(spark, sf).agg(F.round(F.avg(e), 9).alias("mean_error"), F.round(F.stddev_samp(e), 9).alias("sd_error"))


_NM = f"""{V}, w AS (SELECT *, vec_id % 5 AS fold FROM v), p AS (SELECT fold, label, dim, sum(x) AS s, count(*) AS n FROM w GROUP BY ALL), e AS (SELECT label, dim, sum(s) AS s, sum(n) AS n FROM p GROUP BY ALL),
m AS (SELECT f.fold, e.label AS guess, e.dim, (e.s - coalesce(p.s, 0)) / nullif(e.n - coalesce(p.n, 0), 0) AS m FROM e CROSS JOIN (SELECT DISTINCT fold FROM w) f LEFT JOIN p ON p.fold = f.fold AND p.label = e.label AND p.dim = e.dim),
d AS (SELECT vec_id, w.label, guess, round(sum((x - m) * (x - m)), 9) AS d FROM w JOIN m ON w.fold = m.fold AND w.dim = m.dim GROUP BY ALL),
c AS (SELECT vec_id, label, arg_min(guess, ROW(d, guess)) AS guess FROM d GROUP BY 1, 2)"""


def _guessed(spark, sf):
    return stats.nearest_mean(vectors(spark, sf).withColumn("fold", F.col("vec_id") % 5), "vec_id", "label", "fold", 5, "dim", "x")


@query(f"{_NM} SELECT vec_id, label, guess FROM c")
def decoder_mean(spark, sf):
    return _guessed(spark, sf)


@query(f"{_NM}, n AS (SELECT label, guess, count(*) AS n FROM c GROUP BY 1, 2) SELECT label, guess, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY label), 9) AS share FROM n")
def confusion_matrix(spark, sf):
    return stats.confusion(_guessed(spark, sf), "label").select("label", "guess", "n", F.round("share", 9).alias("share"))


@query(f"{_NM} SELECT round(avg(a), 9) AS accuracy, CAST(count(*) AS BIGINT) AS classes FROM (SELECT label, avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END) AS a FROM c GROUP BY 1)")
def balanced_accuracy(spark, sf):
    return stats.balanced_accuracy(_guessed(spark, sf), "label").select(F.round("accuracy", 9).alias("accuracy"), "classes")


@query("SELECT round(max(n) / sum(n), 9) AS chance FROM (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1)")
def chance_level(spark, sf):
    return stats.chance(table(spark, sf, "embeddings"), "label").select(F.round("chance", 9).alias("chance"))


_BAL = "WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(toxic AS BIGINT) AS toxic, CAST((SELECT {f}(n) FROM n) AS BIGINT) AS n FROM n"


@query(_BAL.format(f="min"))
def balance_min(spark, sf):
    return stats.balance(table(spark, sf, "labels"), "toxic", "doc_id").groupBy(F.col("toxic").cast("long").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


@query(_BAL.format(f="max"))
def balance_max(spark, sf):
    return stats.balance(table(spark, sf, "labels"), "toxic", "doc_id", "max").groupBy(F.col("toxic").cast("long").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS total, max(l_quantity) AS hi, min(l_quantity) AS lo, round(avg(l_quantity), 9) AS mean, median(l_quantity) AS mid FROM lineitem GROUP BY 1, 2""")
def array_reductions(spark, sf):
    q = "l_quantity"
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(q), 2).alias("total"), F.max(q).alias("hi"), F.min(q).alias("lo"), F.round(F.avg(q), 9).alias("mean"), F.median(q).alias("mid"))
