"""Queries of the linear-algebra models where two dimensions, units or levels have a closed form that SQL can state.

They run the very operators that the queries of ``model_queries`` run on all dimensions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from eventloom.functions import numeric
from eventloom.functions.timing import HOUR
from eventloom.operators import models, stats, sync
from eventloom.operators import recording as R
from eventloom.plans.interval_queries import EV
from eventloom.plans.model_queries import _hourly
from eventloom.plans.registry import query
from eventloom.sources.tables import events, spikes, table, triggers

_XY = "WITH p AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def _plane(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 5).alias("fold"), (F.col("vec_id") % 2).alias("half"))


# principal components and subspaces

_EIGEN = f"""{_XY}, c AS (SELECT var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b, avg(x) AS mx, avg(y) AS my FROM p), r AS (SELECT *, sqrt((a - d) * (a - d) / 4 + b * b) AS h FROM c),
l AS (SELECT 0 AS component, (a + d) / 2 + h AS latent, b AS vx, (d - a) / 2 + h AS vy, a + d AS total, mx, my FROM r UNION ALL SELECT 1, (a + d) / 2 - h, b, (d - a) / 2 - h, a + d, mx, my FROM r),
u AS (SELECT *, sqrt(vx * vx + vy * vy) * sign(CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) AS s FROM l)"""


@query(f"{_EIGEN} SELECT CAST(component AS BIGINT) AS component, round(latent, 9) AS latent, round(100 * latent / total, 6) AS explained, round(vx / s, 6) AS cx, round(vy / s, 6) AS cy FROM u")
def pca_plane(spark, sf):
    """Latent roots, explained percent and coefficients of two components."""
    m = models.pca(_plane(spark, sf), "v")
    rows = [(k, round(float(m["latent"][k]), 9), round(float(m["explained"][k]), 6), *(round(float(c), 6) for c in m["coeff"][:, k])) for k in range(2)]
    return spark.createDataFrame(rows, "component long, latent double, explained double, cx double, cy double")


@query(f"{_EIGEN} SELECT vec_id, CAST(component AS BIGINT) AS component, round(((x - mx) * vx + (y - my) * vy) / s, 6) AS score FROM p, u")
def pca_scores(spark, sf):
    """Coordinates of vectors in their principal axes."""
    rows = _plane(spark, sf)
    m = models.pca(rows, "v")
    return models.project(rows, "v", m["coeff"], m["mu"]).select("vec_id", F.posexplode("score").alias("component", "score")).select("vec_id", F.col("component").cast("long").alias("component"), F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id % 2 AS half, CAST(label AS BIGINT) AS label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT half, label, dim, avg(x) AS m FROM v GROUP BY ALL), d AS (SELECT p.half, p.label AS a, q.label AS b, p.dim, (p.m - q.m) / 2 AS d, (p.m + q.m) / 2 AS c FROM m p JOIN m q ON p.half = q.half AND p.dim = q.dim AND p.label < q.label),
s AS (SELECT x.a, x.b, sum(x.d * y.d) AS xy, sum(x.d * x.d) AS xx, sum(y.d * y.d) AS yy, sum((y.c - x.c) * x.d) AS cx, sum((y.c - x.c) * (y.c - x.c)) AS cc, sum((y.c - x.c) * y.d) AS cy, count(*) AS k FROM d x JOIN d y ON x.half = 0 AND y.half = 1 AND x.a = y.a AND x.b = y.b AND x.dim = y.dim GROUP BY ALL)
SELECT a, b, round(xy * xy / (xx * yy), 6) AS similarity, round(degrees(acos(least(abs(xy) / sqrt(xx * yy), 1.0))), 4) AS angle, round((((cx + xy) * (cx + xy) + (cx - xy) * (cx - xy)) / xx / (2 * cc + 2 * yy) - 1.0 / k) / (1 - 1.0 / k), 6) AS share FROM s""")
def class_axes(spark, sf):
    """Axis between two classes' means in one half of the vectors against the other half's: similarity, angle and share of variance held."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    first, second = (models.class_means(e.where(F.col("vec_id") % 2 == k), "label", "embedding") for k in (0, 1))
    rows = []
    for a, b in combinations(first.index, 2):  # classes are few
        (x, origin), (y, _) = models.class_subspace(first.loc[[a, b]]), models.class_subspace(second.loc[[a, b]])
        x, y = x[:, :1], y[:, :1]
        rows.append((int(a), int(b), round(models.similarity(x, y), 6), round(float(numeric.principal_angles(x, y).mean()), 4), round(models.share_in_subspace(second.loc[[a, b]].to_numpy(), x, origin), 6)))
    return spark.createDataFrame(rows, "a long, b long, similarity double, angle double, share double")


@query(f"""{_XY}, m AS (SELECT label, avg(x) FILTER (WHERE vec_id % 2 = 0) AS ax, avg(y) FILTER (WHERE vec_id % 2 = 0) AS ay, avg(x) FILTER (WHERE vec_id % 2 = 1) AS bx, avg(y) FILTER (WHERE vec_id % 2 = 1) AS "by" FROM p GROUP BY 1),
s AS (SELECT i.label, c.ax, c.ay, c.bx, c."by" FROM (SELECT label FROM m UNION ALL SELECT -1) i JOIN m c ON c.label <> i.label),
g AS (SELECT label, avg(ax) AS max_, avg(ay) AS may_, avg(bx) AS mbx, avg("by") AS mby, count(*) * covar_pop(ax, bx) AS m11, count(*) * covar_pop(ax, "by") AS m12, count(*) * covar_pop(ay, bx) AS m21, count(*) * covar_pop(ay, "by") AS m22, count(*) * (var_pop(ax) + var_pop(ay)) AS q FROM s GROUP BY 1),
n AS (SELECT *, sign(m11 * m22 - m12 * m21) AS f, sqrt(m11 * m11 + m12 * m12 + m21 * m21 + m22 * m22 + 2 * abs(m11 * m22 - m12 * m21)) AS nuc FROM g),
r AS (SELECT *, (m11 + f * m22) / nuc AS r11, (m12 - f * m21) / nuc AS r12, (m21 - f * m12) / nuc AS r21, (m22 + f * m11) / nuc AS r22, nuc / q AS scale FROM n),
e AS (SELECT power(scale * ((ax - max_) * r11 + (ay - may_) * r21) + mbx - bx, 2) + power(scale * ((ax - max_) * r12 + (ay - may_) * r22) + mby - "by", 2) AS err, power(bx - mbx, 2) + power("by" - mby, 2) AS tot FROM r JOIN m USING (label))
SELECT round(1 - sum(err) / sum(tot), 6) AS r2, round((SELECT scale FROM r WHERE label = -1), 6) AS scale FROM e""")
def procrustes_plane(spark, sf):
    """Alignment of two halves' class means in the plane, each class left out in turn."""
    rows = _plane(spark, sf)
    a, b = (models.class_means(rows.where(F.col("half") == k), "label", "v").to_numpy() for k in (0, 1))
    r = models.procrustes(a, b)
    return spark.createDataFrame([(round(r["r2"], 6), round(r["scale"], 6))], "r2 double, scale double")


# decoders


@query(f"""{_XY}, w AS (SELECT *, vec_id % 5 AS fold FROM p), f AS (SELECT DISTINCT fold AS k FROM w), m AS (SELECT k, label, avg(x) AS mx, avg(y) AS my FROM f JOIN w ON fold <> k GROUP BY 1, 2),
c AS (SELECT k, covar_samp(x - mx, x - mx) AS a, covar_samp(x - mx, y - my) AS b, covar_samp(y - my, y - my) AS d FROM f JOIN w ON fold <> k JOIN m USING (k, label) GROUP BY 1),
v AS (SELECT k, a + 0.1 * (a + d) / 2 AS a, b, d + 0.1 * (a + d) / 2 AS d FROM c),
q AS (SELECT vec_id, w.label, m.label AS guess, round((d * power(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * power(y - my, 2)) / (a * d - b * b), 9) AS z FROM w JOIN v ON v.k = fold JOIN m ON m.k = fold)
SELECT vec_id, label, arg_min(guess, ROW(z, guess)) AS guess FROM q GROUP BY 1, 2""")
def decoder_whitened_plane(spark, sf):
    """Class of the nearest mean under the pooled covariance, without each vector's own fold."""
    return models.whitened_decoder(_plane(spark, sf), "vec_id", "label", "fold", "v", ridge=0.1)


@query(f"""{_XY}, h AS (SELECT *, vec_id % 2 AS half FROM p), g AS (SELECT half, avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM h GROUP BY 1), m AS (SELECT half, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS xx, count(*) * covar_pop(x, y) AS xy, count(*) * var_pop(y) AS yy FROM h GROUP BY 1, 2),
s AS (SELECT half, sum(m.n * power(mx - gx, 2)) AS b11, sum(m.n * (mx - gx) * (my - gy)) AS b12, sum(m.n * power(my - gy, 2)) AS b22, sum(xx) AS a, sum(xy) AS b, sum(yy) AS d FROM m JOIN g USING (half) GROUP BY 1),
w AS (SELECT half, b11, b12, b22, a + 0.001 * (a + d) / 2 AS a, b, d + 0.001 * (a + d) / 2 AS d FROM s),
k AS (SELECT half, (d * b11 - b * b12) / (a * d - b * b) AS k11, (d * b12 - b * b22) / (a * d - b * b) AS k12, (a * b12 - b * b11) / (a * d - b * b) AS k21, (a * b22 - b * b12) / (a * d - b * b) AS k22 FROM w),
l AS (SELECT half, k12 AS vx, (k22 - k11) / 2 + sqrt(power(k11 - k22, 2) / 4 + k12 * k21) AS vy FROM k), u AS (SELECT *, sqrt(vx * vx + vy * vy) * sign(CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) AS s FROM l)
SELECT half, round(vx / s, 6) AS wx, round(vy / s, 6) AS wy FROM u""")
def discriminant_plane(spark, sf):
    """Axis of greatest between-class against within-class variance in the plane, for each half."""
    out = R.discriminant_subspace(_plane(spark, sf), ["half"], "label", "v", 1)
    return out.select("half", F.round(F.col("weights")[0], 6).alias("wx"), F.round(F.col("weights")[1], 6).alias("wy"))


# generalised linear models

_HOURS = f"""WITH {EV}, b AS (SELECT max(t) // {HOUR} AS last FROM ev), n AS (SELECT user_id % 8 AS cell, t // {HOUR} AS bin, count(*) AS n FROM ev GROUP BY 1, 2),
h AS (SELECT c.cell, g.bin, coalesce(n.n, 0) AS y, CASE WHEN g.bin % 24 < 6 THEN 1 ELSE 0 END AS x FROM (SELECT DISTINCT cell FROM n) c CROSS JOIN (SELECT unnest(range(0, (SELECT last + 1 FROM b))) AS bin) g LEFT JOIN n ON n.cell = c.cell AND n.bin = g.bin)"""
_DEVIANCE = "2 * sum(CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m))"


@query(f"{_HOURS}, m AS (SELECT x, avg(y) AS m FROM h GROUP BY 1), d AS (SELECT {_DEVIANCE} AS d FROM h JOIN m USING (x)), r AS (SELECT ln(max(m) FILTER (WHERE x = 0)) AS i, ln(max(m) FILTER (WHERE x = 1)) - ln(max(m) FILTER (WHERE x = 0)) AS n FROM m) SELECT 'deviance' AS term, round(d, 2) AS value FROM d UNION ALL SELECT 'intercept', round(i, 4) FROM r UNION ALL SELECT 'night', round(n, 4) FROM r")
def glm_two_rates(spark, sf):
    """A Poisson model of night against day, whose fit is the two means."""
    m = models.glm_poisson(_hourly(spark, sf), ["night"], "n")
    return spark.createDataFrame([(k, round(v, 2 if k == "deviance" else 4)) for k, v in sorted(m.items())], "term string, value double")


@query(f"{_HOURS}, m AS (SELECT cell, x, avg(y) AS m FROM h GROUP BY 1, 2), r AS (SELECT cell, ln(max(m) FILTER (WHERE x = 0)) AS i, ln(max(m) FILTER (WHERE x = 1)) - ln(max(m) FILTER (WHERE x = 0)) AS n FROM m GROUP BY 1), d AS (SELECT cell, {_DEVIANCE} AS d FROM h JOIN m USING (cell, x) GROUP BY 1) SELECT cell, round(n, 5) AS night, round(i, 5) AS intercept, round(d, 3) AS deviance FROM r JOIN d USING (cell)")
def glm_two_rates_by_unit(spark, sf):
    """The same for each unit, without a penalty."""
    m = models.lasso_glm(_hourly(spark, sf), "cell", ["night"], "n", "poisson", 0.0)
    return m.select("cell", F.round(F.col("coefficients")[0], 5).alias("night"), F.round("intercept", 5).alias("intercept"), F.round("deviance", 3).alias("deviance"))


@query(f"{_HOURS}, s AS (SELECT cell, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) AS c, var_pop(x) AS v FROM h GROUP BY 1), k AS (SELECT *, sign(c) * greatest(abs(c) - 0.005, 0) / v AS k FROM s) SELECT cell, round(k, 6) + 0.0 AS night, round(my - k * mx, 6) AS intercept FROM k")
def lasso_line(spark, sf):
    """A penalised line for each unit: the soft threshold of the covariance."""
    m = models.lasso_glm(_hourly(spark, sf), "cell", ["night"], "n", "gaussian", 0.005)
    return m.select("cell", (F.round(F.col("coefficients")[0], 6) + F.lit(0.0)).alias("night"), F.round("intercept", 6).alias("intercept"))


# state space


@query(f"""{_HOURS.replace("WITH", "WITH RECURSIVE", 1)}, f AS (SELECT cell, CAST(0 AS BIGINT) AS bin, 0.5 * exp(y * ln(0.5) - 0.5) AS lo, 0.5 * exp(y * ln(3.0) - 3.0) AS hi FROM h WHERE bin = 0
UNION ALL SELECT f.cell, h.bin, (0.9 * lo + 0.1 * hi) / (lo + hi) * exp(y * ln(0.5) - 0.5), (0.1 * lo + 0.9 * hi) / (lo + hi) * exp(y * ln(3.0) - 3.0) FROM f JOIN h ON h.cell = f.cell AND h.bin = f.bin + 1)
SELECT cell, bin, round(hi / (lo + hi), 6) AS p_high FROM f""")
def hmm_forward(spark, sf):
    """Probability of the higher of two states of given rates, filtered forward."""
    return models.hmm_given(_hourly(spark, sf), "cell", "bin", "n", [0.5, 3.0], 0.9).select("cell", "bin", F.round("p_high", 6).alias("p_high"))


@query(f"""WITH {EV}, r AS (SELECT s.user_id % 4 AS cell, s.t - e.t AS rel FROM ev e JOIN ev s ON e.event_type = 'purchase' AND s.t >= e.t AND s.t < e.t + {HOUR}),
d AS (SELECT cell, rel, row_number() OVER (PARTITION BY cell ORDER BY rel) / count(*) OVER (PARTITION BY cell) - rel / {float(HOUR)} AS d FROM r), c AS (SELECT cell, rel, abs(d - avg(d) OVER (PARTITION BY cell)) AS d FROM d)
SELECT cell, round(max(d), 9) AS zeta, round(arg_max(rel, ROW(round(d, 12), -rel)) / 1e6, 6) AS latency FROM c GROUP BY 1""")
def zeta_deviation(spark, sf):
    """Greatest deviation of spike times after purchases from an even spread, and where it lies."""
    s = spikes(spark, sf).select((F.col("neuron") % 4).alias("cell"), "t")
    return models.zeta_test(s, triggers(spark, sf), "cell", HOUR, resamples=2).select("cell", F.round("zeta", 9).alias("zeta"), F.round("latency", 6).alias("latency"))


# demixing

_CELLS = """WITH g AS (SELECT l_suppkey % 2 AS unit, l_returnflag AS a, l_linestatus AS b, avg(l_quantity) AS m, var_samp(l_quantity) / count(*) AS e FROM lineitem GROUP BY 1, 2, 3),
x AS (SELECT *, m - avg(m) OVER (PARTITION BY unit) AS x FROM g), y AS (SELECT *, avg(x) OVER (PARTITION BY unit, a) AS xa, avg(x) OVER (PARTITION BY unit, b) AS xb FROM x),
c AS (SELECT p.a, p.b, p.x AS x0, q.x AS x1, p.xa AS a0, q.xa AS a1, p.xb AS b0, q.xb AS b1, p.x - p.xa - p.xb AS i0, q.x - q.xa - q.xb AS i1 FROM y p JOIN y q ON p.unit = 0 AND q.unit = 1 AND p.a = q.a AND p.b = q.b),
t AS (SELECT sum(x0 * x0 + x1 * x1) AS t, sum(x0 * x0) AS s00, sum(x0 * x1) AS s01, sum(x1 * x1) AS s11 FROM c), z AS (SELECT avg(e) FILTER (WHERE unit = 0) AS e0, avg(e) FILTER (WHERE unit = 1) AS e1 FROM g),
v AS (SELECT t, s00 + e0 + t * 1e-6 AS p, s01 AS q, s11 + e1 + t * 1e-6 AS r FROM t, z),
k AS (SELECT 'l_returnflag' AS marginal, sum(a0 * x0) AS h00, sum(a0 * x1) AS h01, sum(a1 * x0) AS h10, sum(a1 * x1) AS h11 FROM c UNION ALL SELECT 'l_linestatus', sum(b0 * x0), sum(b0 * x1), sum(b1 * x0), sum(b1 * x1) FROM c UNION ALL SELECT 'l_returnflag*l_linestatus', sum(i0 * x0), sum(i0 * x1), sum(i1 * x0), sum(i1 * x1) FROM c),
d AS (SELECT marginal, t, (h00 * r - h01 * q) / (p * r - q * q) AS c00, (h01 * p - h00 * q) / (p * r - q * q) AS c01, (h10 * r - h11 * q) / (p * r - q * q) AS c10, (h11 * p - h10 * q) / (p * r - q * q) AS c11 FROM k, v),
f AS (SELECT d.marginal, d.t, c00, c01, c10, c11, sum(power(c00 * x0 + c01 * x1, 2)) AS g00, sum((c00 * x0 + c01 * x1) * (c10 * x0 + c11 * x1)) AS g01, sum(power(c10 * x0 + c11 * x1, 2)) AS g11 FROM d, c GROUP BY ALL),
u AS (SELECT *, g01 AS v0, (g11 - g00) / 2 + sqrt(power(g00 - g11, 2) / 4 + g01 * g01) AS v1 FROM f), w AS (SELECT *, v0 / sqrt(v0 * v0 + v1 * v1) AS u0, v1 / sqrt(v0 * v0 + v1 * v1) AS u1 FROM u),
s AS (SELECT marginal, t, u0, u1, u0 * c00 + u1 * c10 AS w0, u0 * c01 + u1 * c11 AS w1 FROM w)"""


@query(f"{_CELLS} SELECT marginal, CAST(0 AS BIGINT) AS component, round(100 - 100 * sum(power(x0 - u0 * (w0 * x0 + w1 * x1), 2) + power(x1 - u1 * (w0 * x0 + w1 * x1), 2)) / t, 5) AS explained FROM s, c GROUP BY marginal, t")
def dpca_two_units(spark, sf):
    """First demixed component of each marginal of two units' cell means."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 2).alias("unit"), "l_returnflag", "l_linestatus", "l_quantity")
    return models.demixed(li, "unit", ("l_returnflag", "l_linestatus"), "l_quantity", 1, 1e-3).select("marginal", "component", F.round("explained", 5).alias("explained"))


_COMBINED = _CELLS.replace(_CELLS[_CELLS.index("k AS (SELECT 'l_returnflag'") : _CELLS.index("d AS (SELECT marginal")], "k AS (SELECT 'l_returnflag+l_returnflag*l_linestatus' AS marginal, sum((x0 - b0) * x0) AS h00, sum((x0 - b0) * x1) AS h01, sum((x1 - b1) * x0) AS h10, sum((x1 - b1) * x1) AS h11 FROM c UNION ALL SELECT 'l_linestatus', sum(b0 * x0), sum(b0 * x1), sum(b1 * x0), sum(b1 * x1) FROM c),\n")


@query(f"{_COMBINED} SELECT marginal, CAST(0 AS BIGINT) AS component, round(100 - 100 * sum(power(x0 - u0 * (w0 * x0 + w1 * x1), 2) + power(x1 - u1 * (w0 * x0 + w1 * x1), 2)) / t, 5) AS explained, round(100 * sum(power(u0 * x0 + u1 * x1, 2)) / t, 5) AS cumulative FROM s, c GROUP BY marginal, t")
def dpca_combined(spark, sf):
    """The same with one factor and its interaction as one marginal, and the variance inside the first axis."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 2).alias("unit"), "l_returnflag", "l_linestatus", "l_quantity")
    out = models.demixed(li, "unit", ("l_returnflag", "l_linestatus"), "l_quantity", 1, 1e-3, [[("l_returnflag",), ("l_returnflag", "l_linestatus")]])
    return out.select("marginal", "component", F.round("explained", 5).alias("explained"), F.round("cumulative", 5).alias("cumulative"))


@query()
def dpca_three_factors(spark, sf):
    """Demixed components of three factors and all their interactions."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("unit"), "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).alias("half"), "l_quantity")
    return models.demixed(li, "unit", ("l_returnflag", "l_linestatus", "half"), "l_quantity", 1)


# clocks

_STEP = f"""WITH {EV}, p AS (SELECT t AS x, t * 1.00001 + 7000 + (event_id % 7 - 3) * 10 + CASE WHEN t > (SELECT max(t) FROM ev) * 0.6 THEN 5000000000 ELSE 0 END AS y FROM ev WHERE event_type = 'purchase'),
g AS (SELECT (x + lag(x) OVER (ORDER BY x)) / 2.0 AS place, (y - lag(y) OVER (ORDER BY x)) - (x - lag(x) OVER (ORDER BY x)) AS g FROM p), a AS (SELECT arg_max(place, abs(g)) AS place FROM g WHERE g IS NOT NULL),
z AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(sign(x - place) AS DOUBLE) AS z FROM p, a), c AS (SELECT var_pop(x) AS uu, covar_pop(x, z) AS uz, var_pop(z) AS zz, covar_pop(x, y) AS uv, covar_pop(y, z) AS vz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM z),
f AS (SELECT (uv * zz - vz * uz) / (uu * zz - uz * uz) AS scale, (vz * uu - uv * uz) / (uu * zz - uz * uz) AS step, mx, my, mz FROM c)"""


@query(f"{_STEP} SELECT round(scale, 9) AS scale, round(step / 1e6, 3) AS step, round((my - scale * mx - step * mz) / 1e6, 2) AS off, round((SELECT place FROM a) / 1e6, 3) AS place FROM f")
def sync_step(spark, sf):
    """A clock against another that jumps once: line and step."""
    ev = events(spark, sf)
    last = ev.agg(F.max("t").alias("last"))  # one row
    jump = F.when(F.col("t") > F.col("last") * 0.6, F.lit(5_000_000_000)).otherwise(F.lit(0))
    y = F.col("t") * 1.00001 + 7000 + (F.col("event_id") % 7 - 3) * 10 + jump
    f = sync.with_step(ev.where("event_type = 'purchase'").crossJoin(F.broadcast(last)).select(F.col("t").alias("x"), y.alias("y")))
    return spark.createDataFrame([(round(f["scale"], 9), round(f["step"] / 1e6, 3), round(f["offset"] / 1e6, 2), round(f["at"] / 1e6, 3))], "scale double, step double, off double, place double")
