"""Queries of the linear-algebra and signal models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from eventloom.functions import numeric
from eventloom.functions.timing import HOUR, MINUTE
from eventloom.operators import demixing, models, stats
from eventloom.operators.ripples import find_ripples
from eventloom.plans.interval_queries import EV
from eventloom.plans.registry import query
from eventloom.plans.stats_queries import V, vectors
from eventloom.sources.tables import events, spikes, table, triggers


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding", (F.col("vec_id") % 5).alias("fold"))


@query()
def pca(spark, sf):
    """Latent roots and explained percent of the vectors."""
    p = models.pca(_emb(spark, sf), "embedding")
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p["latent"], p["explained"], strict=True))], "component long, latent double, explained double")


@query(f"{V} SELECT round(sum(s), 6) AS total_variance FROM (SELECT var_samp(x) AS s FROM v GROUP BY dim)")
def pca_total_variance(spark, sf):
    """The latent roots' sum, which equals the sum of variances."""
    return spark.createDataFrame([(round(float(models.pca(_emb(spark, sf), "embedding")["latent"].sum()), 6),)], "total_variance double")


@query("""SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[])[1:4], [1.0, 2.0, 3.0, 4.0]::DOUBLE[]), 6) AS score FROM embeddings""")
def coords_project(spark, sf):
    """Independent projection on one axis."""
    basis = np.zeros((64, 1))
    basis[:4, 0] = [1, 2, 3, 4]
    out = models.project(_emb(spark, sf), "embedding", basis, np.zeros(64), least_squares=False)
    return out.select("vec_id", F.round(F.col("score")[0], 6).alias("score"))


@query()
def class_subspaces(spark, sf):
    """Similarity and principal angle of the class-mean subspaces of two halves, and the share each holds of the other."""
    e = _emb(spark, sf)
    a, b = (models.class_means(e.where(F.col("vec_id") % 2 == k), "label", "embedding") for k in (0, 1))
    (x, ox), (y, _) = models.class_subspace(a), models.class_subspace(b)
    return spark.createDataFrame([(models.similarity(x, y), float(numeric.principal_angles(x, y).mean()), models.share_in_subspace(b.to_numpy(), x, ox))], "similarity double, angle double, share double")


@query()
def procrustes(spark, sf):
    e = _emb(spark, sf)
    a, b = (models.class_means(e.where(F.col("vec_id") % 2 == k), "label", "embedding").to_numpy() for k in (0, 1))
    r = models.procrustes(a, b)
    return spark.createDataFrame([(r["r2"], r["scale"], r["rotation"])], "r2 double, scale double, rotation double")


@query()
def decoder_whitened(spark, sf):
    return stats.balanced_accuracy(models.whitened_decoder(_emb(spark, sf), "vec_id", "label", "fold", "embedding", ridge=0.1), "label")


@query()
def svm_ecoc(spark, sf):
    return stats.balanced_accuracy(models.svm_decoder(_emb(spark, sf), "vec_id", "label", "fold", "embedding"), "label")


def _beta(a: str, b: str, x: str) -> str:
    """Sum that gives the regularised incomplete beta function by Simpson's rule over the angle whose squared sine is the variable; n.i runs from 0 to 2000."""
    phi = f"(asin(sqrt({x})) * i / 2000)"
    return f"sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2 * power(sin({phi}), 2 * {a} - 1) * power(cos({phi}), 2 * {b} - 1) * asin(sqrt({x})) / 6000 / exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b})))"


_N = f"{V}, n AS (SELECT unnest(range(0, 2001)) AS i)"


@query(f"""{_N}, t AS (SELECT dim, label, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM v GROUP BY 1, 2) SELECT dim, label, round(t, 6) AS t, CAST(df AS BIGINT) AS df, round({_beta("(df / 2.0)", "0.5", "(df / (df + t * t))")}, 6) AS p FROM t, n GROUP BY dim, label, t, df""")
def ttest_p(spark, sf):
    """Two-sided p of the one-sample t test by dimension and class."""
    t = stats.t_test(vectors(spark, sf), ["dim", "label"], "x")
    p = F.pandas_udf(lambda t, df: t.combine(df, numeric.t_p_value), "double")
    return t.select("dim", "label", F.round("t", 6).alias("t"), "df", F.round(p(F.col("t"), F.col("df").cast("double")), 6).alias("p"))


@query(f"""{_N}, g AS (SELECT dim, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM v GROUP BY 1, 2), o AS (SELECT dim, avg(x) AS m FROM v GROUP BY 1),
f AS (SELECT dim, (sum(n * (g.m - o.m) * (g.m - o.m)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f, CAST(count(*) - 1 AS DOUBLE) AS a, CAST(sum(n) - count(*) AS DOUBLE) AS b FROM g JOIN o USING (dim) GROUP BY dim)
SELECT dim, round(f, 6) AS f, round({_beta("(b / 2)", "(a / 2)", "(b / (b + a * f))")}, 6) AS p FROM f, n GROUP BY dim, f, a, b""")
def anova_p(spark, sf):
    f = stats.anova(vectors(spark, sf), "label", ["dim"], "x")

    @F.pandas_udf("double")
    def p(f, a, b):
        import pandas as pd

        return pd.Series([numeric.f_p_value(*x) for x in zip(f, a, b, strict=True)])

    return f.select("dim", F.round("f", 6).alias("f"), F.round(p("f", F.col("df1").cast("double"), F.col("df2").cast("double")), 6).alias("p"))


def _hourly(spark, sf, cell=None):
    """Counts by hour of each cell from the first hour to the last: cell, bin, n, and the hour's sine, cosine and night."""
    h = events(spark, sf).groupBy((F.col("user_id") % 8 if cell is None else cell).alias("cell"), F.expr(f"t div {HOUR}L").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = h.agg(F.max("bin").alias("last"))  # one row
    cells = h.select("cell").distinct().repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes that become many rows
    grid = cells.crossJoin(F.broadcast(last)).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    full = grid.join(h, ["cell", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")).cast("double"))
    angle = F.col("bin") * F.lit(2 * math.pi / 24)
    return full.withColumn("c", F.cos(angle)).withColumn("s", F.sin(angle)).withColumn("night", (F.col("bin") % 24 < 6).cast("double"))


@query()
def glm_poisson(spark, sf):
    m = models.glm_poisson(_hourly(spark, sf), ["c", "s", "night"], "n")
    return spark.createDataFrame([(k, v) for k, v in sorted(m.items())], "term string, value double")


@query()
def lasso_glm(spark, sf):
    return models.lasso_glm(_hourly(spark, sf), "cell", ["c", "s", "night"], "n", "poisson", 0.01)


@query()
def hmm_filter(spark, sf):
    return models.hmm_states(_hourly(spark, sf), "cell", "bin", "n")


@query()
def ripples(spark, sf):
    """Bursts of 8 to 20 minutes' period in the counts by minute of four channels around their means, days standing for seconds."""
    n = events(spark, sf).groupBy((F.col("user_id") % 4).alias("channel"), F.expr(f"t div {MINUTE}L").alias("sample")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    last = n.agg(F.max("sample").alias("last"))  # one row
    grid = n.select("channel").distinct().crossJoin(F.broadcast(last)).select("channel", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("sample"))
    whole = n.groupBy("channel").agg(F.sum("value").alias("sum")).crossJoin(F.broadcast(last)).select("channel", (F.col("sum") / (F.col("last") + 1)).alias("mean"))  # one row a channel
    signal = grid.join(n, ["channel", "sample"], "left").na.fill(0.0, ["value"]).join(whole, "channel").select("channel", "sample", (F.col("value") - F.col("mean")).alias("value"))
    return find_ripples(signal, "channel", "sample", "value", 1440.0, threshold=3.0, least=2.0)


@query()
def zeta(spark, sf):
    s = spikes(spark, sf).select((F.col("neuron") % 4).alias("cell"), "t")
    return models.zeta_test(s, triggers(spark, sf), "cell", HOUR)


@query()
def dpca(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("unit"), "l_returnflag", "l_linestatus", "l_quantity")
    return models.demixed(li, "unit", ("l_returnflag", "l_linestatus"), "l_quantity")


@query()
def dpss_basis(spark, sf):
    """Hourly counts of each cell along four Slepian sequences as long as the data."""
    h = _hourly(spark, sf)
    n = h.agg(F.max("bin").alias("last")).first().last + 1
    v = numeric.dpss(n, 2.5, 4)
    tapers = spark.createDataFrame(pd.DataFrame({"basis": np.repeat(np.arange(4), n), "bin": np.tile(np.arange(n), 4), "weight": v.T.ravel()}), "basis long, bin long, weight double")
    return h.join(tapers, "bin").groupBy("cell", "basis").agg(F.sum(F.col("n") * F.col("weight")).alias("coefficient"))


@query(f"WITH {EV}, h AS (SELECT user_id % 8 AS cell, t // {HOUR} AS bin, count(*) AS n FROM ev GROUP BY 1, 2) SELECT cell, CAST(count(*) AS BIGINT) AS bins, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1")
def hourly_cells(spark, sf):
    return _hourly(spark, sf).where("n > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").cast("long").alias("n"))


def _cells(spark, sf, reps, shuffles=0):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("unit"), "l_returnflag", "l_linestatus", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("k"))
    return demixing.held_out(li, "unit", ("l_returnflag", "l_linestatus"), "l_quantity", "k", reps, shuffles)


@query()
def dpca_ridge_search(spark, sf):
    return demixing.ridge_search(_cells(spark, sf, 10), 2, [1e-7 * 1.5**k for k in range(26)])


@query()
def dpca_significance(spark, sf):
    return demixing.significant(demixing.accuracy(_cells(spark, sf, 100), 2, 1e-5), demixing.accuracy(_cells(spark, sf, 100, 100), 2, 1e-5))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS f FROM orders), n AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> f THEN 1 ELSE 0 END AS n FROM f), g AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM n)
SELECT o_custkey, o_orderkey, f AND count(*) OVER (PARTITION BY o_custkey, g) >= 3 AS f FROM g""")
def long_runs(spark, sf):
    """Flags in runs of at least three orders of a customer."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("f"))
    return demixing.long_runs(o, "f", ["o_custkey"], "o_orderkey", 3)
