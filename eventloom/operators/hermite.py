"""Piecewise cubic interpolation of each key's series: slopes from neighbours by windows, values by as-of look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import asof


def _harmonic(h: Column, g: Column, d: Column, c: Column) -> Column:
    """Shape-preserving slope between the piece before (length g, slope c) and the piece after (h, d)."""
    a, b = 2 * h + g, h + 2 * g
    return F.when(c * d <= 0, F.lit(0.0)).otherwise((a + b) / (a / F.nullif(c, F.lit(0.0)) + b / F.nullif(d, F.lit(0.0))))


def _edge(h: Column, g: Column, d: Column, c: Column) -> Column:
    """Shape-preserving slope at an end, next to a piece (h, d) and the one after it (g, c)."""
    m = ((2 * h + g) * d - h * c) / (h + g)
    return F.when(F.signum(m) != F.signum(d), F.lit(0.0)).when((F.signum(d) != F.signum(c)) & (F.abs(m) > 3 * F.abs(d)), 3 * d).otherwise(m)


def slopes(table: DataFrame, value: str, on: tuple[str, ...], t: str = "t", kind: str = "pchip") -> DataFrame:
    """Adds the slope per second at each of a key's rows (distinct times): ``pchip`` keeps the data's shape, ``makima`` weighs neighbouring slopes by their change."""
    w = Window.partitionBy(*on).orderBy(t)
    rows = table.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__h", (F.lead(t).over(w) - F.col(t)) / F.lit(1e6)).withColumn("__d", (F.lead(value).over(w) - F.col(value)) / F.col("__h"))
    h, d = F.col("__h"), F.col("__d")
    if kind == "pchip":
        g, c = F.lag("__h").over(w), F.lag("__d").over(w)
        first = F.coalesce(_edge(h, F.lead("__h").over(w), d, F.lead("__d").over(w)), d)
        last = F.coalesce(_edge(g, F.lag("__h", 2).over(w), c, F.lag("__d", 2).over(w)), c)
        m = F.when(c.isNull(), first).when(d.isNull(), last).otherwise(_harmonic(h, g, d, c))
    elif kind == "makima":
        rows = rows.withColumn("__c", F.lag("__d").over(w)).withColumn("__b", F.lag("__d", 2).over(w)).withColumn("__e", F.lead("__d").over(w))
        b, c, e = F.col("__b"), F.col("__c"), F.col("__e")
        # slopes beyond the ends go on with their last change, or stay where there is one only
        after = F.coalesce(d, 2 * c - b, c)
        further = F.coalesce(F.when(d.isNotNull(), e), 2 * after - c)
        before = F.coalesce(c, 2 * d - e, d)
        earlier = F.coalesce(F.when(c.isNotNull(), b), 2 * before - after)
        x = F.abs(further - after) + F.abs(further + after) / 2
        y = F.abs(before - earlier) + F.abs(before + earlier) / 2
        m = F.when(x + y == 0, F.lit(0.0)).otherwise((x * before + y * after) / F.nullif(x + y, F.lit(0.0)))
        m = F.coalesce(m, after, before)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return rows.withColumn("slope", m).drop("__h", "__d", "__b", "__c", "__e")


def interpolate(queries: DataFrame, table: DataFrame, value: str, on: tuple[str, ...], t: str = "t", kind: str = "pchip") -> DataFrame:
    """Each query row with its key's interpolated value; null outside the key's first and last time."""
    w = Window.partitionBy(*on).orderBy(t)
    pieces = slopes(table, value, on, t, kind).select(*on, t, F.col(t).alias("__t0"), F.col(value).alias("__v0"), F.coalesce("slope", F.lit(0.0)).alias("__m0"), F.lead(t).over(w).alias("__t1"), F.lead(value).over(w).alias("__v1"), F.lead("slope").over(w).alias("__m1"))
    found = asof(queries, pieces, ["__t0", "__v0", "__m0", "__t1", "__v1", "__m1"], "previous", on, t)
    h = (F.col("__t1") - F.col("__t0")) / F.lit(1e6)
    s = (F.col(t) - F.col("__t0")) / F.lit(1e6) / h
    cubic = (1 + 2 * s) * (1 - s) * (1 - s) * F.col("__v0") + s * (1 - s) * (1 - s) * h * F.col("__m0") + s * s * (3 - 2 * s) * F.col("__v1") + s * s * (s - 1) * h * F.col("__m1")
    return found.select(*queries.columns, F.when(F.col(t) == F.col("__t0"), F.col("__v0")).otherwise(cubic).alias(value))
