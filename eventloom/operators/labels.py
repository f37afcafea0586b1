"""Design matrices on a time grid, in long form (key, bin, var, value), and temporal bases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_hot(df: DataFrame, name: str) -> DataFrame:
    """Events as variables: value 1 of var ``name=class``."""
    return df.select("key", "bin", F.concat(F.lit(f"{name}="), F.col(name)).alias("var"), F.lit(1.0).alias("value"))


#: A temporal basis: rows of basis number, offset in bins and weight, fixed by its parameters.
Basis = list[tuple[int, int, float]]


def with_basis(df: DataFrame, basis: Basis) -> DataFrame:
    """Each row with each row of the basis, as a literal array that is unpacked in place."""
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("basis"), F.lit(o).cast("long").alias("off"), F.lit(float(w)).alias("weight")) for k, o, w in basis])
    return df.select("*", F.inline(rows))


def dirac_basis(n: int) -> Basis:
    return [(k, k, 1.0) for k in range(n)]


def raised_cosine_basis(bases: int, lo: int, hi: int, spacing: str = "linear", shift: float = 1.0) -> Basis:
    """Evenly spread bumps (cos(d) + 1) / 2 over bins lo to hi; log spacing over log(off + shift)."""
    f = (lambda x: math.log(x + shift)) if spacing == "log" else float
    a, b = f(lo), f(hi)
    width = (b - a) / (bases - 1) if bases > 1 else 1.0
    d = lambda k, o: (f(o) - a - k * width) * math.pi / (2 * width)
    return [(k, o, (math.cos(d(k, o)) + 1) / 2 if abs(d(k, o)) < math.pi else 0.0) for k in range(bases) for o in range(lo, hi + 1)]


def history_basis(bases: int, lags: int, shortest: float, longest: float) -> Basis:
    """Unit-norm exponentials with log-spaced time constants."""
    out: Basis = []
    for k in range(bases):
        tau = shortest * (longest / shortest) ** (k / max(bases - 1, 1))
        w = [math.exp(-j / tau) for j in range(1, lags + 1)]
        n = math.sqrt(sum(x * x for x in w))
        out += [(k, j, x / n) for j, x in enumerate(w, 1)]
    return out


def flip(basis: Basis) -> Basis:
    return [(k, -o, w) for k, o, w in basis]


def expand(df: DataFrame, basis: Basis, lo: int, hi: int) -> DataFrame:
    """Each variable convolved with each basis column, aligned at offset 0, inside bins lo to hi."""
    out = with_basis(df, basis).withColumn("bin", F.col("bin") + F.col("off")).where(F.col("bin").between(lo, hi))
    return out.groupBy("key", "var", "basis", "bin").agg(F.sum(F.col("value") * F.col("weight")).alias("value")).where("value <> 0")


def reduce(df: DataFrame) -> DataFrame:
    """Basis columns of a variable summed."""
    return df.groupBy("key", "var", "bin").agg(F.sum("value").alias("value"))


def lagged(df: DataFrame, lags: int, value: str, on: tuple[str, ...], order: str = "bin") -> DataFrame:
    """Bias and lagged copies of a value, zero before the first."""
    w = Window.partitionBy(*on).orderBy(order)
    return df.select("*", F.lit(1.0).alias("bias"), *[F.lag(value, k, 0.0).over(w).alias(f"{value}_{k}") for k in range(lags)])


def smooth(df: DataFrame, on: list[str], axes: list[str], value: str, sd: float) -> DataFrame:
    """Gaussian smoothing over integer axes that ignores nulls and renormalises by the valid mass."""
    r = math.ceil(2 * sd)
    line = [(0, k, math.exp(-k * k / (2 * sd * sd))) for k in range(-r, r + 1)]
    rows = df.where(F.col(value).isNotNull()).withColumn("__w", F.lit(1.0))
    for axis in axes:
        rows = with_basis(rows, line).withColumn(axis, F.col(axis) + F.col("off")).withColumn("__w", F.col("__w") * F.col("weight")).drop("basis", "off", "weight")
    sums = rows.groupBy(*on, *axes).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias(value))
    return df.select(*on, *axes).join(sums, [*on, *axes], "left")
