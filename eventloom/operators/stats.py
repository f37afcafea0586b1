"""Grouped statistics over long tables of values: tests, class distances, marginals, tuning and decoding.

Everything reduces to sums by key before any join, so joins are between group tables.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import numeric
from eventloom.operators.ordered import numbered
from eventloom.operators.recording import parted, scatter


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and sample SD by group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def cohens_d(df: DataFrame, label: str, by: list[str], value: str) -> DataFrame:
    """d of every ordered pair of classes, by the pooled SD."""
    m = moments(df, [*by, label], value)
    a = m.select(*by, F.col(label).alias("a"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("sd").alias("s1"))
    b = m.select(*by, F.col(label).alias("b"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("sd").alias("s2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") ** 2 + (F.col("n2") - 1) * F.col("s2") ** 2) / (F.col("n1") + F.col("n2") - 2))
    return a.join(b, by).where("a <> b").select(*by, "a", "b", ((F.col("m2") - F.col("m1")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def t_test(df: DataFrame, by: list[str], value: str, baseline: float | Column = 0.0) -> DataFrame:
    """One-sample t statistic and degrees of freedom by group."""
    m = moments(df, by, value)
    base = baseline if isinstance(baseline, Column) else F.lit(baseline)
    return m.select(*by, "n", ((F.col("mean") - base) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"), (F.col("n") - 1).alias("df"))


def anova(df: DataFrame, label: str, by: list[str], value: str) -> DataFrame:
    """F and degrees of freedom of a one-way analysis, from two levels of sums."""
    g = df.groupBy(*by, label).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    sums = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    ssb = F.col("between") - F.col("s") * F.col("s") / F.col("n")
    ssw = F.col("q") - F.col("between")
    f = (ssb / (F.col("k") - 1)) / F.nullif(ssw / (F.col("n") - F.col("k")), F.lit(0.0))
    return sums.select(*by, f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def var_explained(df: DataFrame, label: str, dim: str, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Between-class share of the total sum of squares over all dimensions."""
    g = df.groupBy(*by, dim, label).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    d = g.groupBy(*by, dim).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return d.groupBy(*by).agg((F.sum(F.col("b") - mean) / F.sum(F.col("q") - mean)).alias("share"))


def standardised(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Values of each unit less their mean over the population SD; constant units go."""
    m = df.groupBy(unit).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(m, unit).where("__s > 0").withColumn(value, (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def class_similarity(df: DataFrame, unit: str, label: str, dim: str, value: str) -> DataFrame:
    """Mean correlation between the members of every two classes, self pairs on the diagonal.

    The mean over pairs is the inner product of the classes' mean standardised vectors
    over the number of dimensions, so no pairs of units are made.
    """
    z = standardised(df, unit, value)
    size = z.groupBy(label).agg(F.countDistinct(unit).alias("k"))
    dims = z.groupBy(unit).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d").alias("d"))
    mean = z.groupBy(label, dim).agg(F.sum(value).alias("s")).join(size, label).select(label, dim, (F.col("s") / F.col("k")).alias("m"))
    a, b = mean.select(F.col(label).alias("a"), dim, F.col("m").alias("x")), mean.select(F.col(label).alias("b"), dim, F.col("m").alias("y"))
    return a.join(b, dim).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p")).crossJoin(F.broadcast(dims)).select("a", "b", (F.col("p") / F.col("d")).alias("r"))  # one row


def fisher_z(df: DataFrame, value: str) -> DataFrame:
    """Correlations as Fisher's z; those of 1 and -1 by the nearest lesser number, so none is infinite."""
    most = 1 - 2.0**-52
    return df.withColumn(value, F.atanh(F.greatest(F.least(F.col(value), F.lit(most)), F.lit(-most))))


def ranked(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Average ranks of each unit's values, for rank correlation."""
    w = Window.partitionBy(unit)
    r = F.rank().over(w.orderBy(value))
    same = F.count(F.lit(1)).over(Window.partitionBy(unit, value))
    return df.withColumn("__r", (r + (same - 1) / 2).cast("double")).withColumn(value, F.col("__r")).drop("__r")


def marginals(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Effects of every subset of factors by inclusion and exclusion of the means of cell means.

    A row has the factors of its subset (others null) and the effect; the empty subset is
    the grand mean.
    """
    cells = df.groupBy(*factors).agg(F.avg(value).alias("m"))
    cube = cells.cube(*factors).agg(F.avg("m").alias("m"), F.grouping_id().cast("long").alias("g"))
    full = (1 << len(factors)) - 1

    def code(subset: tuple[str, ...]) -> int:
        return full - sum(1 << len(factors) - 1 - factors.index(f) for f in subset)

    out = None
    for k in range(len(factors) + 1):
        for subset in combinations(factors, k):
            own = cube.where(F.col("g") == code(subset)).select(*factors, F.col("m").alias("effect"))
            for j in range(k):
                for part in combinations(subset, j):
                    lower = cube.where(F.col("g") == code(part)).select(*part, F.col("m").alias("__m"))
                    sign = -1 if (k - j) % 2 else 1
                    own = own.join(lower, list(part)) if part else own.crossJoin(F.broadcast(lower))  # the grand mean is one row
                    own = own.select(*factors, (F.col("effect") + sign * F.col("__m")).alias("effect"))
            out = own if out is None else out.unionByName(own)
    return out


def tuning(df: DataFrame, x: Column, y: Column, nx: int, ny: int, by: list[str], value: Column) -> DataFrame:
    """Mean of value and share of samples in every bin (x, y); empty bins stay, others go."""
    rows = df.withColumn("bx", x.cast("long")).withColumn("by", y.cast("long")).where(F.col("bx").between(0, nx - 1) & F.col("by").between(0, ny - 1))
    n = rows.groupBy(*by, "bx", "by").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    axis = lambda name, k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias(name)
    grid = total.select("*", axis("bx", nx)).select("*", axis("by", ny))
    return grid.join(n, [*by, "bx", "by"], "left").select(*by, "bx", "by", "mean", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("occupancy"))


def mutual_information(maps: DataFrame, by: list[str]) -> DataFrame:
    """Bits of a tuning map: sum p * occ * log2(p / pR); empty and zero bins count nothing."""
    total = maps.groupBy(*by).agg(F.sum("mean").alias("__t"))
    p = maps.join(total, by).withColumn("p", F.col("mean") / F.nullif(F.col("__t"), F.lit(0.0)))
    r = p.groupBy(*by).agg(F.sum(F.col("p") * F.col("occupancy")).alias("r"))
    term = F.when((F.col("p") > 0) & (F.col("r") > 0), F.col("p") * F.col("occupancy") * F.log2(F.col("p") / F.col("r")))
    return p.join(r, by).groupBy(*by).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("bits"))


def _seed(seed: int, key: tuple) -> int:
    """A seed of a group's own, the same wherever the group is handled."""
    return zlib.crc32(repr((seed, *key)).encode())


def map_information_test(maps: DataFrame, by: list[str], shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """by, bits and p: the share of shuffles of a unit's bins whose bits reach its own, with the level of the map as it is.

    Only the maps meet, of bins a unit; empty bins are shuffled with the others.
    """

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bx", "by"])
        mean, occupancy = pdf["mean"].to_numpy(float), np.nan_to_num(pdf["occupancy"].to_numpy(float))
        total = np.nansum(mean)
        p = mean / total if total else np.zeros(len(mean))
        level = np.nansum(p * occupancy)
        bits = numeric.map_information(p, occupancy, level)
        order = np.random.default_rng(_seed(seed, key)).permuted(np.tile(np.arange(len(p)), (shuffles, 1)), axis=1)
        null = numeric.map_information(p[order], occupancy, level)
        out = pd.DataFrame([key], columns=by)
        out["bits"], out["p"] = bits, float((null >= bits - 1e-12).mean())
        return out

    kind = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in by)
    names = [c for c in (*by, "bx", "by", "mean", "occupancy") if c not in by] + list(by)
    return maps.select(*names).groupBy(*by).applyInPandas(test, f"{kind}, bits double, p double")


def label_shuffle(pairs: DataFrame, by: list[str], label: str, guess: str, shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """by, n, accuracy, expected, sd, p and bits, p_bits: how often guesses are right, what shuffled labels would give, and the share of shuffles that reach it; the same for the bits that labels and guesses share.

    Shuffling labels changes a table of counts alone, so shuffles are drawn from the table's sums (multivariate
    hypergeometric): no row is copied. The table of a group is of labels by guesses.
    """
    counts = pairs.where(F.col(label).isNotNull() & F.col(guess).isNotNull()).groupBy(*by, F.col(label).alias("__l"), F.col(guess).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["__l"]) | set(pdf["__g"]))
        place = {c: i for i, c in enumerate(names)}
        table = np.zeros((len(names), len(names)), np.int64)
        table[[place[c] for c in pdf["__l"]], [place[c] for c in pdf["__g"]]] = pdf["__n"]
        n, r, c = int(table.sum()), table.sum(axis=1).astype(float), table.sum(axis=0).astype(float)
        expected = float((r * c).sum() / n**2)
        both = (r * c).sum() ** 2 - (r * r * c * c).sum()
        variance = ((r * c * (n - r) * (n - c)).sum() + both) / (n * n * (n - 1)) if n > 1 else 0.0
        null = numeric.shuffled_tables(table, shuffles, _seed(seed, key))
        own, bits = float(np.trace(table)) / n, float(numeric.information(table))
        right = np.trace(null, axis1=1, axis2=2) / n
        out = pd.DataFrame([key], columns=by)
        out["n"], out["accuracy"], out["expected"], out["sd"], out["p"] = n, own, expected, float(np.sqrt(max(variance, 0.0)) / n), float((right >= own - 1e-12).mean())
        out["bits"], out["p_bits"] = bits, float((numeric.information(null) >= bits - 1e-12).mean())
        return out

    kind = "".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}, " for k in by)
    return counts.groupBy(*by).applyInPandas(test, f"{kind}n long, accuracy double, expected double, sd double, p double, bits double, p_bits double")


def multivariate_shares(df: DataFrame, keys: list[str], label: str, column: str, ridge: float | None = None, fraction: float = 0.0) -> DataFrame:
    """keys, trace, largest, pillai, wilks and log_det: what the classes explain of a vector's dimensions together (see numeric.shares), from sums that tasks make."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *numeric.shares(*parted(pdf, label), ridge, fraction))], columns=[*keys, "trace", "largest", "pillai", "wilks", "log_det"])

    kind = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return scatter(df, keys, label, column).groupBy(*keys).applyInPandas(run, f"{kind}trace double, largest double, pillai double, wilks double, log_det double")


def bayes_decode(counts: DataFrame, rates: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Most likely bin of each sample: counts (sample, unit, r), rates (unit, bin, l > 0), occupancy (bin, occ).

    Ties go to the lowest bin; the maps are tables of units by bins.
    """
    score = counts.join(rates, "unit").groupBy("sample", "bin").agg(F.sum(F.col("r") * F.log("l") - F.col("l")).alias("s"))
    full = score.join(occupancy.where("occ > 0"), "bin").withColumn("s", F.round(F.col("s") + F.log("occ"), 9))
    return full.groupBy("sample").agg(F.max_by("bin", F.struct(F.col("s"), -F.col("bin"))).alias("bin"))


def nearest_mean(df: DataFrame, unit: str, label: str, fold: str, folds: int, dim: str, value: str) -> DataFrame:
    """Class of the nearest class mean of each unit, means made without the unit's own fold (0 to folds - 1)."""
    part = df.groupBy(fold, label, dim).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = part.groupBy(label, dim).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    means = every.withColumn(fold, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")))).join(part, [fold, label, dim], "left")
    means = means.select(fold, F.col(label).alias("guess"), dim, ((F.col("all_s") - F.coalesce("s", F.lit(0.0))) / F.nullif(F.col("all_n") - F.coalesce("n", F.lit(0)), F.lit(0))).alias("m"))
    d = df.join(means, [fold, dim]).groupBy(unit, label, "guess").agg(F.sum((F.col(value) - F.col("m")) ** 2).alias("d"))
    return d.groupBy(unit, label).agg(F.min_by("guess", F.struct(F.round("d", 9), "guess")).alias("guess"))


def confusion(found: DataFrame, label: str, guess: str = "guess") -> DataFrame:
    """Share of each true class that each guess takes."""
    n = found.groupBy(label, guess).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy(label).agg(F.sum("n").alias("t")), label).select(label, guess, "n", (F.col("n") / F.col("t")).alias("share"))


def balanced_accuracy(found: DataFrame, label: str, guess: str = "guess") -> DataFrame:
    c = found.groupBy(label).agg(F.avg(F.when(F.col(label) == F.col(guess), 1.0).otherwise(0.0)).alias("a"))
    return c.agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("classes"))


def chance(df: DataFrame, label: str) -> DataFrame:
    """Share of the commonest class among known labels."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("chance"))


def balance(df: DataFrame, label: str, key: str, mode: str = "min", seed: int = 0) -> DataFrame:
    """Equal numbers of rows by class: the least class's number drawn from each, or copies up to the greatest's.

    Draws are by hash of the key, so they repeat. Rows of a class are numbered within ranges
    of the hash, and ranges by their totals, so no class is sorted in one place.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    goal = sizes.agg((F.min if mode == "min" else F.max)("__n").alias("__goal"))
    rows = df.join(sizes, label).crossJoin(F.broadcast(goal))  # one row
    placed = numbered(rows.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), "__i", "__h", (label,), 1 << 52).withColumn("__i", F.col("__i") - 1).drop("__h")
    if mode == "min":
        return placed.where("__i < __goal").drop("__i", "__n", "__goal")
    copies = F.expr("__goal div __n + if(__i < __goal % __n, 1, 0)")
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))).drop("__i", "__n", "__goal")
