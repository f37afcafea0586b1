"""Cross-validation of demixed components: ridge search, classification and significance.

Each repetition holds out one trial of every unit and cell, drawn at random; shuffles permute a unit's trials over its
cells, whose sizes stay, and each is repeated as the data are. Trials are shuffled once, to blocks of a unit's trials:
a task permutes its block as often as asked and gives back the cells' sums and the trials that are held out, so neither
shuffles nor repetitions copy the trials. A unit of at most ``BLOCK`` trials is permuted as a whole, a larger one
within blocks drawn by hash, which keeps the cells' sizes as well. A group of the classifiers then has one shuffle's
units * cells matrices of ``TOGETHER`` repetitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import numeric

#: Trials of a block, numbers of shuffled copies that are in memory at once, and repetitions that a group classifies.
BLOCK, COPIES, TOGETHER = 1 << 16, 1 << 21, 25


def held_out(df: DataFrame, unit: str, factors: tuple[str, str], value: str, key: str, reps: int, shuffles: int = 0, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """shuffle, rep, unit, both factors, train (mean without the held trial), test (the held trial) and e (squared SE).

    With no ``shuffles``, shuffle 0 is the data. A cell's only trial is both train and test. Null units, factors and
    values are no trials.
    """
    a, b = factors
    rows = df.select(F.col(unit).alias("unit"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).cast("double").alias("x"), F.xxhash64(key).alias("h")).dropna(subset=["unit", "a", "b", "x"])
    w = Window.partitionBy("unit")
    cells = rows.groupBy("unit", "a", "b").agg(F.count("x").alias("n"), F.sum("x").alias("s"))  # a row a unit and cell
    cells = cells.select("unit", "a", "b", "n", (F.row_number().over(w.orderBy("a", "b")) - 1).alias("cell"), F.ceil(F.sum("n").over(w) / F.lit(block)).alias("blocks"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean"))
    trials = rows.join(cells, ["unit", "a", "b"]).select("unit", F.pmod(F.xxhash64("h"), "blocks").alias("block"), "cell", "h", (F.col("x") - F.col("mean")).alias("x"))
    sizes = trials.groupBy("unit", "block", "cell").agg(F.count("x").alias("own"))
    before = F.sum("own").over(Window.partitionBy("unit", "cell").orderBy("block")) - F.col("own")
    sizes = sizes.withColumn("before", before).join(cells.select("unit", "cell", "n"), ["unit", "cell"])
    sizes = sizes.select(F.col("unit").alias("of"), F.col("block").alias("at"), F.col("cell").alias("cell"), "own", "before", "n", F.xxhash64("unit").alias("u"))

    def part(mine: pa.Table, size: pa.Table) -> pa.Table:
        """Sums and held trials of a block: a row a cell and shuffle."""
        size = size.sort_by("cell")
        mine = mine.sort_by([("cell", "ascending"), ("h", "ascending"), ("x", "ascending")])
        x = mine["x"].to_numpy()
        cell, own, ahead, n = (size[c].to_numpy() for c in ("cell", "own", "before", "n"))
        start = np.cumsum(own) - own
        copies, name = max(shuffles, 1), [v % 2**64 for v in (seed, size["u"][0].as_py(), size["at"][0].as_py())]
        rng, step = np.random.default_rng(name), max(COPIES // len(x), 1)
        draws = [np.random.default_rng([*name[:2], int(c)]).integers(0, k, (copies, reps)) - o for c, k, o in zip(cell, n, ahead, strict=True)]
        out = []
        for lo in range(0, copies, step):
            hi = min(lo + step, copies)
            y = np.broadcast_to(x, (hi - lo, len(x)))
            y = rng.permuted(y, axis=1) if shuffles else y
            s, q = (np.add.reduceat(v, start, axis=1) for v in (y, y * y))
            for j, at in enumerate(draws):
                here = (at[lo:hi] >= 0) & (at[lo:hi] < own[j])
                copy, rep = np.nonzero(here)
                found = y[copy, start[j] + at[lo:hi][here]]
                ends = np.r_[0, np.cumsum(here.sum(axis=1))].astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (rep.astype(np.int32), found))
                k = pa.array(np.full(hi - lo, cell[j]), pa.int32())
                out.append(pa.table([k, pa.array(np.arange(lo, hi), pa.int32()), pa.array(s[:, j]), pa.array(q[:, j]), *lists], ["cell", "shuffle", "s", "q", "rep", "test"]))
        out = pa.concat_tables(out)
        return out.add_column(0, "unit", pa.repeat(size["of"][0], len(out)))

    schema = f"unit {rows.schema['unit'].dataType.simpleString()}, cell int, shuffle int, s double, q double, rep array<int>, test array<double>"
    parts = trials.groupBy("unit", "block").cogroup(sizes.groupBy("of", "at")).applyInArrow(part, schema)
    whole = parts.groupBy("unit", "cell", "shuffle").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.flatten(F.collect_list(F.arrays_zip("rep", "test"))).alias("held"))  # reps trials
    n, s = F.col("n"), F.col("s")
    each = whole.join(cells, ["unit", "cell"]).select("shuffle", "unit", "a", "b", "n", "s", "mean", ((F.col("q") - s * s / n) / F.nullif(n - 1, F.lit(0)) / n).alias("e"), F.inline("held"))
    train = F.when(n > 1, (s - F.col("test")) / (n - 1)).otherwise(F.col("test")) + F.col("mean")
    return each.select("shuffle", "rep", "unit", "a", "b", train.alias("train"), (F.col("test") + F.col("mean")).alias("test"), F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(0.0)).alias("e"))


class _Cells:
    """Matrices (repetitions, units, cells) of one shuffle; cells that a unit lacks have its mean over those it has."""

    def __init__(self, pdf: pd.DataFrame):
        self.reps, r = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
        u = pd.factorize(pdf["unit"], sort=True)[0]
        (a, names_a), (b, names_b) = (pd.factorize(pdf[c], sort=True) for c in ("a", "b"))
        pairs, c = np.unique(a * len(names_b) + b, return_inverse=True)
        self.a, self.b = pairs // len(names_b), pairs % len(names_b)
        place, shape = (r, u, c), (len(self.reps), u.max() + 1, len(pairs))
        self.train, self.test = (self._filled(pdf[v].to_numpy(), place, shape) for v in ("train", "test"))
        e = np.full(shape, np.nan)
        e[place] = pdf["e"].to_numpy()
        self.noise = np.nanmean(e, axis=2)

    @staticmethod
    def _filled(v: np.ndarray, place: tuple, shape: tuple) -> np.ndarray:
        m = np.full(shape, np.nan)
        m[place] = v
        return np.where(np.isnan(m), np.nanmean(m, axis=2, keepdims=True), m)

    def margins(self, m: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """A units * cells matrix less its rows' means, and its parts."""
        x = m - m.mean(axis=1, keepdims=True)
        a, b = (self._mean(x, level) for level in (self.a, self.b))
        return x, {"a": a, "b": b, "ab": x - a - b}

    @staticmethod
    def _mean(x: np.ndarray, level: np.ndarray) -> np.ndarray:
        one = level[:, None] == np.arange(level.max() + 1)
        return x @ (one / np.maximum(one.sum(axis=0), 1)) @ one.T


def ridge_search(cells: DataFrame, components: int, ridges: list[float]) -> DataFrame:
    """Mean share of held-out variance left unexplained, by ridge; the least wins."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, out = _Cells(pdf), []
        for rep, train, test, noise in zip(m.reps, m.train, m.test, m.noise, strict=True):
            _, marginals = m.margins(train)
            test, wanted = m.margins(test)
            for r in ridges:
                found = numeric.demix(train, np.diag(noise), marginals, components, r)
                left = sum(((wanted[k] - u @ (w.T @ test)) ** 2).sum() for k, (w, u, _) in found.items())
                out.append((int(rep), r, float(left / max((test**2).sum(), 1e-300))))
        return pd.DataFrame(out, columns=["rep", "ridge", "error"])

    each = cells.groupBy("rep").applyInPandas(run, "rep int, ridge double, error double")
    return each.groupBy("ridge").agg(F.avg("error").alias("error"), F.count(F.lit(1)).alias("reps"))


def accuracy(cells: DataFrame, components: int, ridge: float) -> DataFrame:
    """Share of held-out cells whose class of each factor is that of the nearest training class, by component.

    ``accuracy`` is the mean over all repetitions, ``most`` the greatest of the shuffles' means.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, out = _Cells(pdf), []
        for train, test, noise in zip(m.train, m.test, m.noise, strict=True):
            x, marginals = m.margins(train)
            test = test - test.mean(axis=1, keepdims=True)
            found = numeric.demix(train, np.diag(noise), marginals, components, ridge)
            for name, level in (("a", m.a), ("b", m.b)):
                classes = np.unique(level)
                w = found[name][0]
                own, held = w.T @ x, w.T @ test
                centres = np.stack([own[:, level == c].mean(axis=1) for c in classes], axis=1)
                guess = classes[np.abs(held[:, :, None] - centres[:, None]).argmin(axis=2)]
                out += [(name, k, float(share)) for k, share in enumerate((guess == level).mean(axis=1))]
        return pd.DataFrame(out, columns=["marginal", "component", "accuracy"]).assign(shuffle=int(pdf["shuffle"].iloc[0]))

    cells = cells.withColumn("part", F.expr(f"rep div {TOGETHER}"))
    each = cells.groupBy("shuffle", "part").applyInPandas(run, "shuffle int, marginal string, component long, accuracy double")
    each = each.groupBy("shuffle", "marginal", "component").agg(F.avg("accuracy").alias("accuracy"))
    return each.groupBy("marginal", "component").agg(F.avg("accuracy").alias("accuracy"), F.max("accuracy").alias("most"))


def significant(real: DataFrame, shuffled: DataFrame) -> DataFrame:
    """Components whose accuracy exceeds the greatest mean of the shuffles."""
    s = shuffled.select("marginal", "component", F.col("most").alias("chance"))
    return real.join(s, ["marginal", "component"]).select("marginal", "component", "accuracy", "chance", (F.col("accuracy") > F.col("chance")).alias("significant"))


def long_runs(df: DataFrame, flag: str, on: list[str], order: str, least: int) -> DataFrame:
    """The flag less its runs shorter than ``least``."""
    w = Window.partitionBy(*on).orderBy(order)
    new = (F.lag(flag).over(w) != F.col(flag)).cast("long")
    runs = df.withColumn("__n", F.coalesce(new, F.lit(0))).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*on, "__g"))
    return runs.withColumn(flag, F.col(flag) & (size >= least)).drop("__n", "__g")
