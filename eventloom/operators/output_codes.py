"""Classes by error-correcting output codes: many two-class linear learners whose answers are read together.

A coding matrix (classes, learners) says which classes a learner tells apart (1 from -1; 0 stays out). All learners of all
folds are fitted together by Newton steps: in each round one pass over the rows gives every learner its gradient and
curvature as sums that tasks make, of (dims + 1) ** 2 numbers a learner and fold, whatever the number of rows. Learners are
support vector machines with squared hinge loss or logistic regressions.

A row's class is the one whose code costs least: the mean binary loss over the learners that the class takes part in.
Logistic learners also give posteriors, the class chances whose implied learner chances come nearest to the learners' own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.scans import stored


def coding(classes: int, kind: str = "onevsone") -> np.ndarray:
    """1, -1 and 0 by class and learner: every pair, every class against the others, or the lower against the higher classes."""
    if kind == "onevsone":
        pairs = [(a, b) for a in range(classes) for b in range(a + 1, classes)]
        return np.array([[(k == a) - (k == b) for a, b in pairs] for k in range(classes)], int).reshape(classes, -1)
    if kind == "onevsall":
        return 2 * np.eye(classes, dtype=int) - 1
    if kind == "ordinal":
        return np.where(np.arange(classes)[:, None] <= np.arange(classes - 1), -1, 1)
    raise ValueError(f"unknown coding {kind!r}")


def _terms(margin: np.ndarray, learner: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of margins, and its first and second derivative."""
    if learner == "svm":
        short = np.maximum(1 - margin, 0.0)
        return short**2 / 2, -short, (short > 0).astype(float)
    p = 1 / (1 + np.exp(np.minimum(margin, 500)))
    return np.logaddexp(0.0, -margin), -p, p * (1 - p)


def _sums(rows: DataFrame, weights: np.ndarray, codes: np.ndarray, learner: str, sets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, loss, gradient and curvature sums by training set and learner; weights (sets, learners, dims + 1), the bias last.

    A set is a fold left out (-1: none) and the one time or condition that it takes (-1: all).
    """
    folds, learners, d = weights.shape
    size = 2 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, learners, size))
        for batch in batches:
            fold, when, y = (batch.column(i).to_numpy() for i in (0, 1, 2))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d - 1)
            x = np.c_[x, np.ones(len(y))]
            for k in range(learners):
                side = codes[y, k]
                for f, (out, only) in enumerate(sets):
                    own = (side != 0) & (fold != out) & ((when == only) | (only < 0))
                    z, t = x[own], side[own]
                    loss, slope, bend = _terms(t * (z @ weights[f, k]), learner)
                    sums[f, k] += np.r_[len(z), loss.sum(), (slope * t) @ z, ((z * bend[:, None]).T @ z).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(folds * learners * size)
    sums[got.column(0).to_numpy()] = got.column(1).to_numpy()
    sums = sums.reshape(folds, learners, size)
    return sums[..., 0], sums[..., 1], sums[..., 2 : 2 + d], sums[..., 2 + d :].reshape(folds, learners, d, d)


def learn(df: DataFrame, label: str, column: str, fold: str | None = None, kind: str = "onevsone", learner: str = "svm", ridge: float = 0.01, rounds: int = 30, tolerance: float = 1e-8, time: str | None = None) -> dict:
    """Weights of all learners, for each fold without its rows (one set of all rows where there is no fold), and for each ``time`` (or condition) by itself where one is named.

    The loss is the mean over a learner's rows and ridge / 2 times the squared weights, but for the bias. Rows without a label or vector are left out.
    """
    if learner not in ("svm", "logistic"):
        raise ValueError(f"unknown learner {learner!r}")
    rows = df.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select((F.col(fold) if fold else F.lit(0)).alias("f"), (F.col(time) if time else F.lit(0)).alias("t"), F.col(label).alias("y"), F.transform(column, lambda v: v.cast("double")).alias("x"))
    classes, folds, times = (sorted(r[0] for r in rows.select(c).distinct().collect()) for c in ("y", "f", "t"))  # bounded by the model's own size
    if not classes:
        raise ValueError("no rows")
    number = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int") - 1
    rows = stored(rows.select(number("f", folds).alias("f") if fold else F.lit(-2).alias("f"), number("t", times).alias("t"), number("y", classes).alias("y"), "x"), "output-codes")
    sets = [(f if fold else -1, t if time else -1) for t in range(len(times)) for f in range(len(folds))]
    dims, codes = rows.select(F.size("x")).first()[0], coding(len(classes), kind)
    weights = np.zeros((len(sets), codes.shape[1], dims + 1))
    free = np.r_[np.full(dims, ridge), 0.0]

    def value(loss: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        return loss / np.maximum(n, 1) + (free * w * w).sum(axis=-1) / 2

    n, loss, g, h = _sums(rows, weights, codes, learner, sets)
    now, size = value(loss, n, weights), np.ones(loss.shape)
    for _ in range(rounds):
        slope = g / np.maximum(n, 1)[..., None] + free * weights
        if np.abs(slope).max(initial=0.0) < tolerance:
            break
        bend = h / np.maximum(n, 1)[..., None, None] + np.diag(free + 1e-10)
        step = np.linalg.solve(bend, slope[..., None])[..., 0]
        there = weights - size[..., None] * step
        n, loss, new_g, new_h = _sums(rows, there, codes, learner, sets)
        new = value(loss, n, there)
        better = new <= now + 1e-12 * np.abs(now)
        # learners whose loss rose try half the step from where they were
        weights, now = np.where(better[..., None], there, weights), np.where(better, new, now)
        g, h = np.where(better[..., None], new_g, g), np.where(better[..., None, None], new_h, h)
        size = np.where(better, np.minimum(2 * size, 1.0), size / 2)
        if size.max(initial=1.0) < 1e-9:
            break
    return {"weights": weights, "codes": codes, "classes": classes, "folds": folds if fold else None, "times": times if time else None, "learner": learner}


def losses(scores: np.ndarray, codes: np.ndarray, learner: str = "svm") -> np.ndarray:
    """Mean binary loss (n, classes) of scores (n, learners): half the hinge, or the logistic loss in bits of two."""
    m = codes.T[None] * scores[:, :, None]  # n, learners, classes
    g = np.maximum(1 - m, 0.0) / 2 if learner == "svm" else np.logaddexp(0.0, -m) / (2 * np.log(2))
    taken = np.abs(codes.T)[None]
    return (g * taken).sum(axis=1) / np.maximum(taken.sum(axis=1), 1)


def posteriors(chances: np.ndarray, codes: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Class chances (n, classes) from learners' chances (n, learners) of their positive side, by multiplicative updates of the divergence between them and those that the class chances imply."""
    plus, minus = (codes == 1).astype(float), (codes == -1).astype(float)
    p = np.full((len(chances), len(codes)), 1 / len(codes))
    top = chances @ plus.T + (1 - chances) @ minus.T
    for _ in range(rounds):
        a = p @ plus
        implied = a / np.maximum(a + p @ minus, 1e-300)
        p = p * top / np.maximum(implied @ plus.T + (1 - implied) @ minus.T, 1e-300)
        p /= p.sum(axis=1, keepdims=True)
    return p


def decode(df: DataFrame, model: dict, column: str, fold: str | None = None) -> DataFrame:
    """Adds ``guess`` (null where the vector is) and ``posterior`` (by class in the model's order; null unless learners are logistic). With folds each row is read by the learners that haven't seen its fold."""
    weights, codes, learner, classes, folds = (model[k] for k in ("weights", "codes", "learner", "classes", "folds"))

    @F.pandas_udf("best int, posterior array<double>")
    def read(x: pd.Series, f: pd.Series) -> pd.DataFrame:
        best, chances = np.full(len(x), -1), [None] * len(x)
        there = x.notna().to_numpy() & (f.to_numpy() >= 0)
        for k in np.unique(f[there]):
            own = np.flatnonzero(there & (f.to_numpy() == k))
            z = np.c_[np.stack(x.iloc[own].to_numpy()).astype(float), np.ones(len(own))]
            s = z @ weights[k].T
            best[own] = losses(s, codes, learner).argmin(axis=1)
            if learner == "logistic":
                for i, p in zip(own, posteriors(1 / (1 + np.exp(-s)), codes), strict=True):
                    chances[i] = p
        return pd.DataFrame({"best": best, "posterior": chances})

    at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in folds]), F.col(fold)).cast("int") - 1, F.lit(-1)) if folds is not None else F.lit(0)
    names = F.array(*[F.lit(v) for v in classes])
    out = df.withColumn("__read", read(F.col(column), at))
    return out.withColumn("guess", F.when(F.col("__read.best") >= 0, F.get(names, F.col("__read.best")))).withColumn("posterior", F.col("__read.posterior")).drop("__read")


def cross_decode(df: DataFrame, model: dict, column: str, fold: str | None = None) -> DataFrame:
    """A row for each row and each time that the model learned from: adds ``trained`` (that time) and ``guess``, always by learners that haven't seen the row's fold."""
    out, per = None, len(model["folds"] or [0])
    for i, t in enumerate(model["times"]):  # times are few
        own = {**model, "weights": model["weights"][i * per : (i + 1) * per]}
        got = decode(df, own, column, fold).drop("posterior").withColumn("trained", F.lit(t))
        out = got if out is None else out.unionByName(got)
    return out


def cross_table(df: DataFrame, label: str, column: str, time: str, fold: str, **options) -> DataFrame:
    """trained, tested, accuracy (the mean over classes of the share found) and classes: how learners of each time or condition read every other one."""
    model = learn(df, label, column, fold, time=time, **options)
    right = (F.coalesce(F.col("guess") == F.col(label), F.lit(False))).cast("double")
    each = cross_decode(df.where(F.col(label).isNotNull() & F.col(column).isNotNull()), model, column, fold).groupBy("trained", F.col(time).alias("tested"), label).agg(F.avg(right).alias("a"))
    return each.groupBy("trained", "tested").agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("classes"))


def grouped_folds(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """Adds ``fold``: rows of one group (a session, a block of trials) share one, drawn by hash; null groups make one."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(seed)), F.lit(folds)).cast("int"))


def held_out(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``fold``: 0 for about a share of the groups, which are held out, 1 for the others."""
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.withColumn("fold", F.when(draw < share, 0).otherwise(1))
