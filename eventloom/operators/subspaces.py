"""Discriminant subspaces learned over time: one orthonormal basis U for all times, class weights W and biases b for each.

The loss of a time is the mean softmax loss, or a smoothed hinge loss, of its rows in the subspace, with penalties on W and b;
times are summed, or the best ones weigh most (a soft minimum). Tasks add up losses and gradients of their rows; the driver
sees one set of sums a step, of times * (dims * axes + axes * classes + classes) numbers, whatever the number of rows. Steps
go along the gradient, with lengths from the last change, and come back to orthonormal U by a QR decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import recording
from eventloom.operators.scans import stored


@dataclass
class Weights:
    """u (dims, axes), w (times, axes, classes), b (times, classes)."""

    u: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def minus(self, step: float, g: Weights) -> Weights:
        q, r = np.linalg.qr(self.u - step * g.u)
        return Weights(q * np.sign(np.where(np.diag(r) == 0, 1.0, np.diag(r))), self.w - step * g.w, self.b - step * g.b)

    def dot(self, other: Weights) -> float:
        return float((self.u * other.u).sum() + (self.w * other.w).sum() + (self.b * other.b).sum())

    def less(self, other: Weights) -> Weights:
        return Weights(self.u - other.u, self.w - other.w, self.b - other.b)


def softmax(s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss of scores (n, classes) and its gradient."""
    rows = np.arange(len(y))
    top = s.max(axis=1, keepdims=True)
    e = np.exp(s - top)
    z = e.sum(axis=1)
    g = e / z[:, None]
    g[rows, y] -= 1
    return float((top[:, 0] + np.log(z) - s[rows, y]).sum()), g


def hinge(s: np.ndarray, y: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """tau * log(1 + the sum over other classes of exp((1 + s - s of the own) / tau)), summed, and its gradient."""
    rows = np.arange(len(y))
    m = (1 + s - s[rows, y][:, None]) / tau
    m[rows, y] = -np.inf
    top = np.maximum(m.max(axis=1), 0.0)
    e = np.exp(m - top[:, None])
    total = np.exp(-top) + e.sum(axis=1)
    g = e / total[:, None]
    g[rows, y] = -g.sum(axis=1)
    return float(tau * (top + np.log(total)).sum()), g


def prepared(df: DataFrame, label: str, column: str, time: str | None = None) -> tuple[DataFrame, list, list]:
    """Rows (time, y, x) with whole numbers for times and classes, and the times and classes they stand for; null labels and vectors are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select((F.col(time) if time else F.lit(0)).alias("t"), F.col(label).alias("y"), F.transform(column, lambda v: v.cast("double")).alias("x"))
    times, classes = (sorted(r[0] for r in rows.select(c).distinct().collect()) for c in ("t", "y"))  # bounded by the model's own size
    number = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int") - 1
    return stored(rows.select(number("t", times).alias("t"), number("y", classes).alias("y"), "x"), "subspace-rows"), times, classes


def losses(rows: DataFrame, weights: Weights, kind: str = "softmax", tau: float = 0.5) -> tuple[np.ndarray, np.ndarray, Weights]:
    """Number of rows and mean loss of each time, and the gradients of the means: u (times, dims, axes), w, b."""
    times, axes, classes = weights.w.shape
    dims = len(weights.u)
    size = 2 + dims * axes + axes * classes + classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((times, size))
        for batch in batches:
            t, y = (batch.column(i).to_numpy() for i in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(t), dims)
            for k in np.unique(t):
                own, target = x[t == k], y[t == k]
                z = own @ weights.u
                s = z @ weights.w[k] + weights.b[k]
                f, g = softmax(s, target) if kind == "softmax" else hinge(s, target, tau)
                sums[k] += np.r_[len(own), f, (own.T @ (g @ weights.w[k].T)).ravel(), (z.T @ g).ravel(), g.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["i", "v"])

    got = rows.select("t", "y", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(times * size)
    sums[got.column(0).to_numpy()] = got.column(1).to_numpy()
    sums = sums.reshape(times, size)
    n = sums[:, 0]
    mean = sums / np.maximum(n, 1)[:, None]
    cut = np.cumsum([2, dims * axes, axes * classes])
    return n, mean[:, 1], Weights(mean[:, cut[0] : cut[1]].reshape(times, dims, axes), mean[:, cut[1] : cut[2]].reshape(times, axes, classes), mean[:, cut[2] :])


def objective(rows: DataFrame, weights: Weights, kind: str = "softmax", penalty: float = 1e-3, bias_penalty: float = 1e-6, tau: float = 0.5, sharp: float | None = None) -> tuple[float, Weights, np.ndarray]:
    """Loss over all times, its gradient, and the loss of each time with its penalties.

    ``sharp`` makes a soft minimum over times, by the logarithm of a sum of exp(-sharp * loss); without it times are summed.
    """
    _, f, g = losses(rows, weights, kind, tau)
    each = f + penalty / 2 * (weights.w**2).sum(axis=(1, 2)) + bias_penalty / 2 * (weights.b**2).sum(axis=1)
    w, b = g.w + penalty * weights.w, g.b + bias_penalty * weights.b
    if sharp is None or len(each) == 1:
        share, total = np.ones(len(each)), float(each.sum())
    else:
        e = np.exp(-sharp * (each - each.min()))
        share, total = e / e.sum(), float(each.min() - np.log(e.sum()) / sharp)
    return total, Weights(np.tensordot(share, g.u, 1), w * share[:, None, None], b * share[:, None]), each


def learn(df: DataFrame, label: str, column: str, axes: int, time: str | None = None, kind: str = "softmax", rounds: int = 50, tolerance: float = 1e-6, **options) -> dict:
    """u, w, b, and by time the losses; times and classes in their order. Begins at the closed-form discriminant axes of all times together."""
    if kind not in ("softmax", "hinge"):
        raise ValueError(f"unknown loss {kind!r}")
    rows, times, classes = prepared(df, label, column, time)
    if not classes:
        raise ValueError("no rows")
    start = recording.discriminant_subspace(rows.withColumn("all", F.lit(0)), ["all"], "y", "x", axes).orderBy("axis").collect()
    u = np.linalg.qr(np.array([r.weights for r in start]).T)[0]
    here = Weights(u, np.zeros((len(times), u.shape[1], len(classes))), np.zeros((len(times), len(classes))))
    inner = lambda at, g: Weights(g.u - at.u @ ((at.u.T @ g.u + g.u.T @ at.u) / 2), g.w, g.b)  # noqa: E731  along the orthonormal ones
    f, g, each = objective(rows, here, kind, **options)
    g, step, history = inner(here, g), 1.0, [f]
    for _ in range(rounds):
        slope = g.dot(g)
        if slope < tolerance**2:
            break
        while True:
            there = here.minus(step, g)
            new, new_g, new_each = objective(rows, there, kind, **options)
            if new <= f - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if new > f:
            break
        new_g = inner(there, new_g)
        moved, turned = there.less(here), new_g.less(g)
        both = moved.dot(turned)
        step = min(max(moved.dot(moved) / both, 1e-4), 1e4) if both > 1e-16 else 2 * step
        done = f - new <= tolerance * max(1.0, abs(f))
        here, g, f, each = there, new_g, new, new_each
        history.append(f)
        if done:
            break
    return {"u": here.u, "w": here.w, "b": here.b, "loss": each, "history": history, "times": times, "classes": classes}


def predict(df: DataFrame, model: dict, column: str, time: str | None = None) -> DataFrame:
    """Adds ``guess``: the class of the greatest score at the row's time (null where the time is unknown or the vector null)."""
    flat = lambda a: F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in a])
    per = F.array(*[flat((model["u"] @ w).T) for w in model["w"]])  # times, classes, dims
    bias = flat(model["b"])
    t = F.array_position(F.array(*[F.lit(v) for v in model["times"]]), F.col(time) if time else F.lit(0)).cast("int")
    score = F.transform(F.get(per, t - 1), lambda k: F.aggregate(F.zip_with(k, column, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    total = F.zip_with(score, F.get(bias, t - 1), lambda a, b: a + b)
    names = F.array(*[F.lit(v) for v in model["classes"]])
    return df.withColumn("guess", F.when(F.col(column).isNotNull() & (t > 0), F.element_at(names, F.array_position(total, F.array_max(total)).cast("int"))))
