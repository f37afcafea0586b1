"""Instantaneous rates after events by slopes at many scales, with onset, peak and offset of the response; and bootstrapped means.

Spike times after all events are pooled by unit and counted in fine bins of the window: a table of units by bins, whatever
the number of spikes. Against the time after the event, the share of spikes so far has a slope that, above that of an even
spread, tells the response. Slopes are taken over windows from three bins to a fifth of the whole, each 1.5 times as wide as
the one before; their mean is the slope at many scales.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.operators import window_counts as wc

BASE = 1.5


def reaches(bins: int, base: float = BASE) -> list[int]:
    """Bins on either side of the middle one, scale by scale."""
    out, x = [], 1.0
    while x <= bins / 10:
        if int(x) not in out:
            out.append(int(x))
        x *= base
    return out or [1]


def slopes(counts: np.ndarray, window: float, base: float = BASE) -> np.ndarray:
    """Mean over scales of the slope of the share of spikes less that of an even spread, per second; windows end at the edges."""
    n, total = len(counts), counts.sum()
    if not total:
        return np.zeros(n)
    run, at, out = np.r_[0, np.cumsum(counts)], np.arange(n), []
    for k in reaches(n, base):
        lo, hi = np.maximum(at - k, 0), np.minimum(at + k + 1, n)
        out.append((run[hi] - run[lo]) / total / ((hi - lo) * window / n) - 1 / window)
    return np.mean(out, axis=0)


def pooled(spikes: DataFrame, events: DataFrame, key: str, window: int, bins: int) -> DataFrame:
    """key and counts: spikes (key, t) after events (e) within the window, in bins; any number of rows a key, which add up to the whole. Times in microseconds."""
    edges = [-(-k * window // bins) for k in range(bins + 1)]
    # a spike's own count: events at e with t - e in [a, b), so e - t in [1 - b, 1 - a)
    return wc.pooled(spikes.select(F.col(key).alias("__unit"), F.col("t").alias("e")), events.select(F.col("e").alias("t")), [(1 - b, 1 - a) for a, b in zip(edges, edges[1:], strict=False)], ["__unit"]).select(F.col("__unit").alias(key), "counts")


def _rates(pdf: pd.DataFrame, bins: int, window: float, events: int, base: float) -> tuple[np.ndarray, np.ndarray]:
    counts = np.sum(np.stack(pdf["counts"].to_numpy()), axis=0).astype(float)
    slope = slopes(counts, window, base)
    return slope, (slope + 1 / window) * counts.sum() / max(events, 1)


def rates(spikes: DataFrame, events: DataFrame, key: str, window: int, bins: int = 1024, base: float = BASE) -> DataFrame:
    """key, t (a bin's middle, seconds), slope and rate (spikes per second and event) of every unit that fires in the window."""
    n, length = events.count(), window / 1e6

    def run(unit, pdf: pd.DataFrame) -> pd.DataFrame:
        slope, rate = _rates(pdf, bins, length, n, base)
        return pd.DataFrame({key: unit[0], "t": (np.arange(bins) + 0.5) * length / bins, "slope": slope, "rate": rate})

    return pooled(spikes, events, key, window, bins).where(F.exists("counts", lambda n: n > 0)).groupBy(key).applyInPandas(run, f"`{key}` {spikes.schema[key].dataType.simpleString()}, t double, slope double, rate double")


def located(rate: np.ndarray, step: float) -> tuple[float, float, float, float, float]:
    """Onset, time of the half peak, peak, offset (seconds) and peak rate: the run of bins around the greatest rate that lies above halfway from the median to it; the half peak is where the rise crosses that level."""
    p = int(rate.argmax())
    level = (np.median(rate) + rate[p]) / 2
    below = np.flatnonzero(rate < level)
    a = int(below[below < p][-1]) + 1 if (below < p).any() else 0
    b = int(below[below > p][0]) if (below > p).any() else len(rate)
    half = (a + 0.5) * step
    if a and rate[a] > rate[a - 1]:
        half -= step * (rate[a] - level) / (rate[a] - rate[a - 1])
    return a * step, half, (p + 0.5) * step, b * step, float(rate[p])


def responses(spikes: DataFrame, events: DataFrame, key: str, window: int, bins: int = 1024, base: float = BASE) -> DataFrame:
    """key, onset, half_peak, peak, offset (seconds) and peak_rate of every unit that fires in the window."""
    n, length = events.count(), window / 1e6
    names = ["onset", "half_peak", "peak", "offset", "peak_rate"]

    def run(unit, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(unit[0], *located(_rates(pdf, bins, length, n, base)[1], length / bins))], columns=[key, *names])

    return pooled(spikes, events, key, window, bins).where(F.exists("counts", lambda n: n > 0)).groupBy(key).applyInPandas(run, f"`{key}` {spikes.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names))


#: The distribution function of a Poisson variable of mean 1, in 2 ** -31, up to 12.
_STEPS = np.round(np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 13)])) * 2**31).astype(np.int64)
_MODULUS = (1 << 31) - 1


def poisson_weights(ids: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
    """How often each id counts in each draw (ids, draws): Poisson numbers of mean 1 by a hash of id and draw.

    x = id modulo 2**31 - 1 is multiplied and moved by numbers of the draw, modulo that prime, with three squares between.
    """
    x = (np.asarray(ids, np.int64) % _MODULUS)[:, None]
    d = np.arange(1, draws + 1, dtype=np.int64)[None] + seed * 7919
    x = (x * (d * 48271 % _MODULUS) + d * 69621) % _MODULUS
    x = (x * x + d * 16807) % _MODULUS
    x = (x * x + x * (d * 30269 % _MODULUS)) % _MODULUS
    x = (x * x + d * 39373) % _MODULUS
    return np.searchsorted(_STEPS, x, "right")


def bootstrap_means(df: DataFrame, by: list[str], row: str, column: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """by, draw, n (weights' sum) and mean (of the vectors) for every draw.

    Each row counts a Poisson number of times in a draw, by its number ``row``, so all draws come from one pass: a task adds up
    products of weights and vectors, of draws * (dims + 1) numbers a group. Rows without a number or vector are left out.
    """
    names = list(by)
    rows = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(*names, F.col(row).cast("long").alias("__id"), F.transform(column, lambda v: v.cast("double")).alias("__x"))
    arrow = to_arrow_schema(T.StructType([*[rows.schema[k] for k in names], T.StructField("draw", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.c_[np.ones(len(x)), x]
            w = poisson_weights(batch.column("__id").to_numpy(), draws, seed).astype(float)
            keys = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True)) if names else [()] * len(x)
            for key in dict.fromkeys(keys):
                own = np.array([k == key for k in keys])
                sums[key] = sums.get(key, 0) + w[own].T @ x[own]
        for key, s in sums.items():
            n, d = s.shape
            yield pa.RecordBatch.from_pydict({**{k: [v] * s.size for k, v in zip(names, key, strict=True)}, "draw": np.repeat(np.arange(n, dtype=np.int32), d), "i": np.tile(np.arange(d, dtype=np.int32), n), "v": s.ravel()}, schema=arrow)

    kind = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in names)
    total = rows.mapInArrow(run, f"{kind}draw int, i int, v double").groupBy(*names, "draw", "i").agg(F.sum("v").alias("v"))
    listed = total.groupBy(*names, "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("s"))
    n = F.col("s")[0]
    return listed.select(*names, "draw", n.alias("n"), F.when(n > 0, F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), lambda v: v / n)).alias("mean"))

