"""Ripples: bursts of a band in channels of any length, by peaks of its smoothed envelope.

The band is filtered forwards and backwards over whole channels (scans.filtered). Blocks, with ``REACH`` seconds of their
neighbours on either side, give the amplitude of the analytic signal, smoothed by a Gaussian of a tenth of a second. Mean and
deviation of envelope and signal come from sums over blocks; peaks are those of peaks.find_peaks on the standardised
envelope. Each peak then takes a quarter of a second of signal and envelope around it, for its edges and troughs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import filters
from eventloom.functions.numeric import envelope
from eventloom.operators import ordered, peaks, scans
from eventloom.operators.scans import _frames, blocks, kinds, matched, stored

#: Seconds of the neighbouring blocks that an envelope sees, and of signal around a peak.
REACH, AROUND = 1.0, 0.25
#: Greatest deviation of a trough from the signal's mean, in standard deviations.
OUTLIER = 10.0


def gaussian(fs: float) -> np.ndarray:
    """Window of a tenth of a second whose ends lie four deviations from its middle, with sum 1."""
    n = max(int(0.1 * fs), 1)
    k = np.exp(-0.5 * (4 * (np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 0.5)) ** 2)
    return k / k.sum()


def smoothed(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Central part of the convolution, as long as x; of an even kernel the later of its two middles counts."""
    at = len(kernel) // 2
    return np.convolve(x, kernel)[at : at + len(x)]


def _maxima(x: np.ndarray, distance: float) -> np.ndarray:
    """Places of maxima above 0, the first of equal samples, none within the distance of a higher one that stays."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    v = x[first]
    place = first[1:-1][(v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] > 0)] if len(v) > 2 else first[:0]
    kept: list[int] = []
    for i in place[np.lexsort((place, -x[place]))]:
        if all(abs(i - k) > distance for k in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)


def edges(z: np.ndarray, c: int, least: float) -> tuple[int, int] | None:
    """First and last place around the peak at c where the standardised envelope is over ``least``."""
    change = np.flatnonzero(np.diff(np.sign(z - least)) != 0)
    before, after = change[change <= c - 2], change[change >= c]
    return (int(before[-1]) + 1, int(after[0])) if len(before) and len(after) else None


def burst(x: np.ndarray, z: np.ndarray, c: int, least: float, distance: float, mean: float, sd: float) -> tuple[int, int, np.ndarray] | tuple[int, int, None] | None:
    """Edges and troughs of the peak at place c of its surroundings; no troughs if there are fewer than two or the nearest one is an outlier."""
    found = edges(z, c, least)
    if found is None:
        return None
    a, b = found
    t = _maxima(-x, distance)
    t = t[(t >= a) & (t < b)]
    if len(t) < 2 or abs(x[t[np.abs(t - c).argmin()]] - mean) / sd > OUTLIER:
        return a, b, None
    return a, b, t


def _with_neighbours(packed: DataFrame, on: tuple[str, ...], column: str, reach: int) -> DataFrame:
    """Adds ``before`` and ``after``: up to ``reach`` values of the blocks next to each one (a block holds that many, unless it is a series' last)."""
    tail = packed.select(*on, (F.col("b") + 1).alias("b"), F.slice(column, F.greatest(F.size(column) - reach + 1, F.lit(1)), F.lit(reach)).alias("before"))
    head = packed.select(*on, (F.col("b") - 1).alias("b"), F.slice(column, 1, reach).alias("after"))
    return matched(matched(packed, tail, [*on, "b"], "left"), head, [*on, "b"], "left")


def envelopes(df: DataFrame, key: str, order: str, value: str, fs: float, band: tuple[float, float], kind: str, poles: int, width: int) -> DataFrame:
    """One row a block: key, b, at, x (signal) and env (smoothed amplitude of the band)."""
    reach, kernel = min(int(REACH * fs), width), gaussian(fs)
    sos = filters.sections(kind, poles, band, fs)
    passed = scans.filtered(df.select(key, F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("x")), (key,), "o", "x", sos, width=width)
    own = stored(blocks(passed, (key,), "o", {"y": F.col("x")}, width), "ripple-band")
    raw = blocks(df, (key,), order, {"x": F.col(value).cast("double")}, width).drop("at")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[key, "b", "at", "x"]].copy()
        env = []
        for before, y, after in zip(pdf["before"], pdf["y"], pdf["after"], strict=True):
            before, after = (np.asarray(v, float) if v is not None else np.zeros(0) for v in (before, after))
            whole = smoothed(envelope(np.r_[before, np.asarray(y, float), after]), kernel)
            env.append(whole[len(before) : len(before) + len(y)])
        out["env"] = env
        return out

    ready = matched(_with_neighbours(own, (key,), "y", reach), raw, [key, "b"])
    return ready.mapInPandas(_frames(run), kinds(own, [key]) + "b long, at array<long>, x array<double>, env array<double>")


def _moments(blocked: DataFrame, key: str) -> DataFrame:
    """key, mean and sd of the envelope (m, s) and of the signal (mx, sx)."""
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    parts = blocked.select(key, F.size("x").alias("n"), *[total(c, f).alias(f"{c}{i}") for c in ("x", "env") for i, f in enumerate((lambda v: v, lambda v: v * v))])
    sums = parts.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in ("x", "env") for i in (0, 1)]).where("n > 1")
    sd = lambda c: F.sqrt(F.greatest((F.col(f"{c}1") - F.col(f"{c}0") * F.col(f"{c}0") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    return sums.select(key, (F.col("env0") / F.col("n")).alias("m"), sd("env").alias("s"), (F.col("x0") / F.col("n")).alias("mx"), sd("x").alias("sx")).where("s > 0 and sx > 0")


def find_ripples(df: DataFrame, key: str, order: str, value: str, fs: float, band: tuple[float, float] = (70.0, 180.0), threshold: float = 5.0, least: float = 3.0, cycles: int = 3, kind: str = "butter", poles: int = 3, width: int | None = None, span: int | None = None) -> DataFrame:
    """key, t (the trough nearest to the envelope's peak), peak, onset, offset, n_cycles, freq, amplitude, amplitude_norm and troughs; times are sample / fs in seconds.

    Peaks of the smoothed envelope stand ``threshold`` deviations over its mean and as much over their surroundings, none
    within 0.05 s of a higher one; edges are where it falls to ``least`` deviations, within a quarter of a second. A peak
    before the former one's end counts only if that one itself came before an end. Troughs are minima of the signal below 0,
    no two within 1 / band[1] s; ripples with fewer than ``cycles`` (two at least) or an outlier as nearest trough are left out.
    ``span`` is the width in samples of the buckets in which neighbouring peaks meet where a channel is large.
    """
    width, around = width or scans.WIDTH, int(AROUND * fs)
    names = ["peak", "onset", "offset", "n_cycles", "freq", "amplitude", "amplitude_norm"]
    blocked = stored(envelopes(df, key, order, value, fs, band, kind, poles, width), "ripple-envelope")
    level = stored(_moments(blocked, key), "ripple-level")
    z = F.transform("env", lambda v: (v - F.col("m")) / F.col("s"))
    known = stored(matched(blocked, level, [key]).select(key, "b", "at", "x", z.alias("z"), "m", "s", "mx", "sx"), "ripple-scores")
    rows = known.select(key, F.explode(F.arrays_zip("at", "z")).alias("r")).select(key, F.col("r.at").alias("o"), F.col("r.z").alias("z"))
    top = stored(peaks.find_peaks(rows, (key,), "o", "z", threshold, threshold, int(0.05 * fs), span=span).select(key, "o", F.col("z").alias("top")), "ripple-peaks")

    near = top.select(key, "o", "top", F.explode(F.sequence(scans.bucket(F.col("o") - around, width), scans.bucket(F.col("o") + around, width))).alias("b"))
    met = matched(near, known, [key, "b"])
    start, stop = F.greatest(F.col("at")[0], F.col("o") - around), F.least(F.element_at("at", -1), F.col("o") + around)
    cut = lambda c: F.slice(c, (start - F.col("at")[0] + 1).cast("int"), (stop - start + 1).cast("int"))
    part = met.where(stop >= start).select(key, "o", "top", "m", "s", "mx", "sx", F.struct(start.alias("at"), cut("x").alias("x"), cut("z").alias("z")).alias("p"))
    whole = part.groupBy(key, "o", "top", "m", "s", "mx", "sx").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = whole.select(key, "o", "top", "m", "s", "mx", "sx", F.col("p")[0]["at"].alias("first"), F.flatten(F.col("p")["x"]).alias("x"), F.flatten(F.col("p")["z"]).alias("z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            got = burst(np.asarray(r.x, float), np.asarray(r.z, float), r.o - r.first, least, fs / band[1], r.mx, r.sx)
            a, b, t = got or (None, None, None)
            troughs = None if t is None else (t + r.first).tolist()
            out.append((r.first + a if got else None, r.first + b if got else None, troughs))
        done = pdf[["__key", "o", "top", "m", "s"]].copy()
        done["on"], done["off"], done["troughs"] = (pd.Series(c, index=pdf.index, dtype=object) for c in zip(*out, strict=True))
        return done

    kind_of = kinds(df.select(F.col(key).alias("__key")), ["__key"])
    found = whole.withColumnRenamed(key, "__key").mapInPandas(_frames(run), kind_of + "o long, top double, m double, s double, on long, off long, troughs array<long>")
    found = stored(found, "ripple-bursts")
    # a peak inside the former one's burst is passed over, unless the former one was itself
    chain = ordered.before(found, "end", "off", "o", ("__key",), span)
    chain = chain.withColumn("fresh", F.when(F.col("end").isNotNull() & (F.col("o") <= F.col("end")), 0).otherwise(1).cast("long"))
    chain = ordered.running_sum(chain, {"run": "fresh"}, "o", ("__key",), span)
    chain = ordered.numbered(chain, "place", "o", ("__key", "run"))
    good = chain.where(f"place % 2 = 1 and troughs is not null and size(troughs) >= {max(cycles, 2)}")
    trough = F.array_sort(F.transform("troughs", lambda v: F.struct(F.abs(v - F.col("o")).alias("d"), v.alias("v"))))[0]["v"]
    seconds = lambda c: c / F.lit(float(fs))
    columns = [seconds(F.col("o")), seconds(F.col("on")), seconds(F.col("off")), F.size("troughs").cast("long"), (F.size("troughs") - 1) * F.lit(float(fs)) / (F.element_at("troughs", -1) - F.col("troughs")[0]), F.col("m") + F.col("top") * F.col("s"), F.col("top")]
    return good.select(F.col("__key").alias(key), seconds(trough).alias("t"), *[c.alias(n) for c, n in zip(columns, names, strict=True)], F.transform("troughs", seconds).alias("troughs"))
