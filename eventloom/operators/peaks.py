"""Local maxima with height, prominence and distance, over blocks of time.

A series is first reduced to its turning points. The prominence of a peak is its height over the higher of two minima: those
between it and the nearest strictly higher sample (or the series' end) on either side. Blocks settle the peaks that have
higher ones on both sides within the block; what remains is a sequence that rises to the block's highest peak and falls
after it, with the minima between. Neighbouring blocks' remains are joined and reduced again, level by level. Peaks that
aren't above the wanted height are left out at once, which changes nothing for the others.

Of peaks nearer than the wanted distance the higher one stays, the earlier one of equal ones, from the highest downwards.
Whether a peak stays depends on higher ones within the distance only; blocks decide what their surroundings allow, and
rounds go on with the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import ordered, scans
from eventloom.operators.scans import _frames, blocks, kinds, stored


def turning_points(rows: DataFrame, on: tuple[str, ...], order: str, value: str, span: int | None = None) -> DataFrame:
    """keys, o, v and peak of each series' local maxima (the first of equal samples), minima and ends. Orders are distinct within a key; rows without a number are left out."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*on, F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    runs = ordered.before(rows, "p", "v", "o", on, span).where("p is null or p <> v").withColumn("back", -F.col("o"))
    both = ordered.before(runs, "f", "v", "back", on, span)
    peak = (F.col("v") > F.col("p")) & (F.col("v") > F.col("f"))
    ends = F.col("p").isNull() | F.col("f").isNull()
    return both.select(*on, "o", "v", F.coalesce(peak, F.lit(False)).alias("peak")).where(peak | ends | ((both["v"] < both["p"]) & (both["v"] < both["f"])))


def reduced(o: np.ndarray, h: np.ndarray, v: np.ndarray, lead: float, last: bool) -> tuple[list[tuple], tuple]:
    """Settled peaks (order, height, left minimum, right minimum), and what remains in the form that came in.

    o, h: peaks; v: the minimum from each to the next (or to the end); lead: the minimum before the first. ``last``: the ends are those of the series, so all are settled.
    """
    n = len(o)
    left, right, has = np.empty(n), np.empty(n), np.zeros((2, n), bool)
    for side, (base, order) in enumerate(((left, range(n)), (right, range(n - 1, -1, -1)))):
        stack: list[tuple[float, float]] = []  # heights that fall towards the top, with the minimum since each
        low = lead if side == 0 else np.inf
        for i in order:
            gap = low if (side == 0 and i == 0) else v[i - 1] if side == 0 else v[i]
            while stack and stack[-1][0] <= h[i]:
                gap = min(gap, stack.pop()[1])
            has[side, i] = bool(stack)
            base[i] = gap
            stack.append((h[i], gap))
    done = has.all(axis=0) | last
    settled = list(zip(o[done].tolist(), h[done].tolist(), left[done].tolist(), right[done].tolist(), strict=True))
    rest = np.flatnonzero(~done)
    if not len(rest):
        return settled, (o[:0], h[:0], v[:0], float(min(lead, v.min(initial=np.inf))))
    return settled, (o[rest], h[rest], np.minimum.reduceat(v, rest), float(min(lead, v[: rest[0]].min(initial=np.inf))))


_REST = "o array<long>, h array<double>, v array<double>, lead double"
_SETTLED = "done array<struct<o:long,h:double,left:double,right:double>>"


def _as_row(settled: list[tuple], rest: tuple) -> dict:
    return {"o": rest[0], "h": rest[1], "v": rest[2], "lead": rest[3], "done": [dict(zip(("o", "h", "left", "right"), s, strict=True)) for s in settled]}


def _joining(on: tuple[str, ...], last: bool):
    """Neighbouring blocks' remains as one, reduced."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        o, h, v, lead = [], [], [], np.inf
        for at, height, low, before in zip(pdf["o"], pdf["h"], pdf["v"], pdf["lead"], strict=True):
            if v:
                v[-1] = min(v[-1], before)
            else:
                lead = min(lead, before)
            o.extend(at)
            h.extend(height)
            v.extend(low)
        got = _as_row(*reduced(np.array(o, np.int64), np.array(h, float), np.array(v, float), lead, last))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in on}, "b": int(pdf["g"].iloc[0]), **got}])

    return join


def prominences(points: DataFrame, on: tuple[str, ...], height: float = -np.inf, width: int | None = None, fan: int | None = None) -> DataFrame:
    """keys, o, h and prominence of the peaks above ``height`` among turning points."""
    width, fan = width or scans.WIDTH, fan or 64
    packed = blocks(points, on, "o", {"v": F.col("v"), "peak": F.col("peak").cast("double")}, width)

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for at, x, peak in zip(pdf["at"], pdf["v"], pdf["peak"], strict=True):
            at, x = np.asarray(at), np.asarray(x, float)
            own = np.flatnonzero((np.asarray(peak) > 0) & (x > height))
            low = np.where(np.isin(np.arange(len(x)), own), np.inf, x)
            v = np.minimum.reduceat(low, own) if len(own) else np.zeros(0)
            rows.append(_as_row(*reduced(at[own], x[own], v, float(low[: own[0] if len(own) else len(low)].min(initial=np.inf)), False)))
        return pd.concat([pdf[[*on, "b"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    level = stored(packed.mapInPandas(_frames(begin), kinds(packed, on) + f"b long, {_REST}, {_SETTLED}"), "peaks-level")
    shape, found, last = kinds(level, on) + f"b long, {_REST}, {_SETTLED}", [level], False
    while not last:
        low, high = level.agg(F.min("b"), F.max("b")).first()
        last = low is None or high - low < fan
        grouped = level.select(*on, (F.lit(0).cast("long") if last else scans.bucket("b", fan)).alias("g"), "b", "o", "h", "v", "lead")
        level = grouped.groupBy(*on, "g").applyInPandas(_joining(on, last), shape)
        level = level if last else stored(level, "peaks-level")
        found.append(level)
    out = found[0].select(*on, F.explode("done").alias("s"))
    for f in found[1:]:
        out = out.unionByName(f.select(*on, F.explode("done").alias("s")))
    return out.select(*on, F.col("s.o").alias("o"), F.col("s.h").alias("h"), (F.col("s.h") - F.greatest("s.left", "s.right")).alias("prominence"))


def apart(peaks: DataFrame, on: tuple[str, ...], distance: int, width: int | None = None) -> DataFrame:
    """Rows (keys, o, h, ...) of which none is within ``distance`` of a higher one that stays."""
    size = max(width or scans.WIDTH, 4 * distance)
    reach = 4 * distance
    rows, columns = peaks.withColumn("state", F.lit(0)), peaks.columns
    shape = kinds(peaks, columns)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o").reset_index(drop=True)
        o, h, state = pdf["o"].to_numpy(), pdf["h"].to_numpy(), pdf["state"].to_numpy().copy()
        lo, hi = np.searchsorted(o, o - distance, "left"), np.searchsorted(o, o + distance, "right")
        start = int(pdf["b"].iloc[0]) * size
        seen = (o >= start - reach + distance) & (o < start + size + reach - distance)  # all within the distance is here
        kept, open_ = state == 1, np.zeros(len(o), bool)
        for i in np.lexsort((o, -h)):
            if kept[i]:
                continue
            if kept[lo[i] : hi[i]].any():
                state[i] = 2
            elif open_[lo[i] : hi[i]].any() or not seen[i]:
                open_[i] = True
            else:
                kept[i], state[i] = True, 1
        return pdf.assign(state=state)[(o >= start) & (o < start + size) & (state < 2)][[*columns, "state"]]

    while True:
        b = scans.bucket("o", size)
        near = F.filter(F.array(b - 1, b, b + 1), lambda q: (F.col("o") >= q * size - reach) & (F.col("o") < (q + 1) * size + reach))
        rows = stored(rows.withColumn("b", F.explode(near)).groupBy(*on, "b").applyInPandas(decide, shape + "state int"), "peaks-apart")
        if rows.where("state = 0").isEmpty():
            return rows.drop("state")


def find_peaks(rows: DataFrame, on: tuple[str, ...], order: str, value: str, height: float = -np.inf, prominence: float = 0.0, distance: int = 0, width: int | None = None, fan: int | None = None, span: int | None = None) -> DataFrame:
    """keys, order, value and prominence of local maxima above ``height``, of at least ``prominence``, none within ``distance`` of a higher one.

    Of equal neighbouring samples the first is the peak; ends of series are none. ``span`` is the width in order of the buckets in which neighbours are found where keys are large.
    """
    found = prominences(turning_points(rows, on, order, value, span), on, height, width, fan).where(F.col("prominence") >= F.lit(float(prominence)))
    if distance:
        found = apart(stored(found, "peaks"), on, distance, width)
    return found.select(*on, F.col("o").cast(rows.schema[order].dataType).alias(order), F.col("h").alias(value), "prominence")
